"""Gradients against central differences, on small inline rows."""

import numpy as np
import pytest

from gradframe.functions.models import LR, MLP, KMeans
from gradframe.functions.network import Act, Conv, Dense, Net, Pool, Recurrent, SeqNet, WeightedSum

MLP_ROWS = np.array(
    [[0.2, 0.9, 0.92], [0.1, 0.5, 0.86], [0.3, 0.6, 0.89], [0.9, 0.2, 0.08], [0.5, 0.1, 0.14], [0.6, 0.3, 0.11]]
)
RNN_STEPS = np.array(
    [[0, 0.3], [0.3, 0.3], [0.3, 0.6], [0.2, 0.1], [0.1, 0.5], [0.6, 0.3], [0.1, 0.2], [0, 0.3],
     [0.3, 0.3], [0.5, 0.4], [0.3, 0.3], [0.3, 0.3], [0.5, 0.4]]
)


def numeric(model, X, Y, w, share):
    out = np.zeros((len(X), model.width))
    for j in range(model.width):
        up, down = w.copy(), w.copy()
        up[j] += 1e-6
        down[j] -= 1e-6
        change = model.loss(model.score(X, up), Y) - model.loss(model.score(X, down), Y)
        out[:, j] = share * change / 2e-6
    return out


def check(model, X, Y, share=0.5):
    w = np.random.default_rng(1).normal(size=model.width)
    G, loss = model.grad_rows(X, Y, w)
    assert np.allclose(G, numeric(model, X, Y, w, share), atol=1e-7)
    g, total = model.grad_sum(X, Y, w)
    assert np.allclose(g, G.sum(axis=0)) and np.isclose(total, loss.sum())


def test_logistic():
    rng = np.random.default_rng(0)
    check(LR(4), rng.normal(size=(7, 4)), rng.integers(0, 2, (7, 1)).astype(float), share=1)


def test_mlp():
    check(MLP((2, 3, 1)), MLP_ROWS[:, :2], MLP_ROWS[:, 2:])


def test_mlp_compat_repeats_the_second_sigmoid():
    w = np.random.default_rng(1).normal(size=13)
    X, Y = MLP_ROWS[:, :2], MLP_ROWS[:, 2:]
    out = MLP((2, 3, 1)).layers(X, w)
    p, s = out[-1], 1 / (1 + np.exp(-out[-1]))
    got = MLP((2, 3, 1), compat=True).grad_rows(X, Y, w)[0][:, -1:]
    assert np.allclose(got, (p - Y) * s * (1 - s))


NETS = {
    "series": Net((8,), (Conv(1, (3,)), Act("sigmoid"), Pool("max", (2,)), Dense(1))),
    "two outputs": Net((9,), (Conv(2, (2,)), Act("tanh"), Pool("min", (3,)), Conv(2, (2,)), Dense(2))),
    "image": Net((4, 4), (Conv(2, (2, 2)), Pool("max", (2, 2)), Dense(1))),
    "image twice": Net((6, 5), (Conv(2, (2, 2)), Pool("max", (2, 2)), Conv(1, (2, 2)), Act("relu"), Dense(1))),
    "cube": Net((4, 4, 4), (Conv(2, (2, 2, 2)), Pool("min", (2, 2, 2)), Dense(1))),
    "sum": Net((6,), (WeightedSum(3), Act("relu"), Dense(1))),
}


@pytest.mark.parametrize("name", NETS)
def test_network(name):
    net, rng = NETS[name], np.random.default_rng(3)
    check(net, rng.normal(size=(6, net.inputs)), rng.uniform(size=(6, net.outputs)))


@pytest.mark.parametrize("kind", ["sigmoid", "tanh"])
def test_recurrent(kind):
    net = SeqNet((2,), (Recurrent(1, kind, 1), Dense(1)))
    check(net, np.stack([RNN_STEPS[:6], RNN_STEPS[6:12]]), np.array([[1.0], [0.0]]))
    deep = SeqNet((2,), (Recurrent(2, kind, 3), Recurrent(1, "tanh", 2), Dense(2)))
    check(deep, np.random.default_rng(5).normal(size=(4, 5, 2)), np.full((4, 2), 0.3))


def test_recurrent_state_is_carried():
    net = SeqNet((2,), (Recurrent(1, "tanh", 2), Dense(1)))
    w = np.random.default_rng(2).normal(size=net.width)
    X = np.random.default_rng(4).normal(size=(1, 3, 2))
    other = X.copy()
    other[:, 0] += 1
    assert not np.allclose(net.score(X, w), net.score(other, w))


def test_tied_pool_cells_all_get_the_gradient():
    pool = Pool("max", (2,))
    x = np.array([[[1.0, 1.0, 0.5]]])
    y, kept = pool.forward(x, None)
    dx, _, _ = pool.backward(np.array([[[2.0, 3.0]]]), kept, None)
    assert y.tolist() == [[[1.0, 0.5]]] and dx.tolist() == [[[2.0, 2.0, 3.0]]]


def test_empty_centre_is_never_nearest():
    w = np.array([0.0, 0.0, 0.0, 2.0, 2.0, 2.0])  # first centre without points
    z, far = KMeans(2, 2).nearest(np.zeros((3, 2)), w)
    assert z.tolist() == [1, 1, 1] and np.allclose(far, np.sqrt(2))


def test_certain_but_wrong_loss_is_capped():
    loss = LR(1).loss(np.array([[1.0], [0.0], [1.0]]), np.array([[0.0], [1.0], [1.0]]))
    assert loss.tolist() == [100.0, 100.0, 0.0]
