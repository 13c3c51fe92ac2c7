"""Training: invariance, brute force on small rows, state handling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradframe.functions.models import LR, MLP, KMeans
from gradframe.operators import evaluation, gradients, kmeans, prep, priority, probing, training
from gradframe.plans import blockjoin, topk
from gradframe.sources import history, scores


def points(n=400, d=3, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = (X @ np.arange(1, d + 1) + rng.normal(size=n) > 0).astype(float)
    return X, y[:, None]


def frame(spark, X, Y, parts=3, seed=0):
    order = np.random.default_rng(seed).permutation(len(X))
    rows = [(int(i), X[i].tolist(), Y[i].tolist()) for i in order]
    return spark.createDataFrame(rows, "id bigint, x array<double>, y array<double>").repartition(parts)


def last_w(hist):
    return np.array(history.last(hist)["w"])


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_result_does_not_depend_on_partitions(spark, parts):
    X, Y = points()
    model, w = MLP((3, 2, 1)), np.linspace(-1, 1, 11)
    got = last_w(training.train(frame(spark, X, Y, parts, seed=parts), model, w, 0.5, steps=3))
    for _ in range(3):
        w = w - 0.5 * model.grad_sum(X, Y, w)[0] / len(X)
    assert np.allclose(got, w)


def test_narrow_and_wide_sums_agree(spark):
    X, Y = points(d=5)
    df, w = frame(spark, X, Y), np.linspace(-1, 1, 6)
    n, loss, g = gradients.reduce_gradient(df, LR(5), w)
    wide = gradients._partial_sums(df, LR(5), w).toPandas()
    assert n == wide["n"].sum() == 400
    assert np.isclose(loss, wide["loss"].sum()) and np.allclose(g, np.sum(wide["g"].tolist(), axis=0))


def test_batches_wrap(spark):
    X, Y = points(n=10)
    w = np.zeros(4)
    got = last_w(training.train(frame(spark, X, Y), LR(3), w, 0.5, batch=4, steps=4))
    for ids in ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 1], [2, 3, 4, 5]):
        w = w - 0.5 * LR(3).grad_sum(X[ids], Y[ids], w)[0] / 4
    assert np.allclose(got, w)


def test_stop_rules(spark):
    X, Y = points(n=50)
    out = training.train(frame(spark, X, Y), LR(3), np.zeros(4), 0.1, steps=9, stop=training.Stop(points=120), every=100)
    assert [r["iter"] for r in out.orderBy("iter").collect()] == [0, 3]


def test_start_normal_has_no_zero_and_repeats():
    w = training.start_normal(1000, seed=3)
    assert w.all() and (w == training.start_normal(1000, seed=3)).all()


def test_slice_filter_reaches_the_scan(spark, tmp_path):
    X, Y = points(n=50)
    frame(spark, X, Y).write.parquet(str(tmp_path / "p"))
    part = prep.batch_slice(spark.read.parquet(str(tmp_path / "p")), 10, 5, 50)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,10), LessThan(id,15)]" in plan


def test_shape_check(spark):
    X, Y = points(n=20)
    assert prep.check_shape(frame(spark, X, Y), 3, 1) == 20
    with pytest.raises(ValueError):
        prep.check_shape(frame(spark, X, Y), 4)


def test_scale_constant_column_and_wide_rows(spark):
    X = np.array([[1.0, 5.0], [3.0, 5.0], [2.0, 5.0]])
    out = prep.scale(frame(spark, X, np.array([[0.0], [4.0], [2.0]])), on_y=True).orderBy("id").collect()
    assert [list(r["x"]) for r in out] == [[-1.0, -1.0], [1.0, -1.0], [0.0, -1.0]]
    assert [r["y"][0] for r in out] == [-1.0, 1.0, 0.0]
    wide = np.random.default_rng(0).normal(size=(20, 80))
    got = prep.ranges(frame(spark, wide, np.zeros((20, 1)))).orderBy("j").toPandas()
    assert np.allclose(got["lo"], wide.min(axis=0)) and np.allclose(got["hi"], wide.max(axis=0))


def test_lloyd_never_raises_the_squared_objective(spark):
    X, Y = points(n=300)
    w0 = np.hstack([X[:4], np.ones((4, 1))]).ravel()
    log = kmeans.lloyd(frame(spark, X, Y), 4, 3, w0, 5).orderBy("iter").collect()
    costs = [(KMeans(4, 3).nearest(X, np.array(r["w"]))[1] ** 2).sum() for r in log]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))


def test_em_state_matches_parameter(spark):
    """After every batch the sums and counts are those of the current clusters."""
    X, Y = points(n=130)
    initial = lambda ids: ids % 3
    out, state = kmeans.train_em(frame(spark, X, Y), 3, 3, initial, 50, 7)
    z = state.orderBy("id").toPandas()["z"].to_numpy()
    want = np.zeros((3, 4))
    np.add.at(want, z, np.hstack([X, np.ones((130, 1))]))
    assert np.allclose(np.array(out.orderBy("iter").collect()[-1]["w"]).reshape(3, 4), want)


def test_evaluate_resumes_and_cuts_long_histories(spark, monkeypatch):
    X, Y = points(n=60)
    df = frame(spark, X, Y)
    h = history.rows(spark, [(i, i / 2, i, np.full(4, i / 10)) for i in range(7)])
    whole = evaluation.evaluate(df, LR(3), h, np.zeros(4)).orderBy("iter").toPandas()
    monkeypatch.setattr(blockjoin, "BLOCK_BYTES", 64)
    monkeypatch.setattr(blockjoin, "BROADCAST_BYTES", 0)
    done = whole[["iter"]].iloc[[0, 1, 4]]
    rest = evaluation.evaluate(df, LR(3), h, np.zeros(4), done=spark.createDataFrame(done)).orderBy("iter").toPandas()
    want = whole[~whole["iter"].isin([0, 1, 4])].reset_index(drop=True)
    assert np.allclose(rest.to_numpy(float), want.to_numpy(float))


# --- priorities ---------------------------------------------------------------


def top_ids(p, k):
    return np.lexsort((np.arange(len(p)), -p))[:k]


def test_all_points_on_top_is_gradient_descent(spark):
    X, Y = points(n=80)
    df, w0 = frame(spark, X, Y), np.full(4, 0.1)
    got, _ = priority.train_prioritised(df, LR(3), w0, 0.5, 1.0, 0.25, steps=3)
    assert np.allclose(last_w(got), last_w(training.train(df, LR(3), w0, 0.5, steps=3)))


@pytest.mark.parametrize(
    ("decay", "variation"),
    [("keep", ""), ("linear", "rla"), ("linear", "p"), ("quadratic", ""), ("quadratic", "rla")],
)
def test_prioritised_training_by_hand(spark, decay, variation):
    X, Y = points(n=90)
    w, n, k, renewed = np.full(4, 0.1), 90, 18, 60
    got, _ = priority.train_prioritised(
        frame(spark, X, Y), LR(3), w, 0.5, 0.2, 2 / 3, "length", "projection", decay, variation, 4
    )
    G = lambda: LR(3).grad_rows(X, Y, w)[0]
    mean = G().mean(axis=0)
    p = (G() ** 2).sum(axis=1)
    ver, a, b = np.zeros(n), np.zeros(n), np.full(n, -1.0)
    lr, d2, d1 = p.copy(), np.zeros(n), np.zeros(n)
    step_of = (renewed + k) // 32 if "p" in variation else 1
    now, at = step_of, 0

    def update(ids, fresh):
        for i in ids:
            gap, gap2 = now - ver[i], now**2 - ver[i] ** 2
            if decay == "keep":
                p[i] = fresh[i]
                continue
            if gap == 0:
                continue
            ratio = np.log(fresh[i] / p[i]) if p[i] != 0 and fresh[i] / p[i] > 0 else 0.0
            if decay == "linear":
                a[i] = 0.8 * ratio / gap + 0.2 * a[i]
            else:
                det = gap2 * d1[i] - gap * d2[i]
                if det == 0:
                    a[i], b[i] = 0.0, ratio / gap
                else:
                    na, nb = (ratio * d1[i] - lr[i] * gap) / det, (ratio * d2[i] - lr[i] * gap2) / -det
                    a[i], b[i] = 0.8 * na + 0.2 * a[i], 0.8 * nb + 0.2 * b[i]
                lr[i], d2[i], d1[i] = ratio, gap2, gap
            p[i], ver[i] = fresh[i], now

    def value():
        if decay == "keep":
            return p
        if decay == "linear":
            return p * np.exp(a * (now - ver))
        return p * np.exp(a * (now**2 - ver**2) + b * (now - ver))

    for _ in range(4):
        g = G()
        ids = (at + np.arange(renewed)) % n
        at = (at + renewed) % n
        update(ids, g @ mean)
        g1 = g[ids].sum(axis=0)
        mean = (1 - renewed / n) * mean + renewed / n * g1 / renewed
        top = top_ids(value(), k)
        if "l" in variation:
            update(top, g @ mean)
        g2 = g[top].sum(axis=0)
        if "a" in variation:
            mean = (1 - k / n) * mean + k / n * g2 / k
        now += step_of
        w = w - 0.5 * (g2 / k + (g1 / renewed if "r" in variation else 0))
    assert np.allclose(last_w(got), w)


@pytest.mark.parametrize("model,plans", [(LR(3), 0), (MLP((3, 2, 1)), 1)])
@pytest.mark.parametrize("block", [2, 150])
def test_block_sums_of_scattered_rows_take_one_pass(spark, model, plans, block):
    X, Y = points(n=400)
    w = np.linspace(-1, 1, model.width)
    got = priority._block_sums(frame(spark, X, Y), model, w, block)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == plans
    for r in got.collect():
        part = slice(r.block * block, (r.block + 1) * block)
        assert r.n == len(X[part]) and np.allclose(r.g, model.grad_sum(X[part], Y[part], w)[0])
    assert got.count() == -(-400 // block)


def test_block_and_decayed_mean_by_hand(spark):
    X, Y = points(n=100)
    df, w0 = frame(spark, X, Y), np.full(4, 0.1)
    hist, state, blocks = priority.train_block(df, LR(3), w0, 0.5, 0.1, 30, 0.25, True, batch=40, steps=3)
    dhist, _ = priority.train_decayed_mean(df, LR(3), w0, 0.5, 0.1, 0.7, 0.25, True, batch=40, steps=3)
    of = np.arange(100) // 30

    w = w0
    G = lambda: LR(3).grad_rows(X, Y, w)[0]
    means = np.array([G()[of == b].mean(axis=0) for b in range(4)])
    p = G() @ means.sum(axis=0)
    at = start = 0
    for _ in range(3):
        g, ids = G(), (at + np.arange(25)) % 100
        p[ids] = g[ids] @ means.sum(axis=0)
        for b in range(4):
            here = ids[of[ids] == b]
            if len(here):
                f = len(here) / 30
                means[b] = means[b] * (1 - f) + g[here].mean(axis=0) * f
        batch = (start + np.arange(40)) % 100
        order = np.lexsort((batch, -p[batch]))
        top = batch[order[:4]]
        p[top] = g[top] @ means.sum(axis=0)
        w = w - 0.5 * (g[ids].sum(axis=0) + g[top].sum(axis=0)) / 4
        at, start = (at + 25) % 100, (start + 40) % 100
    assert np.allclose(last_w(hist), w)
    assert np.allclose(state.orderBy("id").toPandas()["p"], p)
    assert np.allclose(np.array(blocks.orderBy("block").toPandas()["g"].tolist()), means)

    w = w0
    mean = G().mean(axis=0)
    p = G() @ mean
    at = start = 0
    for _ in range(3):
        g, ids = G(), (at + np.arange(25)) % 100
        p[ids] = g[ids] @ mean
        mean = 0.7 * mean + 0.3 * g[ids].mean(axis=0)
        batch = (start + np.arange(40)) % 100
        top = batch[np.lexsort((batch, -p[batch]))[:4]]
        p[top] = g[top] @ mean
        mean = 0.7 * mean + 0.3 * g[top].mean(axis=0)
        w = w - 0.5 * (g[ids].sum(axis=0) + g[top].sum(axis=0)) / 4
        at, start = (at + 25) % 100, (start + 40) % 100
    assert np.allclose(last_w(dhist), w)


def test_exact_variants_by_hand(spark):
    X, Y = points(n=60)
    df, w0 = frame(spark, X, Y), np.full(4, 0.1)
    w = w0
    for step in range(3):
        g = LR(3).grad_rows(X, Y, w)[0]
        batch = (step * 25 + np.arange(25)) % 60
        p = g @ g.mean(axis=0)
        top = batch[np.lexsort((batch, -p[batch]))[:5]]
        w = w - 0.5 * g[top].mean(axis=0)
    got = priority.train_exact(df, LR(3), w0, 0.5, 0.2, "projection", batch=25, steps=3)
    assert np.allclose(last_w(got), w)

    w = w0
    for step in range(2):
        g = LR(3).grad_rows(X, Y, w)[0]
        size = np.abs(g * g.sum(axis=0))
        order = np.lexsort((np.arange(240), -size.ravel()))[:48]
        delta = np.zeros(4)
        for j in range(4):
            mine = order[order % 4 == j]
            delta[j] = g.ravel()[mine].mean() if len(mine) else 0.0
        w = w - 0.5 * delta / 48
    got = priority.train_dimensions(df, LR(3), w0, 0.5, 0.2, steps=2)
    assert np.allclose(last_w(got), w)


def test_linear_decay_predicts_a_constant_slope_exactly(spark):
    rows = [(i, v, float(np.exp(0.3 * v))) for i in range(3) for v in range(60)]
    series = spark.createDataFrame(rows, "id bigint, ver bigint, p double")
    state = priority.fold_decay(series, priority.ExpLinear())
    ahead = state.select(priority.ExpLinear().at(F.lit(62)).alias("p")).collect()
    assert np.allclose([r["p"] for r in ahead], np.exp(0.3 * 62))


def test_wide_models_go_through_arrow_alike(spark):
    X, Y = points(n=70, d=20)
    w = np.linspace(-1, 1, 21)
    g = LR(20).grad_rows(X, Y, w)[0]
    df = frame(spark, X, Y)
    for how, want in (("length", (g * g).sum(axis=1)), ("projection", g @ g.mean(axis=0))):
        got = priority.priorities(df, LR(20), w, how).orderBy("id").toPandas()["p"]
        assert np.allclose(got, want)


def test_priority_log_and_resumed_sink(spark, tmp_path):
    X, Y = points(n=40)
    df = frame(spark, X, Y)
    priority.train_prioritised(df, LR(3), np.zeros(4), 0.5, 0.1, 0.1, steps=3, log=str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["iter"], r["n"]) for r in back.groupBy("iter").agg(F.count("*").alias("n")).collect()) == [
        (1, 40), (2, 40), (3, 40)
    ]
    scores.write_by_iter(back.unionByName(back.withColumn("iter", F.lit(9))), str(tmp_path / "log2"), done=back)
    assert [r["iter"] for r in spark.read.parquet(str(tmp_path / "log2")).select("iter").distinct().collect()] == [9]


def test_selection_is_used_beyond_the_heap(spark, monkeypatch):
    monkeypatch.setattr(topk, "HEAP_ROWS", 4)
    monkeypatch.setattr(topk, "HEAP_TOTAL", 4)
    X, Y = points(n=80)
    w = np.full(4, 0.1)
    got, _ = priority.train_prioritised(frame(spark, X, Y), LR(3), w, 0.5, 0.3, 0.1, steps=1)
    g = LR(3).grad_rows(X, Y, w)[0]
    top = top_ids((g * g).sum(axis=1), 24)
    assert np.allclose(last_w(got), w - 0.5 * g[top].mean(axis=0))


def test_probe_runs_every_size_from_one_start(spark):
    X, Y = points(n=100)
    w0 = np.full(4, 0.1)
    sizes = probing.halved(50, 10)
    got = probing.probe_batch_sizes(frame(spark, X, Y), LR(3), w0, 0.5, sizes, 50).orderBy("k").collect()
    assert sizes == [50, 25, 12] and [r["k"] for r in got] == [12, 25, 50]
    w = w0
    for step in range(2):
        ids = step * 25 + np.arange(25)
        w = w - 0.5 * LR(3).grad_sum(X[ids], Y[ids], w)[0] / 25
    assert np.isclose(got[1]["loss"], LR(3).grad_sum(X, Y, w)[1] / 100)
