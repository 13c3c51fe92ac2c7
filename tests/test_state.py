"""State that outlives a step or a run: segments by id, snapshots beside an archive, resumed loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradframe.functions.models import LR, MLP, KMeans
from gradframe.functions.network import Act, Conv, Dense, Net
from gradframe.operators import evaluation, hidden, kmeans, prep, priority, probing, training
from gradframe.operators.progress import Keeping, Stop
from gradframe.plans import blockjoin, segments
from gradframe.plans.segments import Segments, spans
from gradframe.sources import history, snapshots
from tests.test_training import frame, last_w, points


def rows_of(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in values.items()], "id bigint, p double")


def test_segments_hold_the_newest_rows(spark, tmp_path, monkeypatch):
    """Random changes of ranges and of scattered rows, with merges of neighbours in between."""
    monkeypatch.setattr(segments, "LIMIT", 4)
    monkeypatch.setattr(segments, "MERGED", 3)
    rng, total = random.Random(3), 60
    table, want = Segments(spark, str(tmp_path)), {i: 0 for i in range(total)}
    table.replace([(0, total)], rows_of(spark, want))
    versions = []
    for step in range(1, 11):
        if step % 4 == 0:
            new = {i: step for i in rng.sample(range(total), 5)}
            table.patch(rows_of(spark, new), len(new))
        else:
            ranges = spans(rng.randrange(total), rng.randint(1, 25), total)
            new = {i: step for lo, hi in ranges for i in range(lo, hi)}
            table.replace(ranges, rows_of(spark, new))
        want.update(new)
        assert {r.id: r.p for r in table.read().collect()} == want, step
        part = [(5, 20), (50, 60)]
        assert {r.id: r.p for r in table.read(part).collect()} == {i: v for i, v in want.items() if 5 <= i < 20 or i >= 50}
        assert len(table.live) <= 4 and [s[1] for s in table.live[:-1]] == [s[0] for s in table.live[1:]]
        versions.append((table.version(), dict(want)))
    older = Segments(spark, str(tmp_path)).at(versions[-3][0])
    assert {r.id: r.p for r in older.read().collect()} == versions[-3][1]
    table.drop()
    assert {r.id: r.p for r in table.read().collect()} == want
    assert {p.name for p in tmp_path.iterdir()} == {p.rsplit("/", 1)[-1] for p in table.paths()}


def test_a_step_writes_its_slice_only(spark, tmp_path):
    table = Segments(spark, str(tmp_path))
    table.replace([(0, 1000)], spark.range(1000).withColumn("p", F.lit(0.0)))
    for k in range(5):
        ranges = spans(900 + 50 * k, 50, 1000)
        table.replace(ranges, table.read(ranges).withColumn("p", F.col("p") + 1))
    assert table.written == 1000 + 5 * 50
    assert table.read().agg(F.sum("p")).first()[0] == 250


def both(straight, resumed):
    a, b = (h.orderBy("iter").toPandas() for h in (straight, resumed))
    assert list(a["iter"]) == list(b["iter"])
    assert np.allclose(np.array(a["w"].tolist()), np.array(b["w"].tolist()))
    assert "n" not in a or list(a["n"]) == list(b["n"])


@pytest.mark.parametrize("rule, gap", [("gd", 0), ("momentum", 0), ("adam", 0), ("adam", 2)])
def test_resumed_training_equals_straight(spark, tmp_path, rule, gap):
    X, Y = points(n=50)
    df, w0, path = frame(spark, X, Y), np.full(4, 0.1), str(tmp_path / "a")
    run = lambda steps, **more: training.train(df, LR(3), w0, 0.2, batch=20, steps=steps, optimizer=rule, gap=gap, **more)
    straight = run(4)
    for steps in (2, 2):
        resumed = run(steps, archive=path, resume=True)
    both(straight, resumed)
    with pytest.raises(ValueError, match="optimizer"):
        training.train(df, LR(3), w0, 0.2, batch=10, optimizer=rule, gap=gap, archive=path, resume=True)


def test_state_without_its_record_is_not_looked_at(spark, tmp_path):
    """A run that ends between the two writes leaves a state that a later run passes over."""
    X, Y = points(n=40)
    df, w0, path = frame(spark, X, Y), np.full(4, 0.1), str(tmp_path / "a")
    run = lambda steps, **more: training.train(df, LR(3), w0, 0.2, steps=steps, optimizer="momentum", **more)
    run(2, archive=path)
    snapshots.save(spark, path, snapshots.Snapshot(9, {"points": 0}, {"w": np.zeros(4)}))
    both(run(4), run(2, archive=path, resume=True))


def test_stale_gradients(spark):
    X, Y = points(n=60)
    df, w0 = frame(spark, X, Y), np.full(4, 0.1)
    for gap in (0, 1, 3):
        versions = [w0]
        for _ in range(5):
            g = LR(3).grad_sum(X, Y, versions[max(len(versions) - 1 - gap, 0)])[0] / 60
            versions.append(versions[-1] - 0.5 * g)
        assert np.allclose(last_w(training.train(df, LR(3), w0, 0.5, steps=5, gap=gap)), versions[-1])


@pytest.mark.parametrize("decay, variation", [("linear", "pa"), ("quadratic", "rl")])
def test_resumed_prioritised_training(spark, tmp_path, decay, variation):
    X, Y = points(n=60)
    df, w0, path = frame(spark, X, Y), np.full(4, 0.1), str(tmp_path / "a")
    run = lambda steps, **more: priority.train_prioritised(
        df, LR(3), w0, 0.5, 0.2, 0.4, "length", "projection", decay, variation, steps, **more
    )
    straight, state = run(3)
    for steps in (1, 2):
        resumed, again = run(steps, keeping=Keeping(path, resume=True))
    both(straight, resumed)
    p, q = (s.orderBy("id").toPandas().to_numpy(float) for s in (state, again))
    assert np.allclose(p, q, equal_nan=True)


def test_resumed_variants_and_em(spark, tmp_path):
    X, Y = points(n=60)
    df, w0 = frame(spark, X, Y), np.full(4, 0.1)
    block = lambda steps, **more: priority.train_block(df, LR(3), w0, 0.5, 0.1, 15, 0.25, True, batch=24, steps=steps, **more)[0]
    mean = lambda steps, **more: priority.train_decayed_mean(df, LR(3), w0, 0.5, 0.1, 0.7, 0.25, True, batch=24, steps=steps, **more)[0]
    em = lambda steps, **more: kmeans.train_em(df, 3, 3, lambda ids: ids % 3, 25, steps, **more)[0]
    for name, run in (("block", block), ("mean", mean), ("em", em)):
        path = str(tmp_path / name)
        run(1, keeping=Keeping(path))
        both(run(3), run(2, keeping=Keeping(path, resume=True)))


def test_stop_rules_hold_in_every_loop(spark, tmp_path):
    X, Y = points(n=50)
    df, w0 = frame(spark, X, Y), np.full(4, 0.1)
    keeping = Keeping(stop=Stop(steps=2), every=2)
    hist, _ = priority.train_prioritised(df, LR(3), w0, 0.5, 0.2, 0.4, steps=9, keeping=keeping)
    assert [r.iter for r in hist.orderBy("iter").collect()] == [0, 2, 3]
    log, _ = kmeans.train_em(df, 3, 3, lambda ids: ids % 3, 25, 9, Keeping(stop=Stop(points=60)))
    assert [r.iter for r in log.orderBy("iter").collect()] == [0, 1, 2, 3]


def test_em_merges_the_segments_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(segments, "LIMIT", 5)
    monkeypatch.setattr(segments, "MERGED", 3)
    X, Y = points(n=48)
    out, state = kmeans.train_em(frame(spark, X, Y), 3, 3, lambda ids: ids % 3, 6, 9)
    z = state.orderBy("id").toPandas()["z"].to_numpy()
    want = np.zeros((3, 4))
    np.add.at(want, z, np.hstack([X, np.ones((48, 1))]))
    assert np.allclose(np.array(out.orderBy("iter").collect()[-1]["w"]).reshape(3, 4), want)


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError, match="repeated"):
        prep.numbered_rows(spark.createDataFrame([(0,), (0,), (2,)], "id bigint"))
    with pytest.raises(ValueError, match="repeated"):
        prep.numbered_rows(spark.createDataFrame([(0,), (0,), (3,), (3,)], "id bigint"))


def test_measures_without_row_gradients():
    """Lengths and projections by layer equal those of whole gradients, in pieces too."""
    rng = np.random.default_rng(4)
    X, Y = rng.normal(size=(40, 6)), rng.integers(0, 2, (40, 2)).astype(float)
    nets = [MLP((6, 5, 3, 2)), MLP((6, 2), True), LR(6), Net((6,), (Conv(2, (3,)), Act("tanh"), Dense(2)))]
    for model in nets:
        y = Y[:, : model.outputs]
        w, d = rng.normal(size=model.width), rng.normal(size=model.width)
        G, loss = model.grad_rows(X, y, w)
        for direction, want in ((None, (G * G).sum(axis=1)), (d, G @ d)):
            p, g, lost = model.measures(X, y, w, direction)
            assert np.allclose(p, want) and np.allclose(g, G.sum(axis=0)) and np.isclose(lost, loss.sum())


def test_wide_networks_fit_a_small_worker():
    """Ten thousand rows of a 784-300-10 network: their gradients would take 19 GB."""
    import tracemalloc

    rng = np.random.default_rng(5)
    model = MLP((784, 300, 10))
    X, Y, w = rng.random((10_000, 784)), np.zeros((10_000, 10)), rng.normal(0, 0.05, model.width)
    tracemalloc.start()
    p, g, _ = model.measures(X, Y, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and len(p) == 10_000 and len(g) == model.width
    G, _ = model.grad_rows(X[:20], Y[:20], w)
    assert np.allclose(p[:20], (G * G).sum(axis=1))


def test_plan_does_not_grow_with_the_history(spark):
    X, Y = points(n=30)
    df = frame(spark, X, Y)
    plans = []
    for records in (3, 400):
        h = history.rows(spark, [(i, 0.0, i, np.full(4, i / 500)) for i in range(records)])
        out = evaluation.evaluate(df, LR(3), h, np.zeros(4))
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert out.count() == records
    assert plans[0] == plans[1]


@pytest.mark.parametrize("limit", [0, blockjoin.BROADCAST_BYTES])
def test_every_row_meets_every_record_once(spark, monkeypatch, limit):
    monkeypatch.setattr(blockjoin, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(blockjoin, "BLOCK_BYTES", 256)
    X, Y = points(n=70)
    df = frame(spark, X, Y)
    h = history.rows(spark, [(i, 0.0, i, np.full(4, i / 50)) for i in range(40)])
    for how in ("length", "projection"):
        got = evaluation.priority_history(df, LR(3), h, how).toPandas()
        assert len(got) == 70 * 40 and not got.duplicated(["iter", "id"]).any()
        for i in (0, 17, 39):
            G = LR(3).grad_rows(X, Y, np.full(4, i / 50))[0]
            want = (G * G).sum(axis=1) if how == "length" else G @ G.mean(axis=0)
            assert np.allclose(got[got["iter"] == i].sort_values("id")["p"], want)


def test_rows_meet_broadcast_records_in_one_python_stage(spark):
    """Packed rows would go to Python twice, the second time in batches of many blocks."""
    X, Y = points(n=20)
    h = history.rows(spark, [(i, 0.0, i, np.full(4, i / 5)) for i in range(3)])
    plan = probing.batch_losses(frame(spark, X, Y), LR(3), h, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_batch_losses(spark):
    X, Y = points(n=50)
    h = history.rows(spark, [(i, 0.0, i, np.full(4, i / 5)) for i in range(3)])
    got = probing.batch_losses(frame(spark, X, Y), LR(3), h, 20).collect()
    assert sorted((r.version, r.batch, r.n) for r in got) == [(v, b, (20, 20, 10)[b]) for v in range(3) for b in range(3)]
    for r in got:
        part = slice(20 * r.batch, 20 * r.batch + 20)
        assert np.isclose(r.loss, LR(3).grad_sum(X[part], Y[part], np.full(4, r.version / 5))[1])


def test_em_of_one_batch_is_lloyd(spark):
    """With all rows in a batch the moved sums are those of the new clusters."""
    X, Y = points(n=40)
    out, state = kmeans.train_em(frame(spark, X, Y), 2, 3, lambda ids: ids % 2, None, 2)
    w = np.array(out.orderBy("iter").collect()[1]["w"])
    z = state.orderBy("id").toPandas()["z"].to_numpy()
    assert (KMeans(2, 3).nearest(X, w)[0] == z).all()


def test_soft_mixture_keeps_its_statistics(spark, tmp_path):
    """Batch by batch the statistics are those of the present shares, and whole passes raise the likelihood."""
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(c, 0.5, (30, 2)) for c in (0, 3, 6)])
    df, model = frame(spark, X, np.zeros((90, 1))), hidden.Mixture(3, 2)
    start = lambda ids, X: np.where(ids[:, None] % 3 == np.arange(3), 0.6, 0.2)
    run = lambda batch, steps, **more: hidden.train_hidden(df, model, start, batch, steps, **more)
    out, states = run(40, 3)
    Z = np.array(states.orderBy("id").toPandas()["z"].tolist())
    assert np.allclose(out.orderBy("iter").collect()[-1]["w"], model.maximise(model.collect(X, Z)))
    for steps in (1, 2):
        again, _ = run(40, steps, keeping=Keeping(str(tmp_path / "a"), resume=True))
    both(out, again)
    whole, _ = run(None, 6)
    losses = [r.loss for r in whole.orderBy("iter").collect()[1:]]
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0]


@pytest.mark.parametrize("decay", [priority.ExpLinear(), priority.ExpQuadratic()])
def test_decay_of_a_point_with_most_rows(spark, decay):
    """What the newest renewals give is what the whole series gives, step by step."""
    rng = np.random.default_rng(7)
    values = {0: rng.random(400) + 0.5, 1: rng.random(3) + 0.5, 2: rng.random(1) + 0.5}
    rows = [(i, v, float(p)) for i, ps in values.items() for v, p in enumerate(ps)] + [(0, 399, 9.0)]
    df = spark.createDataFrame(rows, "id bigint, ver bigint, p double")
    got = {r.id: r for r in priority.fold_decay(df, decay).collect()}
    whole = spark.createDataFrame([(i, 0, float(ps[0])) for i, ps in values.items()], "id bigint, ver bigint, p double")
    state = whole.select("id", *priority.named(decay, decay.initial(F.col("p"), F.col("ver"))))
    start = {r.id: r for r in state.collect()}
    for i, ps in values.items():
        p, a, b, rate, total = ps[0], 0.0, -1.0, None, None
        for v in range(1, len(ps)):
            slope = np.log(ps[v] / p)
            if "b" not in decay.columns:
                a = 0.8 * slope + 0.2 * a
            elif rate is None:
                a, b = 0.0, slope
            else:
                bend = (slope - rate) / 2
                a, b = 0.8 * bend + 0.2 * a, 0.8 * (slope - bend * (2 * v - 1)) + 0.2 * b
            p, rate = ps[v], slope
        assert np.isclose(got[i].a, a) and np.isclose(got[i].p, p) and got[i].ver == len(ps) - 1
        assert "b" not in decay.columns or np.isclose(got[i].b, b)
    assert set(start) == set(got)
