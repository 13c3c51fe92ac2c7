"""Streams over several files: the same as the batches one after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradframe.functions.models import LR
from gradframe.operators import updates
from gradframe.sources import history
from gradframe.streaming import online, reports
from tests.test_training import points

SCHEMA = "x array<double>, y array<double>"


@pytest.fixture()
def files(spark, tmp_path):
    """Four files of different size, in order of arrival."""
    X, Y = points(n=100)
    cuts = [0, 10, 40, 70, 100]
    for a, b in zip(cuts, cuts[1:]):
        rows = [(X[i].tolist(), Y[i].tolist()) for i in range(a, b)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), [(X[a:b], Y[a:b]) for a, b in zip(cuts, cuts[1:])]


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("gap", [0, 2])
def test_stream_equals_batches(spark, tmp_path, files, gap):
    path, batches = files
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    online.stream_train(stream(spark, path), LR(3), np.zeros(4), 0.5, out, mark, gap=gap).awaitTermination()
    versions = [np.zeros(4)]
    for X, Y in batches:
        old = versions[max(len(versions) - 1 - gap, 0)]
        versions.append(versions[-1] - 0.5 * LR(3).grad_sum(X, Y, old)[0] / len(X))
    got = history.read(spark, out).orderBy("iter").collect()
    assert [r["n"] for r in got] == [0, 10, 40, 70, 100]
    assert np.allclose([r["w"] for r in got], versions)
    sizes = online.batch_sizes(spark, out).orderBy("iter").collect()
    assert [r["points"] for r in sizes] == [10, 30, 30, 30]


def test_restart_goes_on_and_replay_changes_nothing(spark, tmp_path, files):
    path, _ = files
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda mark: online.stream_train(
        stream(spark, path), LR(3), np.zeros(4), 0.5, out, mark, gap=1
    ).awaitTermination()
    run(mark)
    before = sorted(map(str, history.read(spark, out).collect()))
    run(mark)  # nothing new
    assert sorted(map(str, history.read(spark, out).collect())) == before
    # the last batch comes again, as after a failure between its version and its commit
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run(mark)
    assert sorted(map(str, history.read(spark, out).collect())) == before


def test_other_checkpoint_over_versions(spark, tmp_path, files):
    path, _ = files
    out = str(tmp_path / "out")
    run = lambda mark, **how: online.stream_train(
        stream(spark, path), LR(3), np.zeros(4), 0.5, out, str(tmp_path / mark), **how
    ).awaitTermination()
    run("one")
    with pytest.raises(ValueError, match="another checkpoint"):
        run("two")
    run("two", go_on=True)
    run("two", go_on=True)
    got = history.read(spark, out).orderBy("iter").collect()
    assert [r["iter"] for r in got] == list(range(9))
    assert [r["n"] for r in got] == [0, 10, 40, 70, 100, 110, 140, 170, 200]


def test_report_state_over_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 400
    worker = np.where(rng.uniform(size=n) < 0.6, 0, rng.integers(1, 5, n))
    rows = [(i, int(worker[i]), int(rng.integers(1, 6)), float(rng.uniform()), float(rng.uniform())) for i in range(n)]
    schema = "seq bigint, worker bigint, n bigint, t_point double, loss double"
    for a in range(0, n, 100):
        spark.createDataFrame(rows[a : a + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        reports.run_to_table(
            reports.report_state(source, 50), str(tmp_path / "out"), str(tmp_path / "mark")
        ).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = spark.read.parquet(str(tmp_path / "out"))
    got = {r["worker"]: r for r in reports.current(table).collect()}
    fires = {r["worker"]: r["f"] for r in table.groupBy("worker").agg(F.sum("fires").alias("f")).collect()}
    for w in range(5):
        mine = [r for r in rows if r[1] == w]
        ema = mine[0][3]
        for r in mine:
            ema = 0.2 * ema + 0.8 * r[3]
        total = sum(r[2] for r in mine)
        assert got[w]["reports"] == len(mine) and got[w]["points"] == total and fires[w] == total // 50
        assert np.isclose(got[w]["t_point"], ema) and np.isclose(got[w]["loss"], sum(r[4] for r in mine))


def test_update_fold_of_averaged_deltas_is_gradient_descent(spark):
    """Four workers' deltas with factor 1/4 give the step over all rows."""
    X, Y = points(n=80)
    start = np.full(4, 0.1)
    rows = []
    for k in range(4):
        d = -0.5 * LR(3).grad_sum(X[k::4], Y[k::4], start)[0] / 20
        rows += [(k, 0, j, float(v)) for j, v in enumerate(d)]
    deltas = spark.createDataFrame(rows, "seq bigint, iter int, j int, d double")
    params = spark.createDataFrame([(j, float(v)) for j, v in enumerate(start)], "j int, w double")
    want = start - 0.5 * LR(3).grad_sum(X, Y, start)[0] / 80
    last = updates.fold_updates(deltas, params, 0.25).where("seq = 3").orderBy("j").toPandas()["w"]
    assert np.allclose(last, want)
    once = updates.fold_by_iteration(deltas, params, 0.25).orderBy("j").toPandas()["w"]
    assert np.allclose(once, want)


@pytest.mark.parametrize("compat", [False, True])
def test_rate_folds_row_by_row(spark, compat):
    rng = np.random.default_rng(1)
    rows = [(0, i, int(rng.integers(1, 9)), float(rng.uniform(0.5, 1))) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, points bigint, interval double")
    got = updates.rate_by_portion(df, ["k"], ["t"], 7.0, compat).orderBy("t").collect()
    r, s = 100.0, 0.01
    for row, (_, _, points_, interval) in zip(got, rows):
        r = (r + points_ / interval) / 2
        s = (s + (r * 7.0 if compat else 7.0 / r)) / 2
        assert np.isclose(row["rate"], r) and np.isclose(row["next_interval"], s)


def test_interleaved_files_give_the_same_average(spark, tmp_path):
    rows = [(i, 0, 1, float(i * i % 17), 1.0) for i in range(40)]
    schema = "seq bigint, worker bigint, n bigint, t_point double, loss double"
    out = []
    for name, parts in (("whole", [rows]), ("mixed", [rows[1::2], rows[0::2]])):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
        target = str(tmp_path / name / "out")
        reports.run_to_table(reports.report_state(source, 5), target, str(tmp_path / name / "mark")).awaitTermination()
        out.append(reports.current(spark.read.parquet(target)).first())
    assert out[0]["t_point"] == pytest.approx(out[1]["t_point"]) and out[0]["reports"] == out[1]["reports"] == 40
