"""Update logs, reports, probing, streams, generated rows, words, networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import (
    deltas,
    emb,
    ev,
    metrics,
    r6,
    reports,
    scratch,
    sigmoid_sql,
    sql,
    table,
    weights,
)
from gradframe.functions.models import LR
from gradframe.operators import datagen, probing, text, training, updates
from gradframe.streaming import online, reports as stream_reports

P3 = sigmoid_sql("x", "w", 3)
EXT = "list_append(x, 1.0::DOUBLE)"
W3 = weights(4)


# --- folds in order -----------------------------------------------------------


@query(
    "w2_moving_average",
    sql(
        "reports",
        """SELECT worker, round(list_reduce(list(t_point ORDER BY seq), lambda a, b: 0.2*a + 0.8*b), 6) + 0.0 AS t_point,
        round(list_reduce(list(t_delta ORDER BY seq), lambda a, b: 0.2*a + 0.8*b), 6) + 0.0 AS t_delta
        FROM reports GROUP BY worker""",
    ),
)
def moving_average(spark, sf):
    """The average after each worker's last report."""
    rows = updates.ema(reports(spark, sf), ["worker"], ["seq"], {"a": "t_point", "b": "t_delta"})
    last = rows.groupBy("worker").agg(F.max_by(F.struct("a", "b"), "seq").alias("e"))
    return last.select("worker", r6("e.a").alias("t_point"), r6("e.b").alias("t_delta"))


@query(
    "w13_iteration_time",
    sql(
        "reports",
        """SELECT * FROM (SELECT seq, worker, micros - lag(micros) OVER
        (PARTITION BY worker ORDER BY micros, seq) AS dt FROM reports) WHERE dt IS NOT NULL""",
    ),
)
def iteration_time(spark, sf):
    out = updates.iteration_time(reports(spark, sf), "worker", "micros", ["micros", "seq"])
    return out.select("seq", "worker", "dt").where(F.col("dt").isNotNull())


@query(
    "w14_online_loss",
    sql(
        "reports",
        """SELECT round(list_reduce(list_prepend(0.0::DOUBLE, list(loss ORDER BY seq)), lambda a, b: a*7/8 + b), 6) + 0.0 AS online,
        count(*) AS n FROM reports""",
    ),
)
def online_loss(spark, sf):
    rows = updates.online_loss(reports(spark, sf), ["seq"], 8)
    return rows.agg(r6(F.max_by("online", "seq")).alias("online"), F.count("*").alias("n"))


@query(
    "w14_last_loss_per_source",
    sql("reports", "SELECT worker, round(arg_max(loss, seq), 6) + 0.0 AS loss FROM reports GROUP BY worker"),
)
def last_loss(spark, sf):
    out = updates.last_per_source(reports(spark, sf), "worker", ["seq"], "loss")
    return out.select("worker", r6("loss").alias("loss"))


@query(
    "w16_update_fold",
    sql(
        "deltas w3",
        """SELECT seq, worker, j, round(w[j+1] + sum(0.25*d) OVER (PARTITION BY j ORDER BY seq), 6) + 0.0 AS w
        FROM deltas, w3""",
    ),
)
def update_fold(spark, sf):
    start = spark.createDataFrame([(j, float(v)) for j, v in enumerate(W3)], "j int, w double")
    return updates.fold_updates(deltas(spark, sf), start, 0.25).select("seq", "worker", "j", r6("w").alias("w"))


@query(
    "t2_bounded_staleness",
    sql(
        "deltas w3",
        """SELECT iter, j, round(any_value(w[j+1]) + sum(sum(0.25*d)) OVER (PARTITION BY j ORDER BY iter), 6) + 0.0 AS w
        FROM (SELECT *, dense_rank() OVER (PARTITION BY worker ORDER BY seq) - 1 AS iter FROM deltas), w3
        GROUP BY iter, j""",
    ),
)
def bounded_staleness(spark, sf):
    """Deltas wait for their worker's iteration number and are applied together."""
    rows = deltas(spark, sf)
    once = rows.where(F.col("j") == 0).select("seq", "worker")
    numbered = updates.per_worker_order(once, "worker", ["seq"]).select("seq", "iter")
    start = spark.createDataFrame([(j, float(v)) for j, v in enumerate(W3)], "j int, w double")
    out = updates.fold_by_iteration(rows.join(numbered, "seq"), start, 0.25)
    return out.select("iter", "j", r6("w").alias("w"))


def _rate_sql(sample, target, first, cap, out, compat):
    """Both folds at once, as one recursion over each worker's rows."""
    want = f"r2*{target}" if compat else f"{target}/r2"
    new = f"(s + {want})/2"
    if cap is not None:
        new = f"least({new}, {cap})"
    return sql(
        "metrics",
        f"SELECT seq, worker, round(r, 6) + 0.0 AS rate, round(s, 6) + 0.0 AS {out} FROM f WHERE i > 0",
        recursive=True,
        o="SELECT *, row_number() OVER (PARTITION BY worker ORDER BY seq) AS i FROM metrics",
        f=f"""SELECT worker, 0::BIGINT AS i, 0::BIGINT AS seq, {first}::DOUBLE AS r, 0.01::DOUBLE AS s
            FROM (SELECT DISTINCT worker FROM metrics)
        UNION ALL SELECT worker, i, seq, r2, {new} FROM (
            SELECT o.worker, o.i, o.seq, (f.r + {sample})/2 AS r2, f.s
            FROM f JOIN o ON o.worker = f.worker AND o.i = f.i + 1)""",
    )


@query("w17_portion_estimator", _rate_sql("o.points/o.interval", 50, 100.0, None, "next_interval", False))
def portion_estimator(spark, sf):
    out = updates.rate_by_portion(metrics(spark, sf), ["worker"], ["seq"], 50.0)
    return out.select("seq", "worker", r6("rate").alias("rate"), r6("next_interval").alias("next_interval"))


@query("w17_improve_estimator", _rate_sql("o.improve/o.interval", 0.2, 0.01, 1.0, "next_interval", False))
def improve_estimator(spark, sf):
    out = updates.rate_by_improvement(metrics(spark, sf), ["worker"], ["seq"], 0.2, 1.0)
    return out.select("seq", "worker", r6("rate").alias("rate"), r6("next_interval").alias("next_interval"))


@query(
    "w17_balance_estimator",
    sql(
        "metrics",
        "SELECT seq, worker, round(s, 6) + 0.0 AS next_interval FROM f WHERE i > 0",
        recursive=True,
        o="""SELECT *, row_number() OVER w AS i,
            coalesce(lag(improve, 1) OVER w, 0) + coalesce(lag(improve, 2) OVER w, 0) AS g,
            coalesce(lag("interval", 1) OVER w, 0.01) + coalesce(lag("interval", 2) OVER w, 0.01) AS t
            FROM metrics WINDOW w AS (PARTITION BY worker ORDER BY seq)""",
        f="""SELECT worker, 0::BIGINT AS i, 0::BIGINT AS seq, 0.01::DOUBLE AS y, 0.01::DOUBLE AS s
            FROM (SELECT DISTINCT worker FROM metrics)
        UNION ALL SELECT o.worker, o.i, o.seq, (f.y + o.sync)/2,
            CASE WHEN improve/("interval" + sync) > g/(t + f.y*2) THEN f.s + t/2 ELSE least(t/2, f.s) END
            FROM f JOIN o ON o.worker = f.worker AND o.i = f.i + 1""",
    ),
)
def balance_estimator(spark, sf):
    out = updates.rate_by_balance(metrics(spark, sf), ["worker"], ["seq"], 2)
    return out.select("seq", "worker", r6("next_interval").alias("next_interval"))


@query(
    "a15_run_statistics",
    sql(
        "reports",
        """SELECT worker, count(*) AS reports, sum(n)::BIGINT AS points, round(sum(n*t_point), 4) + 0.0 AS work,
        round(sum(t_delta), 4) + 0.0 AS wait, round(sum(n*t_point)/sum(n)*1000, 4) + 0.0 AS work_per_k,
        round(sum(t_delta)/sum(n)*1000, 4) + 0.0 AS wait_per_k,
        round(sum(n*t_point)/(sum(n*t_point) + sum(t_delta)), 6) + 0.0 AS busy FROM reports GROUP BY worker""",
    ),
)
def run_statistics(spark, sf):
    out = updates.run_statistics(reports(spark, sf))
    four = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("work", "wait", "work_per_k", "wait_per_k")]
    return out.select("worker", "reports", "points", *four, r6("busy").alias("busy"))


@query(
    "a16_report_rollup",
    sql(
        "reports",
        """SELECT seq, points, round(loss_sum, 4) + 0.0 AS loss_sum, (points//1000 > (points - n)//1000)::INT AS fires
        FROM (SELECT seq, n, sum(n) OVER (ORDER BY seq)::BIGINT AS points, sum(loss) OVER (ORDER BY seq) AS loss_sum FROM reports)""",
    ),
)
def report_rollup(spark, sf):
    out = updates.report_rollup(reports(spark, sf), ["seq"], 1000)
    return out.select("seq", "points", (F.round("loss_sum", 4) + F.lit(0.0)).alias("loss_sum"), "fires")


# --- batch size probing -------------------------------------------------------

PROBES = """SELECT (64*pow(2, u))::BIGINT AS k, g/(1 + u*u/20) AS gain FROM (
    SELECT user_id % 8 AS u, round(avg(value), 6) AS g FROM events GROUP BY 1)"""
F1 = "(SELECT {m} FROM (SELECT avg(t_point) AS p FROM reports GROUP BY worker))"
F2 = "(SELECT avg(d) FROM (SELECT avg(t_delta) AS d FROM reports GROUP BY worker))"


def _probes(spark, sf):
    u = F.pmod("user_id", F.lit(8))
    means = table(spark, sf, "events").groupBy(u.alias("u")).agg(F.round(F.avg("value"), 6).alias("g"))
    return means.select(
        (F.lit(64) * F.pow(F.lit(2.0), "u")).cast("bigint").alias("k"),
        (F.col("g") / (1 + F.col("u") * F.col("u") / 20)).alias("gain"),
    )


def _best_sql(mean):
    return sql(
        "reports",
        """SELECT k, round(gain/(f1 + f2*20/k), 6) + 0.0 AS rate FROM p, t
        ORDER BY gain/(f1 + f2*20/k) DESC, k LIMIT 1""",
        p=PROBES,
        t=f"SELECT {F1.format(m=mean)} AS f1, {F2} AS f2",
    )


def _best(spark, sf, harmonic, cuts=0):
    t = probing.timings(reports(spark, sf), harmonic).first()
    return probing.best_batch_size(_probes(spark, sf), t["f1"], t["f2"] * 20, cuts)


@query("h7_best_batch_size", _best_sql("count(*)/sum(1/p)"))
def best_batch_size(spark, sf):
    return _best(spark, sf, True).select("k", r6("rate").alias("rate"))


@query("h7_best_batch_size_plain_mean", _best_sql("avg(p)"))
def best_batch_size_plain(spark, sf):
    return _best(spark, sf, False).select("k", r6("rate").alias("rate"))


@query(
    "h7_best_batch_size_interpolated",
    sql(
        "reports",
        """SELECT k, round(gain/(f1 + f2*20/k), 6) + 0.0 AS rate FROM c, t
        ORDER BY gain/(f1 + f2*20/k) DESC, k LIMIT 1""",
        p=PROBES,
        t=f"SELECT {F1.format(m='count(*)/sum(1/p)')} AS f1, {F2} AS f2",
        b="SELECT k FROM p, t ORDER BY gain/(f1 + f2*20/k) DESC, k LIMIT 1",
        s="""SELECT * FROM (SELECT k AS ka, gain AS ga, lead(k) OVER (ORDER BY k) AS kb, lead(gain) OVER (ORDER BY k) AS gb FROM p)
            WHERE ka = (SELECT k FROM b) OR kb = (SELECT k FROM b)""",
        c="""SELECT floor(ka + (kb-ka)*i/10)::BIGINT AS k, ga + (gb-ga)*i/10 AS gain FROM s, range(11) r(i) WHERE kb IS NOT NULL""",
    ),
)
def best_batch_size_cut(spark, sf):
    return _best(spark, sf, True, cuts=10).select("k", r6("rate").alias("rate"))


def _probe_sql() -> str:
    """Three sizes with one, two and four steps, each step written out."""
    mean_loss = "avg(CASE WHEN y = 0 THEN -ln(1-p) ELSE -ln(p) END)"
    steps, ends = {"n": "SELECT count(*) AS c FROM events"}, []
    for s in range(3):
        k, last = f"(SELECT c//{2 ** (s + 1)} FROM n)", "w3"
        for i in range(2**s):
            steps[f"g{s}{i}"] = (
                f"SELECT [(p-y)*v FOR v IN {EXT}] AS g, w FROM (SELECT *, {P3} AS p FROM ev, {last})"
                f" WHERE id >= {i}*{k} AND id < {i + 1}*{k}"
            )
            steps[f"q{s}{i}"] = (
                "SELECT list(nw ORDER BY j) AS w FROM (SELECT j, any_value(w[j]) - 0.5*avg(g[j]) AS nw"
                f" FROM g{s}{i}, range(1, 5) t(j) GROUP BY j)"
            )
            last = f"q{s}{i}"
        ends.append(f"SELECT {k} AS k, {mean_loss} AS loss FROM (SELECT y, {P3} AS p FROM ev, {last})")
    before = f"SELECT {mean_loss} AS loss FROM (SELECT y, {P3} AS p FROM ev, w3)"
    text = f"""SELECT k, round(e.loss, 6) + 0.0 AS loss, round(b.loss - e.loss, 6) + 0.0 AS gain
        FROM ({" UNION ALL ".join(ends)}) e, ({before}) b"""
    return sql("ev w3", text, **steps)


@query("h5_batch_size_probe", _probe_sql())
def batch_size_probe(spark, sf):
    rows = ev(spark, sf)
    n = rows.count()
    sizes = probing.halved(n // 2, n // 10)
    out = probing.probe_batch_sizes(rows, LR(3), W3, 0.5, sizes, n // 2)
    return out.select("k", r6("loss").alias("loss"), r6("gain").alias("gain"))


@query(
    "h5_probe_losses",
    sql(
        "ev w3",
        """SELECT k, round(loss, 6) + 0.0 AS loss FROM (
        SELECT any_value(k) AS k, avg(CASE WHEN y = 0 THEN -ln(1-p) ELSE -ln(p) END) AS loss FROM (
        SELECT k, y, 1/(1+exp(-(list_dot_product(x, v[1:3]) + v[4]))) AS p FROM ev, q))""",
        n="SELECT count(*) AS c FROM events",
        g=f"SELECT y, [(p-y)*v FOR v IN {EXT}] AS g, w FROM (SELECT *, {P3} AS p FROM ev, w3) WHERE id < (SELECT c//2 FROM n)",
        q="""SELECT list(nw ORDER BY j) AS v, (SELECT c//2 FROM n) AS k FROM (
        SELECT j, any_value(w[j]) - 0.5*avg(g[j]) AS nw FROM g, range(1, 5) t(j) GROUP BY j)""",
    ),
)
def probe_losses(spark, sf):
    """One size: half the rows in one step."""
    rows = ev(spark, sf)
    half = rows.count() // 2
    out = probing.probe_batch_sizes(rows, LR(3), W3, 0.5, [half], half)
    return out.select("k", r6("loss").alias("loss"))


def _gain_sql():
    """Training with two batch sizes written out, then every batch under every version."""
    loss = "(CASE WHEN y = 0 THEN -ln(1-p) ELSE -ln(p) END)"
    parts, tables = {}, []
    for batches in (2, 4):
        k = f"(SELECT count(*)//{batches} FROM events)"
        parts[f"q{batches}0"] = "SELECT w FROM w3"
        for i in range(batches):
            parts[f"q{batches}{i + 1}"] = f"""SELECT list(nw ORDER BY j) AS w FROM (
                SELECT j, any_value(w[j]) - 0.5*avg((p-y)*xx[j]) AS nw FROM (SELECT id, y, w, {EXT} AS xx, {P3} AS p FROM ev, q{batches}{i}),
                range(1, 5) t(j) WHERE id >= {i}*{k} AND id < {i + 1}*{k} GROUP BY j)"""
        for v in range(batches + 1):
            tables.append(f"""SELECT {k} AS k, {v} AS v, id // {k} AS b, {batches} AS last, count(*) AS n, sum({loss}) AS loss
                FROM (SELECT id, y, {P3} AS p FROM ev, q{batches}{v}) WHERE id < {batches}*{k} GROUP BY b""")
    parts["l"] = " UNION ALL ".join(tables)
    return sql(
        "ev w3",
        """SELECT k, round(sum(loss) FILTER (v = b AND b = 0)/sum(n) FILTER (v = b AND b = 0)
            - sum(loss) FILTER (v = b AND b = last - 1)/sum(n) FILTER (v = b AND b = last - 1), 6) + 0.0 AS drift,
        round((sum(loss) FILTER (v = 0) - sum(loss) FILTER (v = b))/sum(n) FILTER (v = b), 6) + 0.0 AS start,
        round((sum(loss) FILTER (v = b) - sum(loss) FILTER (v = b + 1))/sum(n) FILTER (v = b), 6) + 0.0 AS next,
        round((sum(loss) FILTER (v = b) - sum(loss) FILTER (v = last))/sum(n) FILTER (v = b), 6) + 0.0 AS "end"
        FROM l GROUP BY k""",
        **parts,
    )


@query("h6_gain_estimates", _gain_sql())
def gain_estimates(spark, sf):
    """Halves and quarters of the rows as batches; each batch's loss under every version of its run."""
    rows, out = ev(spark, sf), None
    total = rows.count()
    for batches in (2, 4):
        k = total // batches
        versions = training.train(rows, LR(3), W3, 0.5, batch=k, steps=batches)
        table_ = probing.batch_losses(rows.where(F.col("id") < batches * k), LR(3), versions, k)
        out = table_ if out is None else out.unionByName(table_)
    got = probing.gain_estimates(out)
    return got.select("k", *[r6(c).alias(c) for c in ("drift", "start", "next", "end")])


# --- streams ------------------------------------------------------------------


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _rate_of_rows(read, newest, where):
    """The newest parameter moved by the mean gradient that some rows have at the one read."""
    return f"""SELECT list(nw ORDER BY j) AS w FROM (
        SELECT j, any_value(n.w[j]) - 0.5*avg((p-y)*xx[j]) AS nw
        FROM (SELECT y, {EXT} AS xx, {P3} AS p FROM ev JOIN events ON id = event_id, {read} WHERE {where}) g, {newest} n, range(1, 5) t(j) GROUP BY j)"""


def _stale_sql(gaps, steps, where):
    """Steps written out, with gradients taken some versions back; ``where`` gives the rows of a step."""
    parts, found = {}, []
    for gap in gaps:
        parts[f"q{gap}_0"] = "SELECT w FROM w3"
        for i in range(1, steps + 1):
            parts[f"q{gap}_{i}"] = _rate_of_rows(f"q{gap}_{max(i - 1 - gap, 0)}", f"q{gap}_{i - 1}", where(i))
            found.append(f"SELECT {gap} AS gap, {i} AS step, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w FROM q{gap}_{i}, range(1, 5) t(j)")
    return sql("ev w3", " UNION ALL ".join(found), **parts)


def _long(versions):
    out = versions.where(F.col("iter") > 0).select(F.col("iter").alias("step"), F.posexplode("w").alias("j", "w"))
    return out.withColumn("w", r6("w"))


@query("t2_stale_training", _stale_sql((0, 1, 2), 4, lambda i: "TRUE"))
def stale_training(spark, sf):
    """Gradients of the newest version, of the one before and of the one before that."""
    rows, out = ev(spark, sf), None
    for gap in (0, 1, 2):
        one = _long(training.train(rows, LR(3), W3, 0.5, steps=4, gap=gap)).withColumn("gap", F.lit(gap))
        out = one if out is None else out.unionByName(one)
    return out


QUARTERS = 4


def _arriving(spark, sf, part, parts):
    """The events as a stream of ``parts`` files that arrive one after the other; ``part`` numbers them from 0."""
    events, path = table(spark, sf, "events"), scratch(spark)
    for k in range(parts):
        events.where(part(events) == k).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    x = F.array(F.col("value") / 561, F.hour("ts") / 24, F.pmod("user_id", F.lit(10)) / 10)
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), x.alias("x"), F.array((F.col("event_type") == "purchase").cast("double")).alias("y")
    )


def _by_id(events):
    return F.floor(F.col("event_id") * QUARTERS / F.lit(events.count()))


def _quarter(i):
    return f"floor(event_id*{QUARTERS}/(SELECT count(*) FROM events)) = {i - 1}"


def _streamed(spark, sf, gap):
    path = scratch(spark)
    run = online.stream_train(_arriving(spark, sf, _by_id, QUARTERS).select("x", "y"), LR(3), W3, 0.5, path, scratch(spark), gap=gap)
    run.awaitTermination()
    return _long(online.history.read(spark, path)).withColumn("gap", F.lit(gap))


@query("t1_stream_training", _stale_sql((0,), QUARTERS, _quarter))
def stream_training(spark, sf):
    """A quarter of the events in each of four micro-batches, each of which gives one update."""
    return _streamed(spark, sf, 0)


@query("t2_stale_stream_training", _stale_sql((1, 2), QUARTERS, _quarter))
def stale_stream_training(spark, sf):
    """Gradients one and two versions old, once there are as many."""
    return _streamed(spark, sf, 1).unionByName(_streamed(spark, sf, 2))


BOX_DAYS, BOXES = 5, 5


def _box(i):
    return f"datediff('day', DATE '2024-01-01', ts::DATE)//{BOX_DAYS} = {i - 1}"


@query(
    "t5_time_boxed_step",
    _stale_sql((0,), BOXES, _box).replace("SELECT 0 AS gap, ", "SELECT ")
)
def time_boxed_step(spark, sf):
    """Boxes of five days; three files of ten days each; the last box is still open when the stream ends."""
    path = scratch(spark)
    days = lambda events: F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 10)
    run = online.stream_train_boxes(
        _arriving(spark, sf, days, 3), LR(3), W3, 0.5, path, scratch(spark), "ts", f"{BOX_DAYS} days", "1 hour", start="3 days"
    )
    run.awaitTermination()
    return _long(online.history.read(spark, path))


@query(
    "t3_report_state",
    sql(
        "reports",
        """SELECT worker, max(seq) AS seq, count(*) AS reports, sum(n)::BIGINT AS points, round(sum(loss), 4) + 0.0 AS loss,
        round(list_reduce(list(t_point ORDER BY seq), lambda a, b: 0.2*a + 0.8*b), 6) + 0.0 AS t_point,
        (sum(n)//500)::BIGINT AS fires FROM reports GROUP BY worker""",
    ),
)
def report_state(spark, sf):
    v = F.col("value")
    stream = _stream(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.pmod("user_id", F.lit(8)).alias("worker"),
        (F.lit(1) + F.pmod("event_id", F.lit(5))).alias("n"),
        (v / 1000).alias("t_point"),
        (v / 10).alias("loss"),
    )
    path = scratch(spark)
    stream_reports.run_to_table(
        stream_reports.report_state(stream, 500), path, scratch(spark)
    ).awaitTermination()
    rows = spark.read.parquet(path)
    fires = rows.groupBy("worker").agg(F.sum("fires").alias("fires"))
    return stream_reports.current(rows).drop("fires").join(fires, "worker").select(
        "worker", "seq", "reports", "points", (F.round("loss", 4) + F.lit(0.0)).alias("loss"), r6("t_point").alias("t_point"), "fires"
    )


# --- generated rows -----------------------------------------------------------

SEED = 11
U = """((((((({id} % 2147483647 + {s1})*48271) % 2147483647) + ({j})*7919 + 1)*40692 % 2147483399) + {s})*48271
    % 2147483647 + 0.5::DOUBLE)/2147483647"""


def _u(j):
    return "(" + U.format(id="id", j=j, s=SEED, s1=SEED + 1) + ")"


def _n(j):
    return f"(sqrt(-2*ln({_u(f'({j})*2')}))*cos(2*pi()*{_u(f'({j})*2+1')}))"


EV_IDS = "SELECT event_id AS id FROM events"


def _ids(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"))


@query(
    "d1_labelled_rows",
    sql(
        "w3",
        f"""SELECT id, (j-1)::INT AS j, round(x[j] + e[j], 6) + 0.0 AS x, CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS y
        FROM (SELECT *, {P3} AS p FROM (SELECT id, [2*{_u(0)}-1, 2*{_u(1)}-1, 2*{_u(2)}-1] AS x,
              [0.1*{_n(3)}, 0.1*{_n(4)}, 0.1*{_n(5)}] AS e FROM ids), w3), range(1, 4) t(j)""",
        ids=EV_IDS,
    ),
)
def labelled_rows(spark, sf):
    out = datagen.generate_rows(_ids(spark, sf), LR(3), W3, 0.1, SEED)
    return out.select("id", F.get("y", F.lit(0)).alias("y"), F.posexplode("x").alias("j", "x")).withColumn("x", r6("x"))


CENTRES = """SELECT list(m ORDER BY cls) AS m FROM (SELECT cls, [round(avg(x[1]), 9), round(avg(x[2]), 9), round(avg(x[3]), 9)] AS m FROM emb GROUP BY cls)"""


def _centres(spark, sf):
    """Class means of the first three coordinates: ten rows."""
    means = emb(spark, sf).groupBy("cls").agg(
        *[F.round(F.avg(F.get("x", F.lit(j))), 9).alias(f"m{j}") for j in range(3)]
    )
    return np.array([r[1:] for r in sorted(map(tuple, means.collect()))])


@query(
    "d3_cluster_rows",
    sql(
        "emb",
        f"""SELECT id, c, (j-1)::INT AS j, round(m[c+1][j] + 0.2*(CASE j WHEN 1 THEN {_n(1)} WHEN 2 THEN {_n(2)} ELSE {_n(3)} END), 6) + 0.0 AS x
        FROM (SELECT id, least(floor({_u(0)}*10), 9)::INT AS c FROM ids), cen, range(1, 4) t(j)""",
        ids=EV_IDS, cen=CENTRES,
    ),
)
def cluster_rows(spark, sf):
    out = datagen.generate_blobs(_ids(spark, sf), _centres(spark, sf), 0.2, SEED)
    return out.select("id", "c", F.posexplode("x").alias("j", "x")).withColumn("x", r6("x"))


@query(
    "d4_uneven_clusters",
    sql(
        "emb",
        f"""SELECT id, c, (j-1)::INT AS j, round(m[c+1][j] + d*(2*(CASE j WHEN 1 THEN {_u(2)} WHEN 2 THEN {_u(3)} ELSE {_u(4)} END)-1), 6) + 0.0 AS x
        FROM (SELECT id, (({_u(0)} >= 10/55) ::INT + ({_u(0)} >= 19/55)::INT + ({_u(0)} >= 27/55)::INT + ({_u(0)} >= 34/55)::INT
              + ({_u(0)} >= 40/55)::INT + ({_u(0)} >= 45/55)::INT + ({_u(0)} >= 49/55)::INT + ({_u(0)} >= 52/55)::INT
              + ({_u(0)} >= 54/55)::INT)::INT AS c, 0.01 + 0.5*{_u(1)} AS d FROM ids), cen, range(1, 4) t(j)""",
        ids=EV_IDS, cen=CENTRES,
    ),
)
def uneven_clusters(spark, sf):
    out = datagen.generate_uneven(_ids(spark, sf), _centres(spark, sf), np.arange(10, 0, -1), SEED)
    return out.select("id", "c", F.posexplode("x").alias("j", "x")).withColumn("x", r6("x"))


@query(
    "d5_noise_columns",
    sql(
        "",
        f"""SELECT id, 1.5::DOUBLE AS none, round(1 - ln({_u(0)})/2, 6) + 0.0 AS exp, round(0.5 + 2*{_n(1)}, 6) + 0.0 AS norm,
        round(-1 + 4*{_u(5)}, 6) + 0.0 AS uni FROM ids""",
        ids=EV_IDS,
    ),
)
def noise_columns(spark, sf):
    of = lambda *a, **k: datagen.noise("id", *a, seed=SEED, **k)
    return _ids(spark, sf).select(
        "id",
        of("none", (), 1.5).alias("none"),
        r6(of("exp", (2.0,), 1.0)).alias("exp"),
        r6(of("norm", (0.5, 2.0), stream=1)).alias("norm"),
        r6(of("uni", (-1.0, 3.0), stream=5)).alias("uni"),
    )


# --- words --------------------------------------------------------------------

TOKENS = r"""SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (
    SELECT doc_id, string_split_regex(lower(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')), '[ \t\n\r\f\x0B]+') AS ws FROM documents))
    WHERE word <> ''"""
WORDS = """SELECT word, row_number() OVER (ORDER BY f) - 1 AS word_id FROM (
    SELECT word, min({'d': doc_id, 'p': pos}) AS f FROM tok GROUP BY word)"""


@query("x1_dictionary", sql("", "SELECT word_id, word FROM words", tok=TOKENS, words=WORDS))
def dictionary(spark, sf):
    return text.dictionary(table(spark, sf, "documents"))


@query(
    "x2_bag_of_words",
    sql("", "SELECT doc_id, word_id, count(*) AS cnt FROM tok JOIN words USING (word) GROUP BY 1, 2", tok=TOKENS, words=WORDS),
)
def bag_of_words(spark, sf):
    return text.bag_of_words(table(spark, sf, "documents"))
