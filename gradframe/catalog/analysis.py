"""Priority tables, runs, histories: windows, ranks and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import day_hist, ev, prio, r6, runs, sql, weights
from gradframe.functions.models import LR
from gradframe.operators import evaluation, gradients
from gradframe.operators import prio as pa
from gradframe.operators import runs as rn
from gradframe.plans.lineage import cut

LOGS = "SELECT iter, id, p, ln(p) AS y FROM prio"


@query(
    "w1_step_improvement",
    sql(
        "ev day_hist",
        """SELECT iter, round(sqrt(list_sum([(w[j]-coalesce(b[j], 0))*(w[j]-coalesce(b[j], 0)) FOR j IN [1,2,3]])), 6) + 0.0 AS delta
        FROM (SELECT iter, w, lag(w) OVER (ORDER BY iter) AS b FROM day_hist)""",
    ),
)
def step_improvement(spark, sf):
    return evaluation.improvements(day_hist(spark, sf)).select("iter", r6("delta").alias("delta"))


DIFF = """SELECT iter, id, round({e}, 6) + 0.0 AS d FROM (
    SELECT iter, id, p, lead(p, {s}) OVER (PARTITION BY id ORDER BY iter) AS q FROM prio)
    WHERE q IS NOT NULL AND iter % {t} = 0"""


@query("w3_priority_ratio", sql("prio", DIFF.format(e="p/q", s=1, t=1)))
def priority_ratio(spark, sf):
    return pa.diff(prio(spark, sf)).select("iter", "id", r6("d").alias("d"))


@query("j7_offset_difference", sql("prio", DIFF.format(e="(p-q)/5", s=5, t=2)))
def offset_difference(spark, sf):
    out = pa.diff(prio(spark, sf), step=5, stride=2, ratio=False, average=True)
    return out.select("iter", "id", r6("d").alias("d"))


@query(
    "w4_monotonic_trend",
    sql(
        "prio",
        """SELECT id FROM (SELECT id, CASE WHEN first > 0 THEN p*0.01 >= q ELSE p*0.01 <= q END AS ok FROM (
            SELECT id, p, lead(p) OVER w AS q, first_value(p) OVER w AS first FROM few
            WINDOW w AS (PARTITION BY id ORDER BY iter))) GROUP BY id HAVING coalesce(bool_and(ok), TRUE)""",
        few="SELECT iter % 3 AS iter, id * 10 + iter // 3 AS id, CASE WHEN id % 2 = 1 THEN p / 1e6 ** (iter % 3) ELSE p END AS p FROM prio",
    ),
)
def monotonic_trend(spark, sf):
    """Every series cut into runs of three, those of odd points made to fall; steps must fall below 1%."""
    rows = prio(spark, sf)
    day = F.pmod("iter", F.lit(3))
    falling = F.col("p") / F.pow(F.lit(1e6), day)
    few = rows.select(
        day.alias("iter"), (F.col("id") * 10 + F.floor(F.col("iter") / 3)).alias("id"),
        F.when(F.col("id") % 2 == 1, falling).otherwise(F.col("p")).alias("p"),
    )
    return pa.trend(few, 0.99)


CONTRIB = """SELECT iter, bin, round(cum/total, 6) + 0.0 AS share FROM (
    SELECT *, row_number() OVER (PARTITION BY iter ORDER BY p, id) AS r,
           sum(p) OVER (PARTITION BY iter ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS cum,
           count(*) OVER (PARTITION BY iter) AS m, sum(p) OVER (PARTITION BY iter) AS total FROM prio),
    (SELECT b::INT AS bin FROM range(1, 21) u(b))
    WHERE r = ((m - 1)*bin)//20 + 1"""


@query("w5_contribution_curve", sql("prio", CONTRIB))
def contribution_curve(spark, sf):
    return pa.contribution(prio(spark, sf), 20).select("iter", "bin", r6("share").alias("share"))


@query(
    "w6_log_trend",
    sql(
        "prio",
        """SELECT iter, id, round(y, 6) + 0.0 AS y,
        round(y - lag(y) OVER (PARTITION BY id ORDER BY iter), 6) + 0.0 AS dy FROM l""",
        l=LOGS,
    ),
)
def log_trend(spark, sf):
    return pa.log_trend(prio(spark, sf)).select("iter", "id", r6("y").alias("y"), r6("dy").alias("dy"))


FIT1 = """SELECT id, x, y - (y-y1)/(x-x1)*x AS c, (y-y1)/(x-x1) AS b, 0.0::DOUBLE AS a FROM (
    SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM sm WINDOW w AS (PARTITION BY id ORDER BY x))
    WHERE x1 IS NOT NULL"""
FIT2 = """SELECT id, x, y - a*x*x - b*x AS c, b, a FROM (SELECT *, s1 - a*(x+x1) AS b FROM (
    SELECT *, (s1-s2)/(x-x2) AS a FROM (SELECT *, (y-y1)/(x-x1) AS s1, (y1-y2)/(x1-x2) AS s2 FROM (
    SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2
    FROM sm WINDOW w AS (PARTITION BY id ORDER BY x)) WHERE x2 IS NOT NULL)))"""
SAMPLES = "SELECT id, iter AS x, y FROM l WHERE iter % 5 = 0"


def _fit_columns(df):
    return df.select("id", F.col("x").cast("int").alias("x"), r6("c").alias("c"), r6("b").alias("b"), r6("a").alias("a"))


FIT_OUT = "SELECT id, x, round(c, 6) + 0.0 AS c, round(b, 6) + 0.0 AS b, round(a, 6) + 0.0 AS a FROM f"


@query("w7_piecewise_line", sql("prio", FIT_OUT, l=LOGS, sm=SAMPLES, f=FIT1))
def piecewise_line(spark, sf):
    return _fit_columns(pa.fit(prio(spark, sf), 5, 1))


@query("w7_piecewise_parabola", sql("prio", FIT_OUT, l=LOGS, sm=SAMPLES, f=FIT2))
def piecewise_parabola(spark, sf):
    return _fit_columns(pa.fit(prio(spark, sf), 5, 2))


def _mse_sql(degree, fit):
    return sql(
        "prio",
        f"""SELECT {degree} AS degree, round(avg(pow(a*t*t + b*t + c - v, 2)), 6) + 0.0 AS mse, count(*) AS n
        FROM (SELECT id, iter::DOUBLE AS t, y AS v, ((iter-1)//5*5)::INT AS x FROM l WHERE iter >= 1) r
        JOIN f ON f.id = r.id AND f.x = r.x""",
        l=LOGS, sm=SAMPLES, f=fit,
    )


FIT0 = "SELECT id, x, y AS c, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a FROM sm"


@query(
    "a14_fit_residual",
    " UNION ALL ".join(f"SELECT * FROM ({_mse_sql(d, f)})" for d, f in enumerate((FIT0, FIT1, FIT2))),
)
def fit_residual(spark, sf):
    rows = prio(spark, sf)
    out = None
    for degree in (0, 1, 2):
        error = pa.fit_error(rows, pa.fit(rows, 5, degree), 5)
        one = error.select(F.lit(degree).alias("degree"), r6("mse").alias("mse"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "w8_global_line_fit",
    sql(
        "prio",
        """SELECT id, round(regr_slope(y, iter), 6) + 0.0 AS b, round(regr_intercept(y, iter), 6) + 0.0 AS c,
        round(regr_syy(y, iter) - regr_sxy(y, iter)*regr_slope(y, iter), 6) + 0.0 AS sse FROM l GROUP BY id""",
        l=LOGS,
    ),
)
def global_line_fit(spark, sf):
    return pa.line_fit(prio(spark, sf)).select("id", r6("b").alias("b"), r6("c").alias("c"), r6("sse").alias("sse"))


@query(
    "w8_global_parabola_fit",
    sql(
        "prio",
        """SELECT id, round(ym - a*s2/n - b*14.5 + a*14.5*14.5, 6) + 0.0 AS c,
        round(b - 29*a, 6) + 0.0 AS b, round(a, 6) + 0.0 AS a
        FROM (SELECT *, t2/(s4 - s2*s2/n) AS a, t1/s2 AS b FROM (
        SELECT id, avg(y) AS ym, count(*) AS n, sum(u*u) AS s2, sum(u*u*u*u) AS s4, sum(u*y) AS t1,
               sum(u*u*y) - sum(u*u)*avg(y) AS t2
        FROM (SELECT id, y, iter - 14.5::DOUBLE AS u FROM l) GROUP BY id))""",
        l=LOGS,
    ),
)
def global_parabola_fit(spark, sf):
    return pa.parabola_fit(prio(spark, sf)).select("id", r6("c").alias("c"), r6("b").alias("b"), r6("a").alias("a"))


@query(
    "a13_histogram",
    sql(
        "prio",
        """SELECT iter, bin, n, round(n/sum(n) OVER (PARTITION BY iter), 6) + 0.0 AS pdf,
        round(sum(n) OVER (PARTITION BY iter ORDER BY bin)/sum(n) OVER (PARTITION BY iter), 6) + 0.0 AS cdf
        FROM (SELECT iter, least(floor((p-lo)/((hi-lo)/25)), 24)::INT AS bin, count(*) AS n
              FROM prio, (SELECT min(p) AS lo, max(p) AS hi FROM prio) GROUP BY 1, 2)""",
    ),
)
def histogram(spark, sf):
    out = pa.histogram(prio(spark, sf), "p", 25)
    return out.select("iter", "bin", "n", r6("pdf").alias("pdf"), r6("cdf").alias("cdf"))


@query(
    "a13_gradient_distribution",
    sql(
        "ev w3",
        """SELECT bin, n, round(n/sum(n) OVER (), 9) + 0.0 AS pdf,
        round(sum(n) OVER (ORDER BY bin)/sum(n) OVER (), 9) + 0.0 AS cdf
        FROM (SELECT least(floor((g-lo)/((hi-lo)/30)), 29)::INT AS bin, count(*) AS n
              FROM c, (SELECT min(g) AS lo, max(g) AS hi FROM c) GROUP BY 1)""",
        c="""SELECT (p-y)*xx[j] AS g FROM (SELECT y, list_append(x, 1.0::DOUBLE) AS xx,
        1/(1+exp(-(list_dot_product(x, w[1:3]) + w[4]))) AS p FROM ev, w3), range(1, 5) t(j)""",
    ),
)
def gradient_distribution(spark, sf):
    graded = gradients.gradients(ev(spark, sf), LR(3), weights(4), keep=[])
    out = pa.histogram(graded.select(F.explode("g").alias("g")), "g", 30, by=None)
    nine = [(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("pdf", "cdf")]
    return out.select("bin", "n", *nine)


RANKED = "SELECT *, row_number() OVER (PARTITION BY iter ORDER BY p DESC, id) AS r FROM prio"
OVERLAP = """SELECT a.iter, k.k::INT AS k,
    round(sum(CASE WHEN a.r <= k AND b.r <= k THEN 1 ELSE 0 END)/sum(CASE WHEN a.r <= k OR b.r <= k THEN 1 ELSE 0 END), 6) + 0.0 AS jaccard
    FROM ranked a JOIN ranked b ON b.id = a.id AND b.iter = 3, range({lo}, {hi}) k(k) GROUP BY a.iter, k.k"""


@query("k4_top_overlap", sql("prio", OVERLAP.format(lo=20, hi=21), ranked=RANKED))
def top_overlap(spark, sf):
    return pa.overlap(prio(spark, sf), 3, [20]).select("iter", "k", r6("jaccard").alias("jaccard"))


@query("k5_overlap_curve", sql("prio", OVERLAP.format(lo=1, hi=100), ranked=RANKED))
def overlap_curve(spark, sf):
    out = pa.overlap(prio(spark, sf), 3, list(range(1, 100)))
    return out.select("iter", "k", r6("jaccard").alias("jaccard"))


CUMS = """SELECT *, sum(p) OVER (PARTITION BY iter ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS cum,
    count(*) OVER (PARTITION BY iter) AS m, sum(p) OVER (PARTITION BY iter) AS total FROM ranked"""


@query(
    "k6_top_share",
    sql(
        "prio",
        """SELECT iter, top, round(cum/total, 6) + 0.0 AS share FROM c,
        (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.25]) AS top) WHERE r = m - floor((1.0::DOUBLE - top)*m)""",
        ranked=RANKED, c=CUMS,
    ),
)
def top_share(spark, sf):
    out = pa.top_share(prio(spark, sf), [0.01, 0.05, 0.1, 0.25])
    return out.select("iter", "top", r6("share").alias("share"))


@query(
    "k7_top_mean",
    sql(
        "prio",
        """SELECT iter, bin, round(cum/r, 6) + 0.0 AS mean FROM c, (SELECT b::INT AS bin FROM range(1, 11) u(b))
        WHERE r = ((m - 1)*bin)//10 + 1""",
        ranked=RANKED, c=CUMS,
    ),
)
def top_mean(spark, sf):
    return pa.top_mean(prio(spark, sf), 10).select("iter", "bin", r6("mean").alias("mean"))


@query(
    "k8_by_deviation",
    sql(
        "prio",
        """SELECT id, round(gap, 6) + 0.0 AS gap, row_number() OVER (ORDER BY round(gap, 9), id) AS rank
        FROM (SELECT id, abs(y - avg(y) OVER ()) AS gap FROM l WHERE iter = 5)""",
        l=LOGS,
    ),
)
def by_deviation(spark, sf):
    return pa.by_deviation(prio(spark, sf), 5).select("id", r6("gap").alias("gap"), "rank")


@query(
    "k9_top_per_key",
    """SELECT user_id, event_id, rank FROM (SELECT user_id, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 3""",
)
def top_per_key(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    return pa.top_per_key(e, "user_id", "value", "event_id", 3).select("user_id", "event_id", "rank")


@query(
    "k9_latest_then_top",
    """SELECT user_id, value, event_id FROM events WHERE event_id IN
    (SELECT max(event_id) FROM events GROUP BY user_id) ORDER BY value DESC, user_id LIMIT 50""",
)
def latest_then_top(spark, sf):
    """The newest value of every user, then the 50 largest of these."""
    from gradframe.plans.topk import top_k

    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    newest = pa.latest(e, "user_id", "event_id")
    return top_k(newest, 50, "value", "user_id").select("user_id", "value", "event_id")


# --- runs ---------------------------------------------------------------------

REACHED = "SELECT run, min(time) FILTER (loss <= 4) AS reached FROM runs GROUP BY run"


@query("w9_time_to_target", sql("runs", f"SELECT run, round(reached, 6) + 0.0 AS reached FROM ({REACHED})"))
def time_to_target(spark, sf):
    return rn.time_to_target(runs(spark, sf), 4.0).select("run", r6("reached").alias("reached"))


FOUR = """SELECT run, max(time) FILTER (r = 1) AS x1, max(time) FILTER (r = 2) AS x2, max(time) FILTER (r = 3) AS x3,
    max(time) FILTER (r = 4) AS x4, max(loss) FILTER (r = 1) AS v1, max(loss) FILTER (r = 2) AS v2,
    max(loss) FILTER (r = 3) AS v3, max(loss) FILTER (r = 4) AS v4
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iter DESC) AS r FROM runs) WHERE r <= 4 GROUP BY run"""
SLOPES = """SELECT *, least(r2/r1, 1) AS a, (x3-x1+x4-x2)/2 AS dx FROM (
    SELECT *, (v4-v2)/(x4-x2) AS r1, (v3-v1)/(x3-x1) AS r2 FROM four)"""


@query(
    "w10_extrapolated_linear",
    sql(
        "runs",
        """SELECT m.run, round(coalesce(reached, x1 + (0.5-v1)/((r1+r2)/2)), 6) + 0.0 AS reached
        FROM m JOIN s ON s.run = m.run""",
        m=REACHED.replace("<= 4", "<= 0.5"), four=FOUR, s=SLOPES,
    ),
)
def extrapolated_linear(spark, sf):
    out = rn.time_to_target(runs(spark, sf), 0.5, "linear")
    return out.select("run", r6("reached").alias("reached"))


@query(
    "w10_extrapolated_geometric",
    sql(
        "runs",
        """SELECT m.run, round(coalesce(reached, CASE WHEN a = 1 THEN x1 + (0.5-v1)/((r1+r2)/2)
            WHEN 1 - (0.5-v1)/a/r2/dx*(1-a) <= 0 OR a <= 0 THEN NULL
            ELSE x1 + dx*ln(1 - (0.5-v1)/a/r2/dx*(1-a))/ln(a) END), 6) + 0.0 AS reached
        FROM m JOIN s ON s.run = m.run""",
        m=REACHED.replace("<= 4", "<= 0.5"), four=FOUR, s=SLOPES,
    ),
)
def extrapolated_geometric(spark, sf):
    out = rn.time_to_target(runs(spark, sf), 0.5, "exp")
    return out.select("run", r6("reached").alias("reached"))


@query(
    "w11_progress",
    sql(
        "runs",
        """SELECT run, iter, round((max(loss) OVER () - loss)/(max(loss) OVER () - min(loss) OVER ()), 6) + 0.0 AS overall,
        round((h - loss)/nullif(h - l, 0), 6) + 0.0 AS own
        FROM (SELECT *, max(loss) OVER (PARTITION BY run) AS h, min(loss) OVER (PARTITION BY run) AS l FROM runs)""",
    ),
)
def progress(spark, sf):
    rows = rn.progress(runs(spark, sf)).withColumnRenamed("progress", "overall")
    both = rn.progress(rows, per_run=True)
    return both.select("run", "iter", r6("overall").alias("overall"), r6("progress").alias("own"))


@query(
    "w12_strip_overhead",
    sql(
        "runs",
        """SELECT run, iter, round(time - (CASE WHEN last = 0 THEN 0 ELSE iter*2.0/last END + 0.25), 6) + 0.0 AS time
        FROM (SELECT *, max(iter) OVER (PARTITION BY run) AS last FROM runs)""",
    ),
)
def strip_overhead(spark, sf):
    return rn.strip_overhead(runs(spark, sf), 2.0, 0.25).select("run", "iter", r6("time").alias("time"))


@query(
    "w15_densify",
    sql(
        "runs",
        """SELECT run, iter, i::INT AS i, round(time + (t2-time)*i/3, 6) + 0.0 AS time, round(loss + (l2-loss)*i/3, 6) + 0.0 AS loss
        FROM (SELECT *, lead(time) OVER w AS t2, lead(loss) OVER w AS l2 FROM runs
              WINDOW w AS (PARTITION BY run ORDER BY iter)), range(3) r(i) WHERE t2 IS NOT NULL""",
    ),
)
def densify(spark, sf):
    out = rn.densify(runs(spark, sf), 3)
    return out.select("run", "iter", "i", r6("time").alias("time"), r6("loss").alias("loss"))


@query(
    "p11_first_columns",
    sql("runs", "SELECT run, round(loss, 6) + 0.0 AS loss FROM runs ORDER BY iter, run LIMIT 500"),
)
def first_columns(spark, sf):
    return rn.first_columns(runs(spark, sf), 500, ["run", "loss"]).select("run", r6("loss").alias("loss"))


TIMES = "SELECT run // 5 AS grp, (run % 5 + 1)::INT AS workers, reached FROM (" + REACHED + ")"


def _times(spark, sf):
    met = rn.time_to_target(runs(spark, sf), 4.0)
    return met.select(
        F.floor(F.col("run") / 5).alias("grp"), (F.pmod("run", F.lit(5)) + 1).cast("int").alias("workers"), "reached"
    )


@query(
    "j6_relative_to_reference",
    sql(
        "runs",
        """SELECT t.grp, t.workers, round(t.reached/nullif(r.reached, 0), 6) + 0.0 AS relative
        FROM t JOIN t r ON r.grp = t.grp AND r.workers = 1""",
        t=TIMES,
    ),
)
def relative_to_reference(spark, sf):
    t = cut(_times(spark, sf))  # read twice
    out = rn.relative_to(t, t.where(F.col("workers") == 1), ["grp"])
    return out.select("grp", "workers", r6("relative").alias("relative"))


@query(
    "h2_time_to_target_table",
    sql(
        "runs",
        """SELECT run % 5 AS slow, count(*) AS runs, count(reached) AS met, round(avg(reached), 6) + 0.0 AS mean
        FROM m GROUP BY 1""",
        m=REACHED,
    ),
)
def target_table(spark, sf):
    met = rn.time_to_target(runs(spark, sf), 4.0)
    return met.groupBy(F.pmod("run", F.lit(5)).alias("slow")).agg(
        F.count("*").alias("runs"), F.count("reached").alias("met"), r6(F.avg("reached")).alias("mean")
    )


SPEED = "SELECT t.grp, t.workers, r.reached/nullif(t.reached, 0) AS s FROM t JOIN t r ON r.grp = t.grp AND r.workers = 1"


@query(
    "h3_scaling_table",
    sql("runs", "SELECT grp, workers, round(s, 6) + 0.0 AS speedup FROM sp", t=TIMES, sp=SPEED),
)
def scaling_table(spark, sf):
    return rn.scaling(_times(spark, sf), 1).select("grp", "workers", r6("speedup").alias("speedup"))


@query(
    "h3_scaling_line",
    sql(
        "runs",
        """SELECT grp, round(regr_slope(s, workers), 6) + 0.0 AS slope,
        round(regr_intercept(s, workers), 6) + 0.0 AS intercept FROM sp GROUP BY grp
        HAVING count(s) > 1""",
        t=TIMES, sp=SPEED,
    ),
)
def scaling_line(spark, sf):
    out = rn.scaling_line(rn.scaling(_times(spark, sf), 1))
    return out.where(F.col("slope").isNotNull()).select(
        "grp", r6("slope").alias("slope"), r6("intercept").alias("intercept")
    )
