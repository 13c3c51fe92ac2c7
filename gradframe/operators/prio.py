"""Analysis of priority tables ``(iter, id, p)``.

Work per point (along the iterations) uses windows by ``id``: a point has one
row per iteration. Work per iteration (across the points) ranks the rows with
range-split scans, because one iteration holds as many rows as there are points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut
from gradframe.plans.ordered import ranked
from gradframe.plans.sizes import small


def _by_point():
    return Window.partitionBy("id").orderBy("iter")


def diff(prio: DataFrame, step: int = 1, stride: int = 1, ratio: bool = True,
         average: bool = False) -> DataFrame:
    """Every ``stride``-th ``p_t / p_{t+step}`` or difference, optionally per step."""
    after = prio.withColumn("_q", F.lead("p", step).over(_by_point())).where(F.col("_q").isNotNull())
    value = F.try_divide("p", "_q") if ratio else F.col("p") - F.col("_q")
    return after.where(F.col("iter") % stride == 0).select(
        "iter", "id", (value / step if average else value).alias("d")
    )


def trend(prio: DataFrame, factor: float) -> DataFrame:
    """Points whose steps all fall (start above 0) or all rise, within ``factor``."""
    after = F.lead("p").over(_by_point())
    first = F.first("p").over(_by_point())
    bound = F.col("p") * (1 - factor)
    ok = F.when(first > 0, bound >= after).otherwise(bound <= after)
    steps = prio.select("id", ok.alias("ok"))
    return steps.groupBy("id").agg(F.coalesce(F.every("ok"), F.lit(True)).alias("ok")).where(
        "ok"
    ).select("id")


def log_trend(prio: DataFrame) -> DataFrame:
    """Log-priority and its change from the iteration before."""
    y = F.log("p")
    return prio.select("iter", "id", y.alias("y"), (y - F.lag(y).over(_by_point())).alias("dy"))


def fit(prio: DataFrame, interval: int, degree: int) -> DataFrame:
    """Piecewise log-priority models from every ``interval``-th iteration.

    One row ``(id, x, c, b, a)`` per sample from which the model holds on: the
    constant through one sample, the line through two, the parabola through
    three, as ``a*x^2 + b*x + c``.
    """
    samples = prio.where(F.col("iter") % interval == 0).select(
        "id", F.col("iter").alias("x"), F.log("p").alias("y")
    )
    w = Window.partitionBy("id").orderBy("x")
    x = [F.col("x").cast("double")] + [F.lag("x", i).over(w).cast("double") for i in (1, 2)]
    y = [F.col("y")] + [F.lag("y", i).over(w) for i in (1, 2)]
    zero = F.lit(0.0)
    if degree == 0:
        return samples.select("id", "x", F.col("y").alias("c"), zero.alias("b"), zero.alias("a"))
    if degree == 1:
        slope = (y[0] - y[1]) / (x[0] - x[1])
        out = samples.select("id", "x", (y[0] - slope * x[0]).alias("c"), slope.alias("b"), zero.alias("a"))
        return out.where(F.col("b").isNotNull())
    s1 = (y[0] - y[1]) / (x[0] - x[1])
    s2 = (y[1] - y[2]) / (x[1] - x[2])
    a = (s1 - s2) / (x[0] - x[2])
    b = s1 - a * (x[0] + x[1])
    c = y[0] - a * x[0] * x[0] - b * x[0]
    out = samples.select("id", "x", c.alias("c"), b.alias("b"), a.alias("a"))
    return out.where(F.col("a").isNotNull())


def fit_error(prio: DataFrame, models: DataFrame, interval: int) -> DataFrame:
    """Mean squared residual of the log-priority after each model's sample.

    A model predicts the iterations after its sample up to the next one, so
    each row meets exactly one model and the join is on ``(id, sample)``.
    """
    rows = prio.select(
        "id",
        F.col("iter").cast("double").alias("t"),
        F.log("p").alias("v"),
        (F.floor((F.col("iter") - 1) / interval) * interval).cast("int").alias("x"),
    ).where(F.col("t") >= 1)
    guess = F.col("a") * F.col("t") * F.col("t") + F.col("b") * F.col("t") + F.col("c")
    joined = rows.join(models.withColumn("x", F.col("x").cast("int")), ["id", "x"])
    residual = guess - F.col("v")
    return joined.agg(F.avg(residual * residual).alias("mse"), F.count("*").alias("n"))


def line_fit(prio: DataFrame) -> DataFrame:
    """Least-squares line of the log-priority per point, with its error sum."""
    y, x = F.log("p"), F.col("iter")
    return prio.groupBy("id").agg(
        F.regr_slope(y, x).alias("b"),
        F.regr_intercept(y, x).alias("c"),
        (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_slope(y, x)).alias("sse"),
    )


def parabola_fit(prio: DataFrame) -> DataFrame:
    """Least-squares parabola of the log-priority per point, by normal equations.

    Iterations are centred on their mean, which keeps the equations well posed.
    """
    base = prio.groupBy("id").agg(F.avg("iter").alias("m"), F.avg(F.log("p")).alias("ym"))
    rows = prio.join(base, "id").select(
        "id", "m", "ym", (F.col("iter") - F.col("m")).alias("u"), (F.log("p") - F.col("ym")).alias("v")
    )
    u, v = F.col("u"), F.col("v")
    sums = rows.groupBy("id", "m", "ym").agg(
        F.count("*").alias("n"),
        F.sum(u * u).alias("s2"),
        F.sum(u * u * u).alias("s3"),
        F.sum(u * u * u * u).alias("s4"),
        F.sum(u * v).alias("t1"),
        F.sum(u * u * v).alias("t2"),
    )
    s2, s3, s4 = F.col("s2"), F.col("s3"), F.col("s4") - F.col("s2") * F.col("s2") / F.col("n")
    det = s2 * s4 - s3 * s3
    a = F.try_divide(s2 * F.col("t2") - s3 * F.col("t1"), det)
    b = F.try_divide(s4 * F.col("t1") - s3 * F.col("t2"), det)
    m = F.col("m")
    return sums.select("id", "m", "ym", "n", "s2", a.alias("a"), b.alias("bu")).select(
        "id",
        (F.col("ym") - F.col("a") * F.col("s2") / F.col("n") - F.col("bu") * m + F.col("a") * m * m).alias("c"),
        (F.col("bu") - F.lit(2.0) * F.col("a") * m).alias("b"),
        "a",
    )


def histogram(values: DataFrame, column: str, bins: int, by: str | None = "iter") -> DataFrame:
    """Equal-width bins over the global range: counts, density share, cumulative share."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    keys = [by] if by else []
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins or 1.0
    index = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = values.groupBy(*keys, index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # from here on at most `bins` rows per key
    all_of = Window.partitionBy(*keys)
    up_to = all_of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        *keys,
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        "n",
        (F.col("n") / F.sum("n").over(all_of)).alias("pdf"),
        (F.sum("n").over(up_to) / F.sum("n").over(all_of)).alias("cdf"),
    )


def _at_ranks(prio: DataFrame, ends: Callable, per_iter: int, ascending: bool = False) -> DataFrame:
    """Rows at chosen ranks of every iteration, with running sum and totals.

    ``ends`` maps the totals ``(iter, m, total)`` to ``(iter, rank, ...)`` with
    ``per_iter`` rows each. Both are small beside the ranked rows and are
    broadcast when their counted size allows it.
    """
    totals = cut(prio.groupBy("iter").agg(F.count("*").alias("m"), F.sum("p").alias("total")))
    wanted = ends(totals)
    order = [F.col("p") if ascending else F.col("p").desc(), F.col("id")]
    rows = ranked(prio, ["iter"], order, "rank", {"cum": F.col("p")})
    return rows.join(small(wanted, totals.count() * per_iter), ["iter", "rank"])


def _steps(bins: int) -> Callable:
    """Ranks at ``bins`` equal steps: place floor((m - 1) * bin / bins) counted from 0."""
    step = lambda: F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    place = lambda: F.floor((F.col("m") - 1) * F.col("bin") / bins) + 1
    return lambda t: t.select("iter", "m", "total", step()).withColumn("rank", place())


def contribution(prio: DataFrame, bins: int) -> DataFrame:
    """Share of the total held by the lowest rows, at ``bins`` equal steps."""
    rows = _at_ranks(prio, _steps(bins), bins, ascending=True)
    return rows.select("iter", "bin", F.try_divide("cum", "total").alias("share"))


def top_share(prio: DataFrame, shares: list[float]) -> DataFrame:
    """Share of the total held by the top fraction, per iteration."""
    def ends(totals):
        each = totals.withColumn("top", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        left = F.floor((F.lit(1.0) - F.col("top")) * F.col("m"))
        return each.withColumn("rank", F.col("m") - left)

    rows = _at_ranks(prio, ends, len(shares))
    return rows.select("iter", "top", F.try_divide("cum", "total").alias("share"))


def top_mean(prio: DataFrame, bins: int) -> DataFrame:
    """Mean priority of the top percentiles, at ``bins`` equal steps."""
    rows = _at_ranks(prio, _steps(bins), bins)
    return rows.select("iter", "bin", (F.col("cum") / F.col("rank")).alias("mean"))


def overlap(prio: DataFrame, reference: int, ks: list[int]) -> DataFrame:
    """Jaccard index of the top-k points of each iteration and of ``reference``.

    Only rows in the largest top-k matter: the tasks drop all others before the
    shuffle. The reference's top points are at most ``max(ks)`` rows and are
    broadcast; the sizes of the sets follow from the ranks.
    """
    top = max(ks)
    w = Window.partitionBy("iter").orderBy(F.col("p").desc(), F.col("id"))
    rows = prio.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    rows = cut(rows.select("iter", "id", "rank"))
    own = rows.where(F.col("iter") == reference).select("id", F.col("rank").alias("ref"))
    count = own.count()
    # a row is in all sets from the first k on that reaches its rank: counts per k, then running sums
    steps = sorted(set(ks))
    reached = lambda rank: F.when(rank.isNotNull(), F.get(F.filter(F.array(*[F.lit(k) for k in steps]), lambda k: k >= rank), F.lit(0)))
    both = F.greatest("rank", "ref")
    from_k = F.explode(F.array(
        F.struct(reached(F.col("rank")).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("c")),
        F.struct(reached(F.when(F.col("ref").isNotNull(), both)).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("c")),
    )).alias("e")
    near = rows.join(small(own, count), "id", "left").select("iter", from_k).select("iter", "e.*").where(F.col("k").isNotNull())
    counts = near.groupBy("iter", "k").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    grid = rows.select("iter").distinct().select("iter", F.explode(F.array(*[F.lit(k) for k in steps])).alias("k"))
    upto = Window.partitionBy("iter").orderBy("k")  # as many rows as there are sets
    sets = grid.join(counts, ["iter", "k"], "left").select(
        "iter", "k", F.coalesce(F.sum("a").over(upto), F.lit(0)).alias("a"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c")
    )
    union = F.col("a") + F.least(F.col("k"), F.lit(count)) - F.col("c")
    return sets.select("iter", "k", (F.col("c") / union).alias("jaccard"))


def jaccard(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Size of the intersection over size of the union of two index sets."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(
        right.select(key).distinct().withColumn("r", F.lit(1)), key, "full"
    )
    return both.agg(
        F.count(F.col("l") + F.col("r")).alias("common"),
        F.count("*").alias("all"),
        F.try_divide(F.count(F.col("l") + F.col("r")), F.count("*")).alias("jaccard"),
    )


def by_deviation(prio: DataFrame, iteration: int) -> DataFrame:
    """Points of one iteration ranked by how far their log-priority is from the mean."""
    rows = prio.where(F.col("iter") == iteration).select("id", F.log("p").alias("y"))
    mean = rows.agg(F.avg("y")).first()[0] or 0.0
    gaps = rows.select("id", F.abs(F.col("y") - F.lit(mean)).alias("gap"))
    return ranked(gaps, [], ["gap", "id"])


def top_per_key(df: DataFrame, key: str, by: str, tie: str, k: int) -> DataFrame:
    """The ``k`` largest rows per key; tasks drop what cannot be among them first."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key, by one aggregate with map-side combining."""
    others = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*others), version)
    return df.groupBy(key).agg(newest.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])
