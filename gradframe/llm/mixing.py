"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash of its id (and of its number among equal ids). A source's words are summed by hash
bucket; running sums over the buckets find the one in which the budget is used up; only
the documents of that bucket are summed again by the next bits of the hash, and so on
until a single hash value is left. What to take is then a threshold per source: no
document is sorted, and budgets are nested (a larger budget takes the same documents
and more). All of it is DataFrame functions.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; rows with equal ids are numbered by source and text, so they are taken one by one; texts of
any length count whole; an empty table gives an empty result; other columns are handed on by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradframe.llm.columns import bounded_broadcast, private, quoted, text_of, words
from gradframe.plans import ordered
from gradframe.plans.lineage import cut

WEIGHTS = (3, 1, 2)  # by place of the source in code point order, repeating
SHARE = 1.5  # of all words
CAP = 2.0  # times a source's size
HASH_DIGITS = 15  # hexadecimal digits of the hash, 60 bits
ROUND_BITS = 10  # bits of the hash that one round looks at


def _hash(key: Column, number: Column) -> Column:
    """60 bits of the digest of an id and, for repeated ids, of a row's number among its equals."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.when(number > 0, F.concat(F.lit("#"), number.cast("string"))).otherwise(""))
    return F.conv(F.substring(F.md5(name), 1, HASH_DIGITS), 16, 10).cast("bigint")


def _hashed(df: DataFrame, key: str, text: str, source: str, name: str) -> DataFrame:
    """Add the hash of every row. Only rows whose id is there more than once are brought into an order, by ranges."""
    p = private(df)
    own = quoted(df.columns)
    id_ = F.coalesce(df[key].cast("string"), F.lit(""))
    often = df.groupBy(id_.alias(f"{p}id")).agg(F.count("*").alias(f"{p}n")).where(F.col(f"{p}n") > 1)
    often = cut(often.select(f"{p}id"))
    if not often.take(1):
        return df.select(*own, _hash(df[key], F.lit(0)).alias(name))
    near = bounded_broadcast(often)
    same = id_ == F.col(f"{p}id")
    once = df.join(near, same, "left_anti").select(*own, _hash(df[key], F.lit(0)).alias(name))
    rows = df.join(near, same, "left_semi").select(
        *own, id_.alias(f"{p}id"), F.coalesce(df[source].cast("string"), F.lit("")).alias(f"{p}s"), F.md5(text_of(df, text)).alias(f"{p}t")
    )
    ranked = ordered.ranked(rows, [f"{p}id"], [f"{p}s", f"{p}t"], f"{p}k") if rows.take(1) else rows.withColumn(f"{p}k", F.lit(1))
    several = ranked.select(*quoted(df.columns), _hash(ranked[key], F.col(f"{p}k") - 1).alias(name))
    return once.unionByName(several)


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, h`` of every document."""
    p = private(df)
    rows = _hashed(df, key, text, source, f"{p}h")
    return rows.select(
        rows[key].alias("doc_id"),
        rows[source].cast("string").alias("source"),
        F.size(words(text_of(rows, text))).cast("bigint").alias("size"),
        F.col(f"{p}h").alias("h"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` for every source.

    Resharing the excess until no target is above its cap ends at a common level: a
    source gets ``min(cap * size, level * weight)``. Sources are put in the order
    in which they reach their caps; the level is what the budget leaves after the capped ones,
    over the weight of the rest.
    """
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = ordered.ranked(
        totals.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_place"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    limits = placed.select(
        "source", "source_size", "_place", weight.alias("_w"), (F.lit(cap) * F.col("source_size")).alias("_cap")
    ).withColumn("_reach", F.col("_cap") / F.col("_w"))
    run = ordered.running(limits, [], ["_reach", "_place"], {"_caps": F.col("_cap"), "_weights": F.col("_w")})
    run = cut(run.select(*limits.columns, "_caps", "_weights"))
    budget, weigh = run.agg(F.lit(share) * F.sum("source_size"), F.sum("_w")).first()
    if budget is None:
        return run.select("source", "source_size", F.lit(0.0).alias("target"))
    # the source is capped if the level that capping all up to it leaves is no lower than its own reach
    level = (F.lit(budget) - F.col("_caps") + F.col("_cap")) / (F.lit(weigh) - F.col("_weights") + F.col("_w"))
    open_from = run.where(level < F.col("_reach")).agg(F.max(F.struct(-F.col("_reach"), -F.col("_place"), level)).alias("x")).first()["x"]
    common = open_from[2] if open_from else float("inf")
    return run.select(
        "source", "source_size", F.least("_cap", F.lit(common) * F.col("_w")).alias("target")
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, source_size, target, copies, edge``: documents whose hash is at most ``edge`` give one copy more.

    Of the words left after whole copies, the documents below the boundary hash are
    taken; those with the boundary hash itself only if that comes closer.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.select(
        "source", "source_size", "target", copies.cast("bigint").alias("copies"),
    ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = cut(state.withColumns({"prefix": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")}))
    bits = 4 * HASH_DIGITS
    while bits > 0:
        step = min(ROUND_BITS, bits)
        inside = sizes.where("size > 0").join(
            bounded_broadcast(state.select(F.col("source").alias("_s"), "prefix")),
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", bits) == F.col("prefix")),
        )
        bits -= step
        buckets = inside.groupBy("source", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("words"))
        counted = buckets.join(
            state.select(F.col("source").alias("_s"), "rest", "before"), F.col("source").eqNullSafe(F.col("_s"))
        )
        # at most 2 ** ROUND_BITS buckets of a source meet in a window
        upto = Window.partitionBy("source").orderBy("bucket")
        run = counted.withColumn("upto", F.col("before") + F.sum("words").over(upto))
        edge = run.where(F.col("upto") > F.col("rest")).groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("under"), "words")).alias("e")
        )
        names = ("source", "source_size", "target", "copies", "rest")
        state = cut(
            state.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
                *names,
                F.when(F.col("prefix") < 0, F.col("prefix")).otherwise(F.coalesce("e.bucket", F.lit(-1).cast("bigint"))).alias("prefix"),
                F.coalesce("e.under", "before").alias("before"),
                F.coalesce("e.words", F.lit(0).cast("bigint")).alias("words"),
            )
        )
    closer = F.col("before") + F.col("words") - F.col("rest") < F.col("rest") - F.col("before")
    edge = F.when(F.col("prefix") < 0, F.lit(-1).cast("bigint")).otherwise(
        F.when(closer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    )
    return state.select("source", "source_size", "target", "copies", edge.alias("edge"))


def _planned(sizes: DataFrame) -> DataFrame:
    return bounded_broadcast(cut(thresholds(sizes, targets(sizes))))


def _copies() -> Column:
    return F.col("copies") + F.when(F.col("h") <= F.col("edge"), 1).otherwise(0)


def mix(df: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sizes = cut(sized(df))
    plan = _planned(sizes).withColumnRenamed("source", "_s")
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).cast("bigint").alias("taken")
    )


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix with their own columns: each as often as it is taken.

    A document without words takes part like the others of its source, so it is there once at least
    wherever its source is taken whole.
    """
    p = private(df)
    sizes = cut(sized(df, key, text, source))
    plan = _planned(sizes).select(
        F.col("source").alias(f"{p}s"), F.col("copies").alias(f"{p}copies"), F.col("edge").alias(f"{p}edge")
    )
    rows = _hashed(df, key, text, source, f"{p}h")
    own = rows.join(plan, rows[source].cast("string").eqNullSafe(F.col(f"{p}s")))
    often = F.col(f"{p}copies") + F.when(F.col(f"{p}h") <= F.col(f"{p}edge"), 1).otherwise(0)
    rows = own.withColumn(f"{p}k", F.explode(F.sequence(F.lit(1), F.greatest(often, F.lit(1)).cast("int"))))
    return rows.where(often > 0).select(*quoted(df.columns))


def oracle() -> str:
    """The same for DuckDB, with running sums over all hashes of a source."""
    return f"""
with numbered as (select *, row_number() over (partition by doc_id order by coalesce(source, ''), md5(coalesce(text, ''))) - 1 as k from documents),
sizes as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || case when k > 0 then '#' || k else '' end), 1, {HASH_DIGITS}))::bigint as h from numbered),
totals as (select source, sum(size)::bigint as source_size from sizes group by source),
placed as (select *, {list(map(float, WEIGHTS))}[1 + (row_number() over (order by encode(source) nulls last) - 1) % {len(WEIGHTS)}]::double as w,
  row_number() over (order by encode(source) nulls last) as place, {CAP}::double * source_size as cap from totals),
levels as (select *, ({SHARE} * sum(source_size) over () - (sum(cap) over o - cap)) / (sum(w) over () - (sum(w) over o - w)) as level
  from placed window o as (order by cap / w, place)),
common as (select coalesce(arg_min(level, row(cap / w, place)), 'infinity'::double) as c from levels where level < cap / w),
goals as (select source, source_size, least(cap, c * w)::double as target,
  case when source_size > 0 then floor(least(cap, c * w) / source_size) else 0 end::bigint as copies from levels, common),
run as (select s.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size as rest,
  sum(size) over (partition by s.source order by h range unbounded preceding) as upto,
  sum(size) over (partition by s.source, h) as same
  from sizes s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (copies + case when upto <= rest
  or (upto - same <= rest and upto - rest < rest - (upto - same)) then 1 else 0 end))::bigint as taken from run"""
