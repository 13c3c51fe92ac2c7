"""Points, histories, priorities and logs derived from the tables.

Every view exists twice: as a DataFrame and as SQL text, from the same formula.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradframe.plans.lineage import checkpoint_dir
from gradframe.plans.ordered import ranked
from gradframe.sources import history

DAYS = 30


def weights(width: int) -> np.ndarray:
    """Fixed test weights; the bias is the last position."""
    return np.array([((37 * j) % 11 - 5) / 10 for j in range(width)])


def centre_params(centres: np.ndarray) -> np.ndarray:
    """Parameter vector of centres that count as one point each."""
    return np.hstack([centres, np.ones((len(centres), 1))]).ravel()


def r6(c: Column | str) -> Column:
    """Six places, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """Plain path of a ``file:`` URI; other URIs stay as they are."""
    return path[5:] if path.startswith("file:") else path


# --- DataFrames ---------------------------------------------------------------


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.array((F.col("label") < 5).cast("double")).alias("y"),
        F.col("label").alias("cls"),
    )


def li(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.array(
            F.col("l_quantity") / 50,
            F.col("l_extendedprice") / 105000,
            F.col("l_discount") * 10,
            F.col("l_tax") * 12.5,
        ).alias("x"),
        F.array((F.col("l_returnflag") == "R").cast("double")).alias("y"),
    )


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.array(
            F.col("value") / 561, F.hour("ts") / 24, F.pmod("user_id", F.lit(10)) / 10
        ).alias("x"),
        F.array((F.col("event_type") == "purchase").cast("double")).alias("y"),
    )


def hist(spark: SparkSession, width: int, records: int = 20) -> DataFrame:
    rows = []
    for i in range(records):
        w = [((37 * j + 11 * i + i * i) % 11 - 5) / 10 for j in range(width)]
        rows.append((i, i / 2, 100 * i, w))
    return history.rows(spark, rows)


def day_hist(spark: SparkSession, sf: str) -> DataFrame:
    """A history out of the events: one record per day, mean features as parameter."""
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    p = ev(spark, sf).join(e.select(F.col("event_id").alias("id"), day.alias("iter")), "id")
    return p.groupBy("iter").agg(
        F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(3)]
    ).select(
        "iter", (F.col("iter") / 2).alias("time"), "n", F.array("m0", "m1", "m2").alias("w")
    )


def prio(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("iter")
    sums = e.groupBy(F.col("user_id").alias("id"), day).agg(F.round(F.sum("value"), 2).alias("v"))
    grid = e.select(F.col("user_id").alias("id")).distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("iter"), "id"
    )
    return grid.join(sums, ["id", "iter"], "left").select(
        "iter", "id", (F.coalesce("v", F.lit(0.0)) + F.lit(0.01)).alias("p")
    )


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    j = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")
    rows = e.select(F.col("event_id").alias("seq"), F.pmod("user_id", F.lit(4)).alias("worker"), j)
    d = (F.pmod(F.col("seq") * (F.col("j") + 3), F.lit(13)) - 6) / 100
    return rows.withColumn("d", d)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.pmod("user_id", F.lit(8)).alias("worker"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        (F.lit(1) + F.pmod("event_id", F.lit(5))).alias("n"),
        (v / 1000).alias("t_point"),
        (v / 100).alias("t_delta"),
        (v / 10).alias("loss"),
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Iteration metrics per worker: points, interval, improvement, sync time."""
    return reports(spark, sf).select(
        "seq",
        "worker",
        F.col("n").alias("points"),
        (F.lit(0.5) + F.pmod("seq", F.lit(7)) / 10).alias("interval"),
        (F.lit(0.01) + F.col("loss") / 97).alias("improve"),
        (F.lit(0.01) + F.pmod("seq", F.lit(3)) / 100).alias("sync"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per customer: its orders in time are the iterations."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    rows = ranked(o, ["run"], ["o_orderdate", "o_orderkey"], "rank")
    i, slow = F.col("rank") - 1, F.pmod("run", F.lit(5))
    return rows.select(
        "run",
        i.cast("int").alias("iter"),
        (i * (slow + 2) / 4).alias("time"),
        (F.lit(10.0) / (F.lit(1) + i * (slow + 1) / 5) + F.floor("o_totalprice") / 1000000).alias("loss"),
    )


# --- SQL ----------------------------------------------------------------------

SQL = {
    "emb": """SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x,
        CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS y, label AS cls FROM embeddings""",
    "li": """SELECT [l_quantity/50, l_extendedprice/105000, l_discount*10, l_tax*12.5] AS x,
        CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM lineitem""",
    "ev": """SELECT event_id AS id, [value/561, hour(ts)/24, (user_id % 10)/10] AS x,
        CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM events""",
    "w64": "SELECT list(((37*j) % 11 - 5)/10 ORDER BY j) AS w FROM range(65) t(j)",
    "w4": "SELECT list(((37*j) % 11 - 5)/10 ORDER BY j) AS w FROM range(5) t(j)",
    "w3": "SELECT list(((37*j) % 11 - 5)/10 ORDER BY j) AS w FROM range(4) t(j)",
    "hist4": """SELECT i::INT AS iter, i/2 AS time, 100*i AS n,
        list(((37*j + 11*i + i*i) % 11 - 5)/10 ORDER BY j) AS w
        FROM range(20) a(i), range(5) b(j) GROUP BY i""",
    "hist3": """SELECT i::INT AS iter, i/2 AS time, 100*i AS n,
        list(((37*j + 11*i + i*i) % 11 - 5)/10 ORDER BY j) AS w
        FROM range(20) a(i), range(4) b(j) GROUP BY i""",
    "day_hist": """SELECT datediff('day', DATE '2024-01-01', e.ts::DATE)::INT AS iter,
        datediff('day', DATE '2024-01-01', e.ts::DATE)/2 AS time, count(*) AS n,
        [avg(x[1]), avg(x[2]), avg(x[3])] AS w
        FROM ev JOIN events e ON ev.id = e.event_id GROUP BY 1, 2""",
    "prio": """SELECT d.iter, u.id, coalesce(s.v, 0) + 0.01::DOUBLE AS p
        FROM (SELECT DISTINCT user_id AS id FROM events) u
        CROSS JOIN (SELECT i::INT AS iter FROM range(30) r(i)) d
        LEFT JOIN (SELECT user_id AS id, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS iter,
                          round(sum(value), 2) AS v FROM events GROUP BY 1, 2) s
        ON s.id = u.id AND s.iter = d.iter""",
    "deltas": """SELECT event_id AS seq, user_id % 4 AS worker, j::INT AS j,
        ((event_id*(j+3)) % 13 - 6)/100 AS d FROM events, range(4) t(j)""",
    "reports": """SELECT event_id AS seq, user_id % 8 AS worker, epoch_us(ts) AS micros,
        1 + event_id % 5 AS n, value/1000 AS t_point, value/100 AS t_delta, value/10 AS loss
        FROM events""",
    "metrics": """SELECT seq, worker, n AS points, 0.5::DOUBLE + (seq % 7)/10 AS interval,
        0.01::DOUBLE + loss/97 AS improve, 0.01::DOUBLE + (seq % 3)/100 AS sync FROM reports""",
    "runs": """SELECT run, i::INT AS iter, i*(run % 5 + 2)/4 AS time,
        10.0::DOUBLE/(1 + i*(run % 5 + 1)/5) + floor(o_totalprice)/1000000 AS loss
        FROM (SELECT o_custkey AS run, o_totalprice, row_number() OVER
              (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)""",
}

NEEDS = {"day_hist": ["ev"], "metrics": ["reports"]}


def sql(views: str, body: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` the named views and further parts, then ``body``."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def sigmoid_sql(x: str, w: str, n: int) -> str:
    return f"1/(1+exp(-(list_dot_product({x}, {w}[1:{n}]) + {w}[{n + 1}])))"


def loss_sql(p: str, y: str) -> str:
    hit = f"(CASE WHEN {y} = 0 THEN 1 - {p} ELSE {p} END)"
    return f"(CASE WHEN {hit} <= 0 THEN 100.0 ELSE -ln({hit}) END)"
