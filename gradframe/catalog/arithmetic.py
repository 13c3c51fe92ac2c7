"""Scalar and vector functions, reductions and norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import emb, ev, li, prio, r6, sql, table, weights
from gradframe.functions import vec
from gradframe.operators.gradients import vector_sum



def _z(spark, sf):
    """A signed number per row: quantity around its middle."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", (F.col("l_quantity") / 10 - 2.5).alias("z")
    )


def _activation(name, spark_columns, sql_columns):
    keys = ["l_orderkey", "l_partkey", "l_extendedprice"]
    body = ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in sql_columns.items())
    text = f"""SELECT l_orderkey, l_partkey, l_extendedprice, {body}
        FROM (SELECT *, l_quantity/10 - 2.5 AS z FROM lineitem)"""

    @query(name, text)
    def run(spark, sf):
        return _z(spark, sf).select(*keys, *[r6(e).alias(c) for c, e in spark_columns().items()])


S = "(1/(1+exp(-z)))"
_activation(
    "f1_sigmoid",
    lambda: {"s": vec.sigmoid("z"), "d": vec.dsigmoid("z"), "dy": vec.dsigmoid(y=vec.sigmoid("z"))},
    {"s": S, "d": f"{S}*(1-{S})", "dy": f"{S}*(1-{S})"},
)
_activation(
    "f2_relu",
    lambda: {"r": vec.relu("z"), "d": vec.drelu("z")},
    {"r": "greatest(z, 0)", "d": "CASE WHEN z >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE"},
)
_activation(
    "f3_tanh",
    lambda: {"t": vec.tanh("z"), "d": vec.dtanh("z")},
    {"t": "tanh(z)", "d": "1 - tanh(z)*tanh(z)"},
)
_activation(
    "f4_arctan",
    lambda: {"t": vec.arctan("z"), "d": vec.darctan("z")},
    {"t": "atan(z)", "d": "1/(z*z+1)"},
)
_activation(
    "f5_softplus",
    lambda: {"s": vec.softplus("z"), "d": vec.dsoftplus("z")},
    {"s": "ln(1+exp(z))", "d": S},
)


@query(
    "f6_softmax",
    sql(
        "li",
        """SELECT j::INT AS j, round(sum(e[j+1]/list_sum(e)), 6) + 0.0 AS p, count(*) AS n
        FROM (SELECT [exp(v) FOR v IN x] AS e FROM li), range(4) t(j) GROUP BY j""",
    ),
)
def softmax(spark, sf):
    p = li(spark, sf).select(F.posexplode(vec.softmax("x")).alias("j", "p"))
    return p.groupBy("j").agg(r6(F.sum("p")).alias("p"), F.count("*").alias("n"))


@query(
    "f7_softmax_jacobian",
    sql(
        "ev",
        """SELECT id, i::INT AS i, j::INT AS j,
        round(CASE WHEN i = j THEN p[i+1]*(1-p[i+1]) ELSE -p[i+1]*p[j+1] END, 6) + 0.0 AS d
        FROM (SELECT id, [exp(v)/list_sum([exp(u) FOR u IN x]) FOR v IN x] AS p FROM ev),
             range(3) a(i), range(3) b(j)""",
    ),
)
def softmax_jacobian(spark, sf):
    rows = ev(spark, sf).select("id", F.posexplode(vec.softmax_jacobian("x")).alias("i", "r"))
    return rows.select("id", "i", F.posexplode("r").alias("j", "d")).withColumn("d", r6("d"))


@query(
    "f8_dot_axpy",
    sql(
        "emb w64",
        """SELECT id, round(list_dot_product(x, w[1:64]), 6) + 0.0 AS dot,
        round(list_sum([x[j] + 0.5*w[j] FOR j IN range(1, 65)]), 6) + 0.0 AS moved FROM emb, w64""",
    ),
)
def dot_axpy(spark, sf):
    w = vec.vector(weights(65)[:64])
    return emb(spark, sf).select(
        "id", r6(vec.dot("x", w)).alias("dot"), r6(vec.total(vec.axpy("x", w, 0.5))).alias("moved")
    )


@query(
    "f9_squared_loss",
    sql(
        "ev w3",
        """SELECT id, round(list_sum([(x[j]-w[j])*(x[j]-w[j]) FOR j IN [1,2,3]]), 6) + 0.0 AS loss
        FROM ev, w3""",
    ),
)
def squared_loss(spark, sf):
    return ev(spark, sf).select("id", r6(vec.squared_loss("x", vec.vector(weights(4)[:3]))).alias("loss"))


@query(
    "f10_log_loss",
    """SELECT event_id AS id, round(CASE WHEN hit <= 0 THEN 100.0 ELSE -ln(hit) END, 6) + 0.0 AS loss
    FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN p ELSE 1 - p END AS hit
          FROM (SELECT *, least(value/100, 1.0) AS p FROM events))""",
)
def log_loss(spark, sf):
    p = F.least(F.col("value") / 100, F.lit(1.0))
    y = (F.col("event_type") == "purchase").cast("double")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), r6(vec.log_loss(p, y)).alias("loss")
    )


@query(
    "f11_centre_distance",
    sql(
        "ev",
        """SELECT id, round(sqrt(list_sum([(x[j]-s[j]/4)*(x[j]-s[j]/4) FOR j IN [1,2,3]])), 6) + 0.0
        AS dist FROM ev, (SELECT [1.0::DOUBLE, 2.0, 3.0] AS s)""",
    ),
)
def centre_distance(spark, sf):
    d = vec.centre_distance("x", vec.vector([1, 2, 3]), F.lit(4))
    return ev(spark, sf).select("id", r6(d).alias("dist"))


@query(
    "f13_decay",
    sql(
        "prio",
        """SELECT iter, id, round(p*exp(-0.05*(30-iter)), 6) + 0.0 AS lin,
        round(p*exp(-0.001*(900-iter*iter) - 0.01*(30-iter)), 6) + 0.0 AS quad FROM prio""",
    ),
)
def decay(spark, sf):
    lin = vec.decay_linear("p", -0.05, F.col("iter"), 30)
    quad = vec.decay_quadratic("p", -0.001, -0.01, F.col("iter"), F.lit(30))
    return prio(spark, sf).select("iter", "id", r6(lin).alias("lin"), r6(quad).alias("quad"))


# --- reductions ---------------------------------------------------------------


@query(
    "a7_reductions",
    sql(
        "emb",
        """SELECT id, round(list_sum(x), 6) + 0.0 AS total, round(list_avg(x), 6) + 0.0 AS mean,
        round(64/list_sum([1/(2+v) FOR v IN x]), 6) + 0.0 AS hmean,
        round(least(list_min(x), 0), 6) + 0.0 AS lo, round(greatest(list_max(x), 0), 6) + 0.0 AS hi
        FROM emb""",
    ),
)
def reductions(spark, sf):
    shifted = F.transform("x", lambda v: v + F.lit(2.0))
    return emb(spark, sf).select(
        "id",
        r6(vec.total("x")).alias("total"),
        r6(vec.mean("x")).alias("mean"),
        r6(vec.hmean(shifted)).alias("hmean"),
        r6(vec.smallest("x", 0.0)).alias("lo"),
        r6(vec.largest("x", 0.0)).alias("hi"),
    )


@query(
    "a8_norms",
    sql(
        "emb w64",
        """SELECT id, round(list_sum([abs(v) FOR v IN x]), 6) + 0.0 AS l1,
        round(list_sum([v*v FOR v IN x]), 6) + 0.0 AS sq,
        round(list_sum([abs(x[j]-w[j]) FOR j IN range(1,65)])/64, 6) + 0.0 AS l1_diff,
        round(list_sum([(x[j]-w[j])*(x[j]-w[j]) FOR j IN range(1,65)])/64, 6) + 0.0 AS sq_diff
        FROM emb, w64""",
    ),
)
def norms(spark, sf):
    w = vec.vector(weights(65)[:64])
    return emb(spark, sf).select(
        "id",
        r6(vec.l1("x")).alias("l1"),
        r6(vec.sq("x")).alias("sq"),
        r6(vec.l1("x", w, avg=True)).alias("l1_diff"),
        r6(vec.sq("x", w, avg=True)).alias("sq_diff"),
    )


@query(
    "a9_distance",
    sql(
        "emb w64",
        """SELECT id, round(sqrt(list_sum([(x[j]-w[j])*(x[j]-w[j]) FOR j IN range(1,65)])), 6) + 0.0
        AS dist FROM emb, w64""",
    ),
)
def distance(spark, sf):
    return emb(spark, sf).select("id", r6(vec.dist("x", vec.vector(weights(65)[:64]))).alias("dist"))


@query(
    "a1_vector_sum",
    sql(
        "emb",
        "SELECT (j-1)::INT AS j, round(sum(x[j]), 6) + 0.0 AS v FROM emb, range(1, 65) t(j) GROUP BY j",
    ),
)
def vector_sums(spark, sf):
    return vector_sum(emb(spark, sf), "x", 64).select("j", r6("v").alias("v"))


@query(
    "a2_two_stage_sum",
    sql(
        "emb",
        "SELECT (j-1)::INT AS j, round(sum(x[j]), 6) + 0.0 AS v FROM emb, range(1, 65) t(j) GROUP BY j",
    ),
)
def two_stage_sums(spark, sf):
    """Task-local array sums, then one shuffled sum per position."""
    return vector_sum(emb(spark, sf), "x").select("j", r6("v").alias("v"))
