"""Networks over the embeddings read as series, images, cubes and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import emb, r6, sql, weights
from gradframe.functions.models import MLP
from gradframe.functions.network import Act, Conv, Dense, Net, Pool, Recurrent, SeqNet, WeightedSum
from gradframe.operators import gradients, priority, scoring, training


def _params(n):
    return f"SELECT list(((37*j) % 11 - 5)/10 ORDER BY j) AS w FROM range({n}) t(j)"


def sig(e):
    return f"(1/(1+exp(-({e}))))"


def dense(v, first, n):
    """Sigmoid of ``n`` weights from position ``first`` and the bias after them."""
    return sig(f"list_dot_product({v}, w[{first}:{first + n - 1}]) + w[{first + n}]")


def _scores(spark, sf, nets):
    """``(net, id, p)`` of several networks, first output."""
    rows = emb(spark, sf)
    out = None
    for name, net in nets.items():
        one = scoring.score(rows, net, weights(net.width), keep=["id"]).select(
            F.lit(name).alias("net"), "id", r6(F.get("p", F.lit(0))).alias("p")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _scores_sql(parts):
    """Union of ``(name, width, expression over x and w)``."""
    return sql(
        "emb",
        " UNION ALL ".join(
            f"SELECT '{n}' AS net, id, round({e}, 6) + 0.0 AS p FROM emb, ({_params(width)})"
            for n, width, e in parts
        ),
    )


SERIES = Net((64,), (Conv(1, (3,)), Act("sigmoid"), Pool("max", (2,)), Dense(1)))
SERIES_CONV = "[w[1]*x[i] + w[2]*x[i+1] + w[3]*x[i+2] + w[4] FOR i IN range(1, 63)]"
SERIES_POOL = f"""list_transform(range(1, 32), lambda i: greatest(a[2*i-1], a[2*i]))"""


def _series_p(params):
    """Score of the series network with the parameter lists of ``params``."""
    return f"""SELECT *, {dense('m', 5, 31)} AS p FROM (SELECT *, {SERIES_POOL} AS m FROM (
        SELECT *, [1/(1+exp(-v)) FOR v IN c] AS a FROM (SELECT *, {SERIES_CONV} AS c FROM emb, {params})))"""


@query(
    "m3_network_score",
    sql("emb", "SELECT id, round(p, 6) + 0.0 AS p, round((p-y)*(p-y), 6) + 0.0 AS loss FROM s",
        w=_params(36), s=_series_p("w")),
)
def network_score(spark, sf):
    out = scoring.score(emb(spark, sf), SERIES, weights(SERIES.width), keep=["id"])
    return out.select("id", r6(F.get("p", F.lit(0))).alias("p"), r6("loss").alias("loss"))


def _conv2(first):
    return f"""[list_sum([w[{first} + k]*x[(o//6 + k//3)*8 + o%6 + k%3 + 1] FOR k IN range(9)]) + w[{first + 9}]
        FOR o IN range(36)]"""


CONV3 = """[list_sum([w[1 + k]*x[(o//9 + k//4)*16 + ((o//3)%3 + (k//2)%2)*4 + o%3 + k%2 + 1] FOR k IN range(8)]) + w[9]
    FOR o IN range(27)]"""


@query(
    "m4_convolutions",
    _scores_sql([
        ("1d", 67, dense("[w[1]*x[i] + w[2]*x[i+1] + w[3]*x[i+2] + w[4] FOR i IN range(1, 63)]", 5, 62)),
        ("2d", 93, dense(f"list_concat({_conv2(1)}, {_conv2(11)})", 21, 72)),
        ("3d", 37, dense(CONV3, 10, 27)),
    ]),
)
def convolutions(spark, sf):
    return _scores(
        spark,
        sf,
        {
            "1d": Net((64,), (Conv(1, (3,)), Dense(1))),
            "2d": Net((8, 8), (Conv(2, (3, 3)), Dense(1))),
            "3d": Net((4, 4, 4), (Conv(1, (2, 2, 2)), Dense(1))),
        },
    )


def _pools(kind):
    """Blocks of 5, 3x3 and 3x3x3 over 64, 8x8 and 4x4x4, with ragged ends."""
    f = f"list_{kind}"
    one = f"[{f}(x[5*i+1 : least(5*i+5, 64)]) FOR i IN range(13)]"
    two = f"""[{f}([x[(o//3*3 + k//3)*8 + o%3*3 + k%3 + 1] FOR k IN range(9) IF o//3*3 + k//3 < 8 AND o%3*3 + k%3 < 8])
        FOR o IN range(9)]"""
    three = f"""[{f}([x[(o//4*3 + k//9)*16 + ((o//2)%2*3 + (k//3)%3)*4 + o%2*3 + k%3 + 1] FOR k IN range(27)
        IF o//4*3 + k//9 < 4 AND (o//2)%2*3 + (k//3)%3 < 4 AND o%2*3 + k%3 < 4]) FOR o IN range(8)]"""
    return [
        (f"{kind}1", 14, dense(one, 1, 13)),
        (f"{kind}2", 10, dense(two, 1, 9)),
        (f"{kind}3", 9, dense(three, 1, 8)),
    ]


@query("m5_pools", _scores_sql(_pools("max") + _pools("min")))
def pools(spark, sf):
    nets = {}
    for kind in ("max", "min"):
        nets[f"{kind}1"] = Net((64,), (Pool(kind, (5,)), Dense(1)))
        nets[f"{kind}2"] = Net((8, 8), (Pool(kind, (3, 3)), Dense(1)))
        nets[f"{kind}3"] = Net((4, 4, 4), (Pool(kind, (3, 3, 3)), Dense(1)))
    return _scores(spark, sf, nets)


@query(
    "m6_activations",
    _scores_sql([
        ("relu", 65, dense("[greatest(v, 0) FOR v IN x]", 1, 64)),
        ("sigmoid", 65, dense("[1/(1+exp(-v)) FOR v IN x]", 1, 64)),
        ("tanh", 65, dense("[tanh(v) FOR v IN x]", 1, 64)),
    ]),
)
def activations(spark, sf):
    return _scores(spark, sf, {k: Net((64,), (Act(k), Dense(1))) for k in ("relu", "sigmoid", "tanh")})


@query(
    "m7_weighted_sum_dense",
    _scores_sql([
        ("sum", 203, dense("[list_dot_product(x, w[65*k+1 : 65*k+64]) + w[65*k+65] FOR k IN range(3)]", 196, 3)),
    ]),
)
def weighted_sum(spark, sf):
    """The second of two outputs is scored too, but only the first is shown."""
    return _scores(spark, sf, {"sum": Net((64,), (WeightedSum(3), Dense(2)))})


STEPS = "[x[8*t+1 : 8*t+8] FOR t IN range(8)]"


def _cell(k, act):
    at = 11 * k
    z = f"list_dot_product(v, w[{at + 1}:{at + 8}]) + list_dot_product(h, w[{at + 9}:{at + 10}]) + w[{at + 11}]"
    return sig(z) if act == "sigmoid" else f"tanh({z})"


def _recurrent(act):
    return f"list_reduce({STEPS}, lambda h, v: [{_cell(0, act)}, {_cell(1, act)}], [0.0::DOUBLE, 0.0])"


def _seqs(spark, sf):
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("x", t * 8 + 1, 8))
    return emb(spark, sf).select("id", steps.alias("xs"), "y")


def _sequence_scores(spark, sf, nets):
    rows = _seqs(spark, sf)
    out = None
    for name, net in nets.items():
        one = scoring.score(rows, net, weights(net.width), keep=["id"]).select(
            F.lit(name).alias("net"), "id", r6(F.get("p", F.lit(0))).alias("p")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "m8_recurrent_units",
    _scores_sql([(a, 25, dense(_recurrent(a), 23, 2)) for a in ("sigmoid", "tanh")]),
)
def recurrent_units(spark, sf):
    return _sequence_scores(
        spark, sf, {a: SeqNet((8,), (Recurrent(1, a, 2), Dense(1))) for a in ("sigmoid", "tanh")}
    )


# a recurrent layer of one cell, then tanh and a dense output; h is one number
SHORT = SeqNet((8,), (Recurrent(1, "sigmoid", 1), Act("tanh"), Dense(1)))
SHORT_P = dense(
    f"""[tanh(v) FOR v IN list_reduce({STEPS}, lambda h, v:
    [{sig('list_dot_product(v, w[1:8]) + h[1]*w[9] + w[10]')}], [0.0::DOUBLE])]""",
    11,
    1,
)


@query("m9_sequence_score", _scores_sql([("short", 12, SHORT_P)]))
def sequence_score(spark, sf):
    return _sequence_scores(spark, sf, {"short": SHORT})


H = "1e-6::DOUBLE"


def _numeric(n, scored):
    """Half the central difference of the summed loss: the gradient of ``(p-y)^2/2``."""
    shifted = f"""SELECT j, s, [w[i] + CASE WHEN i = j THEN s*{H} ELSE 0 END FOR i IN range(1, {n + 1})] AS w
        FROM w0, range(1, {n + 1}) t(j), (SELECT unnest([1, -1]) AS s)"""
    return dict(w0=_params(n), pw=shifted, s=scored)


DIFFERENCE = f"""SELECT (j-1)::INT AS j, round(sum(s*(p-y)*(p-y))/(4*{H}), 3) + 0.0 AS g, count(*)//2 AS n
    FROM s GROUP BY j"""


@query("g3_network_gradient", sql("emb", DIFFERENCE, **_numeric(36, _series_p("pw"))))
def network_gradient(spark, sf):
    """Back-propagation against differences of the loss."""
    out = gradients.grad_sum(emb(spark, sf), SERIES, weights(SERIES.width))
    return out.select("j", (F.round("g", 3) + F.lit(0.0)).alias("g"), "n")


@query(
    "g4_recurrent_gradient",
    sql("emb", DIFFERENCE, **_numeric(25, f"SELECT *, {dense(_recurrent('tanh'), 23, 2)} AS p FROM emb, pw")),
)
def recurrent_gradient(spark, sf):
    net = SeqNet((8,), (Recurrent(1, "tanh", 2), Dense(1)))
    out = gradients.grad_sum(_seqs(spark, sf), net, weights(net.width))
    return out.select("j", (F.round("g", 3) + F.lit(0.0)).alias("g"), "n")


# --- trained networks -----------------------------------------------------------


def _descent_sql(n, scored, steps, rate):
    """Gradient descent written out, the gradient of each step from differences of the loss."""
    parts = {"q0": _params(n)}
    for i in range(1, steps + 1):
        parts[f"p{i}"] = f"""SELECT j, s, [w[i] + CASE WHEN i = j THEN s*{H} ELSE 0 END FOR i IN range(1, {n + 1})] AS w
            FROM q{i - 1}, range(1, {n + 1}) t(j), (SELECT unnest([1, -1]) AS s)"""
        parts[f"s{i}"] = scored(f"p{i}")
        parts[f"g{i}"] = f"SELECT j, 2*sum(s*(p-y)*(p-y))/(4*{H})/count(*) AS g FROM s{i} GROUP BY j"
        parts[f"q{i}"] = f"SELECT list(w[j] - {rate}*g ORDER BY j) AS w FROM g{i}, q{i - 1}"
    found = [f"SELECT {i} AS step, (j-1)::INT AS j, round(w[j], 5) + 0.0 AS w FROM q{i}, range(1, {n + 1}) t(j)" for i in range(1, steps + 1)]
    return sql("emb", " UNION ALL ".join(found), **parts)


def _trained(rows, net, steps, rate):
    out = training.train(rows, net, weights(net.width), rate, steps=steps).where(F.col("iter") > 0)
    long = out.select(F.col("iter").alias("step"), F.posexplode("w").alias("j", "w"))
    return long.withColumn("w", F.round("w", 5) + F.lit(0.0))


MLP_NET = MLP((64, 5, 1))
MLP_P = f"""SELECT *, {dense('h', 326, 5)} AS p FROM (SELECT *, [1/(1+exp(-(list_dot_product(x, [w[(i-1)*5 + k] FOR i IN range(1, 65)])
    + w[320 + k]))) FOR k IN range(1, 6)] AS h FROM emb, {{params}})"""
MLP_DELTAS = """SELECT *, [h[k]*(1-h[k])*w[325+k]*d FOR k IN range(1, 6)] AS dh FROM (SELECT *, (p-y)*p*(1-p) AS d FROM {scored})"""


def _mlp_descent_sql(steps, rate):
    """As above, with the gradient from back-propagation written out."""
    parts = {"q0": _params(331)}
    for i in range(1, steps + 1):
        parts[f"s{i}"] = MLP_P.format(params=f"q{i - 1}")
        parts[f"d{i}"] = MLP_DELTAS.format(scored=f"s{i}")
        parts[f"g{i}"] = f"""SELECT j, avg(CASE WHEN j <= 320 THEN x[(j-1)//5 + 1]*dh[(j-1)%5 + 1] WHEN j <= 325 THEN dh[j-320]
            WHEN j <= 330 THEN h[j-325]*d ELSE d END) AS g FROM d{i}, range(1, 332) t(j) GROUP BY j"""
        parts[f"q{i}"] = f"SELECT list(w[j] - {rate}*g ORDER BY j) AS w FROM g{i}, q{i - 1}"
    found = [f"SELECT {i} AS step, (j-1)::INT AS j, round(w[j], 5) + 0.0 AS w FROM q{i}, range(1, 332) t(j)" for i in range(1, steps + 1)]
    return sql("emb", " UNION ALL ".join(found), **parts)


@query("o1_mlp_training", _mlp_descent_sql(3, 2.0))
def mlp_training(spark, sf):
    return _trained(emb(spark, sf), MLP_NET, 3, 2.0)


@query("o1_cnn_training", _descent_sql(36, _series_p, 2, 2.0))
def cnn_training(spark, sf):
    """Convolution, sigmoid, max pool and dense layer, two steps over all rows."""
    return _trained(emb(spark, sf), SERIES, 2, 2.0)


@query("o1_rnn_training", _descent_sql(25, lambda params: f"SELECT *, {dense(_recurrent('tanh'), 23, 2)} AS p FROM emb, {params}", 2, 2.0))
def rnn_training(spark, sf):
    """Two tanh cells and a dense layer over eight steps of a sequence."""
    return _trained(_seqs(spark, sf), SeqNet((8,), (Recurrent(1, "tanh", 2), Dense(1))), 2, 2.0)


MLP_GRADIENT = dict(q0=_params(331), s=MLP_P.format(params="q0"), d=MLP_DELTAS.format(scored="s"))


@query(
    "r1_mlp_length_priority",
    sql("emb", """SELECT id, round((list_dot_product(x, x) + 1)*list_dot_product(dh, dh) + (list_dot_product(h, h) + 1)*d*d, 6) + 0.0 AS p
        FROM d""", **MLP_GRADIENT),
)
def mlp_length_priority(spark, sf):
    """Squared gradient lengths layer by layer; no row's gradient is formed."""
    return priority.priorities(emb(spark, sf), MLP_NET, weights(331)).select("id", r6("p").alias("p"))


@query(
    "r2_mlp_projection_priority",
    sql("emb", """SELECT id, round(list_dot_product(g, m), 6) + 0.0 AS p FROM g, m""", **MLP_GRADIENT,
        g="""SELECT id, list_concat([x[(j-1)//5 + 1]*dh[(j-1)%5 + 1] FOR j IN range(1, 321)], dh, [v*d FOR v IN h], [d]) AS g FROM d""",
        m="SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(g[j]) AS m FROM g, range(1, 332) t(j) GROUP BY j)"),
)
def mlp_projection_priority(spark, sf):
    out = priority.priorities(emb(spark, sf), MLP_NET, weights(331), priority.PROJECTION)
    return out.select("id", r6("p").alias("p"))
