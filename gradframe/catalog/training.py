"""Scores, gradients, training and k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import (
    centre_params,
    emb,
    ev,
    hist,
    li,
    loss_sql,
    r6,
    scratch,
    sigmoid_sql,
    sql,
    weights,
)
from gradframe.functions.models import LR, MLP, KMeans
from gradframe.operators import evaluation, gradients, hidden, kmeans, scoring, training
from gradframe.operators.progress import Keeping
from gradframe.sources import history

P64, P4, P3 = sigmoid_sql("x", "w", 64), sigmoid_sql("x", "w", 4), sigmoid_sql("x", "w", 3)
LR64, LR4, LR3 = LR(64), LR(4), LR(3)
START = np.full(4, 0.05)


def _w(width):
    return weights(width)


# --- scores -------------------------------------------------------------------


@query("m1_logistic_score", sql("emb w64", f"SELECT id, round({P64}, 6) + 0.0 AS p FROM emb, w64"))
def logistic_score(spark, sf):
    out = scoring.score(emb(spark, sf), LR64, _w(65), keep=["id"])
    return out.select("id", r6(F.get("p", F.lit(0))).alias("p"))


@query(
    "m12_row_loss",
    sql("ev w3", f"SELECT id, round({loss_sql(P3, 'y')}, 6) + 0.0 AS loss FROM ev, w3"),
)
def row_loss(spark, sf):
    return scoring.score(ev(spark, sf), LR3, _w(4), keep=["id"]).select("id", r6("loss").alias("loss"))


@query(
    "a4_mean_loss",
    sql("li w4", f"SELECT round(avg({loss_sql(P4, 'y')}), 6) + 0.0 AS loss, count(*) AS n FROM li, w4"),
)
def mean_loss(spark, sf):
    scored = scoring.score(li(spark, sf), LR4, _w(5), keep=[])
    return scoring.mean_loss(scored).select(r6("loss").alias("loss"), "n")


@query(
    "a5_accuracy",
    sql("li w4", f"SELECT round(avg(CASE WHEN ({P4} >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) + 0.0 AS accuracy FROM li, w4"),
)
def accuracy(spark, sf):
    scored = scoring.score(li(spark, sf), LR4, _w(5), keep=["y"])
    return scoring.accuracy(scored).select(r6("accuracy").alias("accuracy"))


@query(
    "j9_current_parameter",
    sql("ev hist3", f"SELECT id, round({P3}, 6) + 0.0 AS p FROM ev, hist3 WHERE iter = 19"),
)
def current_parameter(spark, sf):
    w = np.array(history.last(hist(spark, 4))["w"])
    out = scoring.score(ev(spark, sf), LR3, w, keep=["id"])
    return out.select("id", r6(F.get("p", F.lit(0))).alias("p"))


MLP_SIZES = (64, 5, 1)
MLP_W = """SELECT list(((37*j) % 11 - 5)/10 ORDER BY j) AS w FROM range(331) t(j)"""
HIDDEN = """[1/(1+exp(-(list_dot_product(x, [w[(i-1)*5 + k] FOR i IN range(1, 65)]) + w[320 + k])))
    FOR k IN range(1, 6)]"""
MLP_H = f"SELECT id, x, y, w, {HIDDEN} AS h FROM emb, mw"
MLP_P = "SELECT *, 1/(1+exp(-(list_dot_product(h, w[326:330]) + w[331]))) AS p FROM hid"


@query(
    "m2_mlp_score",
    sql("emb", "SELECT id, round(p, 6) + 0.0 AS p, round((p-y)*(p-y), 6) + 0.0 AS loss FROM outp",
        mw=MLP_W, hid=MLP_H, outp=MLP_P),
)
def mlp_score(spark, sf):
    m = MLP(MLP_SIZES)
    out = scoring.score(emb(spark, sf), m, _w(m.width), keep=["id"])
    return out.select("id", r6(F.get("p", F.lit(0))).alias("p"), r6("loss").alias("loss"))


@query(
    "m10_nearest_centre",
    sql(
        "emb",
        """SELECT id, z, round(dist, 6) + 0.0 AS dist FROM (
        SELECT a.id, c.id::INT AS z, d AS dist, row_number() OVER (PARTITION BY a.id ORDER BY d, c.id) AS r
        FROM (SELECT a.id, c.id AS cid, sqrt(list_sum([(a.x[j]-c.x[j])*(a.x[j]-c.x[j]) FOR j IN range(1,65)])) AS d
              FROM emb a, emb c WHERE c.id < 10) q
        JOIN emb a ON a.id = q.id JOIN emb c ON c.id = q.cid) WHERE r = 1""",
    ),
)
def nearest_centre(spark, sf):
    rows = emb(spark, sf)
    w = centre_params(_start_centres(rows))
    return scoring.nearest(rows, KMeans(10, 64), w, keep=["id"]).select("id", "z", r6("dist").alias("dist"))


def _start_centres(rows):
    """The first ten points, as a matrix."""
    got = rows.where(F.col("id") < 10).select("id", "x").toPandas().sort_values("id")
    return np.array(got["x"].tolist())


# --- gradients and sums -------------------------------------------------------

EXT = "list_append(x, 1.0::DOUBLE)"


@query(
    "g1_logistic_gradient",
    sql(
        "emb w64",
        f"""SELECT id, (j-1)::INT AS j, round((p-y)*xx[j], 6) + 0.0 AS g
        FROM (SELECT id, y, {EXT} AS xx, {P64} AS p FROM emb, w64), range(1, 66) t(j)""",
    ),
)
def logistic_gradient(spark, sf):
    rows = gradients.gradients(emb(spark, sf), LR64, _w(65), keep=["id"])
    return rows.select("id", F.posexplode("g").alias("j", "g")).withColumn("g", r6("g"))


@query(
    "g2_mlp_gradient",
    sql(
        "emb",
        """SELECT (q-1)::INT AS j, round(sum(CASE
            WHEN q <= 320 THEN x[(q-1)//5 + 1]*dh[(q-1)%5 + 1]
            WHEN q <= 325 THEN dh[q-320]
            WHEN q <= 330 THEN h[q-325]*d ELSE d END), 6) + 0.0 AS g, any_value(n) AS n
        FROM (SELECT *, [h[k]*(1-h[k])*w[325+k]*d FOR k IN range(1,6)] AS dh
              FROM (SELECT *, (p-y)*p*(1-p) AS d, count(*) OVER () AS n FROM outp)), range(1, 332) t(q) GROUP BY q""",
        mw=MLP_W, hid=MLP_H, outp=MLP_P,
    ),
)
def mlp_gradient(spark, sf):
    m = MLP(MLP_SIZES)
    out = gradients.grad_sum(emb(spark, sf), m, _w(m.width))
    return out.select("j", r6("g").alias("g"), "n")


@query(
    "a3_averaged_delta",
    sql(
        "li w4",
        f"""SELECT (j-1)::INT AS j, round(-0.1*avg((p-y)*xx[j]), 6) + 0.0 AS d, count(*) AS n
        FROM (SELECT y, {EXT} AS xx, {P4} AS p FROM li, w4), range(1, 6) t(j) GROUP BY j""",
    ),
)
def averaged_delta(spark, sf):
    out = gradients.grad_sum(li(spark, sf), LR4, _w(5))
    return out.select("j", r6(F.col("g") / F.col("n") * -0.1).alias("d"), "n")


@query(
    "a11_block_mean_gradient",
    sql(
        "ev w3",
        f"""SELECT id // 500 AS block, (j-1)::INT AS j, round(avg((p-y)*xx[j]), 6) + 0.0 AS g, count(*) AS n
        FROM (SELECT id, y, {EXT} AS xx, {P3} AS p FROM ev, w3), range(1, 5) t(j) GROUP BY 1, 2""",
    ),
)
def block_mean_gradient(spark, sf):
    graded = gradients.gradients(ev(spark, sf), LR3, _w(4), keep=["id"])
    return gradients.block_means(graded, 500, 4).select("block", "j", r6("g").alias("g"), "n")


@query(
    "a17_gathered_loss",
    sql(
        "ev w3",
        f"SELECT round(sum({loss_sql(P3, 'y')}), 4) + 0.0 AS loss, count(*) AS n FROM ev, w3 WHERE id % 10 < 3",
    ),
)
def gathered_loss(spark, sf):
    from gradframe.operators.updates import gathered_loss as gather

    scored = scoring.score(ev(spark, sf), LR3, _w(4), keep=["id"])
    return gather(scored, 3, 10).select((F.round("loss", 4) + F.lit(0.0)).alias("loss"), "n")


@query(
    "j8_wide_parameter_update",
    sql(
        "emb w64",
        f"""SELECT (j-1)::INT AS j, round(any_value(w[j]) - 0.5*avg((p-y)*xx[j]), 6) + 0.0 AS w
        FROM (SELECT y, w, {EXT} AS xx, {P64} AS p FROM emb, w64), range(1, 66) t(j) GROUP BY j""",
    ),
)
def wide_update(spark, sf):
    """Parameter and gradient as tables, joined by position."""
    w = _w(65)
    params = spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, w double")
    g = gradients.grad_sum(emb(spark, sf), LR64, w)
    scaled = g.select("j", (F.col("g") / F.col("n")).alias("g"))
    return gradients.apply_wide(params, scaled, -0.5).select("j", r6("w").alias("w"))


# --- training -----------------------------------------------------------------


def _gd_sql(view, width, rate, steps, where="", start="0.05"):
    """Gradient descent as a recursive query over lists."""
    p = sigmoid_sql("x", "w", width)
    return sql(
        view,
        f"""SELECT step::INT AS step, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w
        FROM s, range(1, {width + 2}) t(j) WHERE step > 0""",
        recursive=True,
        s=f"""SELECT 0 AS step, [{start}::DOUBLE FOR i IN range({width + 1})] AS w
        UNION ALL
        SELECT step + 1, list(nw ORDER BY j) FROM (
            SELECT step, j, any_value(w[j]) - {rate}*avg((p-y)*xx[j]) AS nw
            FROM (SELECT step, w, y, {EXT} AS xx, {p} AS p FROM s, {view} WHERE step < {steps} {where}) q,
                 range(1, {width + 2}) t(j) GROUP BY step, j) GROUP BY step""",
    )


def _long(hist_df, name="step"):
    return (
        hist_df.where(F.col("iter") > 0)
        .select(F.col("iter").alias(name), F.posexplode("w").alias("j", "w"))
        .withColumn("w", r6("w"))
    )


@query("o1_gd_5_steps", _gd_sql("emb", 64, 0.5, 5))
def gd_5_steps(spark, sf):
    return _long(training.train(emb(spark, sf), LR64, np.full(65, 0.05), 0.5, steps=5))


@query("o1_gd_full_batch", _gd_sql("li", 4, 0.5, 5))
def gd_full_batch(spark, sf):
    return _long(training.train(li(spark, sf), LR4, np.full(5, 0.05), 0.5, steps=5))


@query(
    "o1_gd_batches",
    _gd_sql(
        "ev", 3, 0.5, 5,
        """AND (id - (step*(SELECT count(*)*3//10 FROM events)) % (SELECT count(*) FROM events) + (SELECT count(*) FROM events))
        % (SELECT count(*) FROM events) < (SELECT count(*)*3//10 FROM events)""",
    ),
)
def gd_batches(spark, sf):
    """Batches of three tenths of the rows that wrap at the end."""
    rows = ev(spark, sf)
    return _long(training.train(rows, LR3, START, 0.5, batch=rows.count() * 3 // 10, steps=5))


@query("t4_synchronous_training", _gd_sql("ev", 3, 0.5, 3))
def synchronous(spark, sf):
    """Four workers with a quarter of the rows each, deltas averaged by 1/4 of rows."""
    rows, w, out = ev(spark, sf), START, []
    for step in range(3):
        parts = [
            gradients.reduce_gradient(rows.where(F.pmod("id", F.lit(4)) == k), LR3, w) for k in range(4)
        ]
        total = sum(n for n, _, _ in parts)
        w = w - 0.5 * sum(g for _, _, g in parts) / total
        out.append((step + 1, 0.0, total, w))
    return _long(history.rows(spark, out))


@query("o9_progress_archive", _gd_sql("ev", 3, 0.5, 6).replace("WHERE step > 0", "WHERE step IN (2, 4, 6)"))
def progress_archive(spark, sf):
    path = scratch(spark)
    return _long(training.train(ev(spark, sf), LR3, START, 0.5, steps=6, archive=path, every=2))


@query("o10_resume", _gd_sql("ev", 3, 0.5, 5))
def resume(spark, sf):
    """Three archived steps, then two more from the last record."""
    path = scratch(spark)
    training.train(ev(spark, sf), LR3, START, 0.5, steps=3, archive=path)
    return _long(
        training.train(ev(spark, sf), LR3, START, 0.5, steps=2, archive=path, resume=True)
    )


MOMENTUM_SQL = sql(
    "ev",
    """SELECT step::INT AS step, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w
    FROM s, range(1, 5) t(j) WHERE step > 0""",
    recursive=True,
    s=f"""SELECT 0 AS step, [0.05::DOUBLE,0.05,0.05,0.05] AS w, [0.0::DOUBLE,0,0,0] AS d
    UNION ALL
    SELECT step + 1, list(w + d ORDER BY j), list(d ORDER BY j) FROM (
        SELECT step, j, any_value(w[j]) AS w, 0.9*any_value(d[j]) - 0.5*avg((p-y)*xx[j]) AS d
        FROM (SELECT step, w, d, y, {EXT} AS xx, {P3} AS p FROM s, ev WHERE step < 4) q,
             range(1, 5) t(j) GROUP BY step, j) GROUP BY step""",
)


@query("o5_momentum", MOMENTUM_SQL)
def momentum(spark, sf):
    return _long(training.train(ev(spark, sf), LR3, START, 0.5, steps=4, optimizer="momentum"))


ADAM_SQL = sql(
    "ev",
    """SELECT step::INT AS step, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w
    FROM s, range(1, 5) t(j) WHERE step > 0""",
    recursive=True,
    s=f"""SELECT 0 AS step, [0.05::DOUBLE,0.05,0.05,0.05] AS w, [0.0::DOUBLE,0,0,0] AS m, [0.0::DOUBLE,0,0,0] AS v
    UNION ALL
    SELECT step + 1,
        list(w - 0.05*(m/(1-power(0.9, step+1)))/(sqrt(v/(1-power(0.999, step+1))) + 1e-8) ORDER BY j),
        list(m ORDER BY j), list(v ORDER BY j) FROM (
        SELECT step, j, w, 0.9*m + 0.1*g AS m, 0.999*v + 0.001*g*g AS v FROM (
        SELECT step, j, any_value(w[j]) AS w, any_value(m[j]) AS m, any_value(v[j]) AS v, avg((p-y)*xx[j]) AS g
        FROM (SELECT step, w, m, v, y, {EXT} AS xx, {P3} AS p FROM s, ev WHERE step < 4) q,
             range(1, 5) t(j) GROUP BY step, j)) GROUP BY step""",
)


@query("o6_adam", ADAM_SQL)
def adam(spark, sf):
    return _long(training.train(ev(spark, sf), LR3, START, 0.05, steps=4, optimizer="adam"))


def _resumed(spark, sf, optimizer, rate):
    """Two archived steps, then two more that go on with the optimizer's state."""
    path = scratch(spark)
    for resume in (False, True):
        out = training.train(ev(spark, sf), LR3, START, rate, steps=2, optimizer=optimizer, archive=path, resume=resume)
    return _long(out)


@query("o10_resume_momentum", MOMENTUM_SQL)
def resume_momentum(spark, sf):
    return _resumed(spark, sf, "momentum", 0.5)


@query("o10_resume_adam", ADAM_SQL)
def resume_adam(spark, sf):
    return _resumed(spark, sf, "adam", 0.05)


@query(
    "o11_logged_training",
    sql(
        "ev",
        """SELECT (step-1)::INT AS iter, round(cost, 6) + 0.0 AS cost, round(delta, 6) + 0.0 AS delta
        FROM s WHERE step > 0""",
        recursive=True,
        s=f"""SELECT 0 AS step, [0.05::DOUBLE,0.05,0.05,0.05] AS w, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS delta
        UNION ALL
        SELECT step + 1, list(w - 0.5*g ORDER BY j), any_value(cost), sum(abs(0.5*g)) FROM (
            SELECT step, j, any_value(w[j]) AS w, avg((p-y)*xx[j]) AS g, avg({loss_sql('p', 'y')}) AS cost
            FROM (SELECT step, w, y, {EXT} AS xx, {P3} AS p FROM s, ev WHERE step < 5) q,
                 range(1, 5) t(j) GROUP BY step, j) GROUP BY step""",
    ),
)
def logged_training(spark, sf):
    log = training.train_logged(ev(spark, sf), LR3, START, 0.5, 5)
    return log.select("iter", r6("cost").alias("cost"), r6("delta").alias("delta"))


# --- k-means ------------------------------------------------------------------


@query(
    "a10_centroids",
    sql(
        "emb",
        """SELECT cls AS z, (j-1)::INT AS j, round(sum(x[j]), 6) + 0.0 AS s, count(*) AS n
        FROM emb, range(1, 65) t(j) GROUP BY cls, j""",
    ),
)
def centroids(spark, sf):
    return kmeans.centres_by(emb(spark, sf), 64, "cls").select("z", "j", r6("s").alias("s"), "n")


D2 = "sqrt(list_sum([(e.x[j]-c.s[j]/c.n)*(e.x[j]-c.s[j]/c.n) FOR j IN range(1,65)]))"
START_CENTRES = "SELECT id AS c, x AS s, 1 AS n FROM emb WHERE id < 10"


def _assign(centres, rows="emb"):
    """Nearest non-empty centre of every row."""
    return f"""SELECT id, x, z, dist FROM (
        SELECT e.id, e.x, c.c AS z, {D2} AS dist,
               row_number() OVER (PARTITION BY e.id ORDER BY {D2}, c.c) AS r
        FROM {rows} e, {centres} c WHERE c.n > 0) WHERE r = 1"""


def _sums(assigned):
    return f"""SELECT z AS c, list(v ORDER BY j) AS s, any_value(n) AS n FROM (
        SELECT z, j, sum(x[j]) AS v, count(*) AS n FROM {assigned}, range(1, 65) t(j) GROUP BY z, j)
        GROUP BY z"""


@query(
    "a18_kmeans_objective",
    sql("emb", "SELECT round(sum(dist), 4) + 0.0 AS total, round(avg(dist), 6) + 0.0 AS mean FROM a1",
        c0=START_CENTRES, a1=_assign("c0")),
)
def kmeans_objective(spark, sf):
    rows = emb(spark, sf)
    out = kmeans.objective(rows, KMeans(10, 64), centre_params(_start_centres(rows)))
    return out.select((F.round("total", 4) + F.lit(0.0)).alias("total"), r6("mean").alias("mean"))


@query(
    "o4_lloyd",
    sql(
        "emb",
        " UNION ALL ".join(
            f"""SELECT {i} AS iter, c::INT AS c, n, round(list_sum(s), 6) + 0.0 AS s,
            (SELECT round(avg(dist), 6) + 0.0 FROM a{i}) AS loss FROM c{i}"""
            for i in (1, 2, 3)
        ),
        c0=START_CENTRES,
        a1=_assign("c0"), c1=_sums("a1"), a2=_assign("c1"), c2=_sums("a2"), a3=_assign("c2"), c3=_sums("a3"),
    ),
)
def lloyd(spark, sf):
    rows = emb(spark, sf)
    out = kmeans.lloyd(rows, 10, 64, centre_params(_start_centres(rows)), 3)
    return _centres_long(out.select("iter", "w", "loss"), ["loss"])


def _centres_long(df, extra=()):
    """One row per non-empty centre: its count and the sum of its coordinates."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda c: F.slice("w", c * 65 + 1, 65)
    )
    rows = df.select("iter", *extra, F.posexplode(parts).alias("c", "b"))
    total = F.aggregate(F.slice("b", 1, 64), F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        "iter", "c", F.get("b", F.lit(64)).cast("bigint").alias("n"), r6(total).alias("s"),
        *[r6(e).alias(e) for e in extra],
    ).where(F.col("n") > 0)


def _em_sql(batches):
    """Centres recomputed from the assignment after every batch."""
    parts = {
        "z0": "SELECT id, x, (id*7) % 10 AS z, 0.0::DOUBLE AS dist FROM emb",
        "c0": _sums("z0"),
    }
    n = "(SELECT count(*) FROM emb)"
    for i in range(1, len(batches) + 1):
        start, size = batches[i - 1]
        inside = f"(o.id - ({start}) % {n} + {n}) % {n} < {size}"
        parts[f"a{i}"] = _assign(f"c{i - 1}")
        parts[f"z{i}"] = f"""SELECT o.id, o.x, CASE WHEN {inside} THEN a.z ELSE o.z END AS z, a.dist
            FROM z{i - 1} o JOIN a{i} a ON a.id = o.id"""
        parts[f"c{i}"] = _sums(f"z{i}")
    return parts


def _initial(ids):
    return (ids * 7) % 10


def _em_body(steps):
    return " UNION ALL ".join(
        f"SELECT {i} AS iter, c::INT AS c, n, round(list_sum(s), 6) + 0.0 AS s FROM c{i}" for i in steps
    )


_FIFTHS = "(SELECT count(*)*2//5 FROM emb)"
THIRDS = [(f"{i}*{_FIFTHS}", _FIFTHS) for i in range(3)]


@query("o2_hidden_state_training", sql("emb", _em_body((0, 1, 2)), **_em_sql([("0", "1000000000")] * 2)))
def hidden_state(spark, sf):
    """Two full passes; every row carries its cluster."""
    out, _ = kmeans.train_em(emb(spark, sf), 10, 64, _initial, None, 2)
    return _centres_long(out)


def _mixture_sql(steps):
    """Three clouds; every step takes two fifths of the rows and keeps the other rows' shares."""
    dim = "range(1, 65)"
    stats = lambda z: f"""SELECT list(n ORDER BY c) AS n, list(m ORDER BY c) AS m, any_value(q) AS q FROM (
        SELECT c, any_value(n) AS n, list(s/n ORDER BY j) AS m, any_value(q) AS q FROM (
            SELECT c, j, sum(z[c]) AS n, sum(z[c]*x[j]) AS s, (SELECT sum(list_dot_product(x, x)) FROM emb) AS q
            FROM {z}, range(1, 4) u(c), {dim} t(j) GROUP BY c, j) GROUP BY c)"""
    width = f"(q - list_sum([n[c]*list_dot_product(m[c], m[c]) FOR c IN [1, 2, 3]]))/(list_sum(n)*64)"
    parts = {"z0": "SELECT id, x, [CASE WHEN id % 3 = c THEN 0.8 ELSE 0.1 END::DOUBLE FOR c IN range(3)] AS z FROM emb", "t0": stats("z0")}
    parts["w0"] = f"SELECT *, {width} AS v FROM t0"
    n = "(SELECT count(*) FROM emb)"
    for i in range(1, steps + 1):
        start, size = THIRDS[i - 1]
        inside = f"(id - ({start}) % {n} + {n}) % {n} < {size}"
        parts[f"e{i}"] = f"""SELECT id, x, z, [n[c]/list_sum(n)*exp(-list_sum([(x[j]-m[c][j])*(x[j]-m[c][j]) FOR j IN {dim}])/(2*v))
            FOR c IN [1, 2, 3]] AS e, 32*ln(2*pi()*v) AS k FROM z{i - 1}, w{i - 1}"""
        parts[f"z{i}"] = f"SELECT id, x, CASE WHEN {inside} THEN [s/list_sum(e) FOR s IN e] ELSE z END AS z FROM e{i}"
        parts[f"l{i}"] = f"SELECT avg(k - ln(list_sum(e))) AS loss, count(*) AS c FROM e{i} WHERE {inside}"
        parts[f"t{i}"] = stats(f"z{i}")
        parts[f"w{i}"] = f"SELECT *, {width} AS v FROM t{i}"
    found = [f"""SELECT {i} AS iter, {f"(SELECT c FROM l{i})" if i else "0::BIGINT"} AS n, {f"(SELECT round(loss, 5) + 0.0 FROM l{i})" if i else "NULL"} AS loss,
        c::INT AS c, round(n[c+1]/list_sum(n), 6) + 0.0 AS share, round(list_sum(m[c+1]), 5) + 0.0 AS centre, round(v, 6) + 0.0 AS variance
        FROM w{i}, range(3) r(c)""" for i in range(steps + 1)]
    return sql("emb", " UNION ALL ".join(found), **parts)


@query("o2_soft_mixture", _mixture_sql(3))
def soft_mixture(spark, sf):
    """Rows share three clouds; a step, then two that go on from the archive."""
    rows, path = emb(spark, sf), scratch(spark)
    size = rows.count() * 2 // 5
    start = lambda ids, X: np.where(ids[:, None] % 3 == np.arange(3), 0.8, 0.1)
    for steps, resume in ((1, False), (2, True)):
        out, _ = hidden.train_hidden(rows, hidden.Mixture(3, 64), start, size, steps, Keeping(path, resume=resume))
    clouds = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.slice("w", c * 65 + 1, 65))
    each = out.select("iter", "n", "loss", F.element_at("w", -1).alias("v"), F.posexplode(clouds).alias("c", "b"))
    centre = F.aggregate(F.slice("b", 2, 64), F.lit(0.0), lambda s, v: s + v)
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return each.select(
        "iter", "n", five("loss").alias("loss"), "c", r6(F.get("b", F.lit(0))).alias("share"), five(centre).alias("centre"), r6("v").alias("variance")
    )


@query(
    "o3_incremental_em",
    sql("emb", _em_body((0, 1, 2, 3)), **_em_sql(THIRDS)),
)
def incremental_em(spark, sf):
    """Batches of two fifths of the rows; the third wraps."""
    rows = emb(spark, sf)
    out, _ = kmeans.train_em(rows, 10, 64, _initial, rows.count() * 2 // 5, 3)
    return _centres_long(out)


@query("o3_resume", sql("emb", _em_body((0, 1, 2, 3)), **_em_sql(THIRDS)))
def resumed_em(spark, sf):
    """An archived step, then two that go on with the rows' clusters."""
    rows, path = emb(spark, sf), scratch(spark)
    size = rows.count() * 2 // 5
    for steps, resume in ((1, False), (2, True)):
        out, _ = kmeans.train_em(rows, 10, 64, _initial, size, steps, Keeping(path, resume=resume))
    return _centres_long(out)


@query(
    "j3_state_join",
    sql("emb", """SELECT z::INT AS z, cls, count(*) AS n FROM z3 JOIN emb ON emb.id = z3.id GROUP BY z, cls""",
        **_em_sql(THIRDS)),
)
def state_join(spark, sf):
    """Points joined with their hidden state."""
    rows = emb(spark, sf)
    _, state = kmeans.train_em(rows, 10, 64, _initial, rows.count() * 2 // 5, 3)
    return rows.join(state, "id").groupBy("z", "cls").agg(F.count("*").alias("n"))


@query(
    "g5_kmeans_move",
    sql(
        "emb",
        """SELECT z::INT AS z, (j-1)::INT AS j, round(sum(sign*(CASE WHEN j <= 64 THEN x[j] ELSE 1 END)), 6) + 0.0 AS s
        FROM (SELECT (id*7) % 10 AS z, -1 AS sign, x FROM a1 WHERE z <> (id*7) % 10
              UNION ALL SELECT z, 1, x FROM a1 WHERE z <> (id*7) % 10), range(1, 66) t(j) GROUP BY 1, 2""",
        c0=START_CENTRES, a1=_assign("c0"),
    ),
)
def kmeans_move(spark, sf):
    rows = emb(spark, sf)
    near = scoring.nearest(rows, KMeans(10, 64), centre_params(_start_centres(rows)), keep=["id", "x"])
    old = F.pmod(F.col("id") * 7, F.lit(10)).cast("int")
    return kmeans.moves(near, old, F.col("z")).select("z", "j", r6("s").alias("s"))


# --- histories ----------------------------------------------------------------


@query(
    "j1_history_by_data",
    sql(
        "ev hist3",
        f"SELECT iter, round(avg({loss_sql(P3, 'y')}), 6) + 0.0 AS loss FROM ev, hist3 GROUP BY iter",
    ),
)
def history_by_data(spark, sf):
    return evaluation.losses(ev(spark, sf), LR3, hist(spark, 4)).select(
        "iter", r6("loss").alias("loss")
    )


@query(
    "h1_evaluate_history",
    sql(
        "li hist4",
        f"""SELECT h.iter, h.time, h.n, loss, accuracy,
        round(sqrt(list_sum([(h.w[j]-r.w[j])*(h.w[j]-r.w[j]) FOR j IN range(1,6)])), 6) + 0.0 AS difference,
        round(sqrt(list_sum([(h.w[j]-coalesce(b.w[j], 0))*(h.w[j]-coalesce(b.w[j], 0)) FOR j IN range(1,6)])), 6) + 0.0 AS delta
        FROM hist4 h JOIN e ON e.iter = h.iter JOIN hist4 r ON r.iter = 19
        LEFT JOIN hist4 b ON b.iter = h.iter - 1""",
        e=f"""SELECT iter, round(avg({loss_sql(P4, 'y')}), 6) + 0.0 AS loss,
        round(avg(CASE WHEN ({P4} >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) + 0.0 AS accuracy
        FROM li, hist4 GROUP BY iter""",
    ),
)
def evaluate_history(spark, sf):
    h = hist(spark, 5)
    reference = np.array(history.last(h)["w"])
    out = evaluation.evaluate(li(spark, sf), LR4, h, reference)
    rounded = ("loss", "accuracy", "difference", "delta")
    return out.select("iter", "time", "n", *[r6(c).alias(c) for c in rounded])


@query(
    "g6_gradient_history",
    sql(
        "ev hist3",
        f"""SELECT iter, id, (j-1)::INT AS j, round((p-y)*xx[j], 6) + 0.0 AS g
        FROM (SELECT iter, id, y, {EXT} AS xx, {P3} AS p FROM ev, hist3 WHERE iter BETWEEN 4 AND 6), range(1, 5) t(j)""",
    ),
)
def gradient_history(spark, sf):
    rows = evaluation.gradient_history(ev(spark, sf), LR3, hist(spark, 4), [(4, 6)])
    return rows.select("iter", "id", F.posexplode("g").alias("j", "g")).withColumn("g", r6("g"))
