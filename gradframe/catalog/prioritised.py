"""Priorities, their decay, selection of top rows, prioritised training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import emb, ev, hist, prio, r6, scratch, sigmoid_sql, sql, weights
from gradframe.functions.models import LR
from gradframe.operators import evaluation, gradients, priority, prep
from gradframe.operators.progress import Keeping
from gradframe.plans.topk import top_k

P64, P3 = sigmoid_sql("x", "w", 64), sigmoid_sql("x", "w", 3)
LR64, LR3 = LR(64), LR(3)
EXT = "list_append(x, 1.0::DOUBLE)"
W3 = weights(4)


def _graded(view, wide):
    """Rows with gradient list ``g`` under the fixed weights."""
    w, p = ("w64", P64) if wide else ("w3", P3)
    return f"SELECT id, x, y, [(p-y)*v FOR v IN {EXT}] AS g FROM (SELECT *, {p} AS p FROM {view}, {w})"


MEAN = """SELECT list(m ORDER BY j) AS m FROM (
    SELECT j, avg(g[j]) AS m FROM g, range(1, {n}) t(j) GROUP BY j)"""
LENGTH = "list_dot_product(g, g)"


@query(
    "r1_length_priority",
    sql("emb w64", f"SELECT id, round({LENGTH}, 6) + 0.0 AS p FROM g", g=_graded("emb", True)),
)
def length_priority(spark, sf):
    return priority.priorities(emb(spark, sf), LR64, weights(65)).select("id", r6("p").alias("p"))


@query(
    "r2_projection_priority",
    sql(
        "emb w64",
        "SELECT id, round(list_dot_product(g, m), 6) + 0.0 AS p FROM g, m",
        g=_graded("emb", True),
        m=MEAN.format(n=66),
    ),
)
def projection_priority(spark, sf):
    out = priority.priorities(emb(spark, sf), LR64, weights(65), priority.PROJECTION)
    return out.select("id", r6("p").alias("p"))


@query(
    "r6_initial_priorities",
    sql(
        "ev w3",
        f"""SELECT 'length' AS how, id, round({LENGTH}, 6) + 0.0 AS p FROM g
        UNION ALL SELECT 'projection', id, round(list_dot_product(g, m), 6) + 0.0 FROM g, m""",
        g=_graded("ev", False),
        m=MEAN.format(n=5),
    ),
)
def initial_priorities(spark, sf):
    rows = ev(spark, sf)
    of = lambda how: priority.priorities(rows, LR3, W3, how).select(
        F.lit(how).alias("how"), "id", r6("p").alias("p")
    )
    return of("length").unionByName(of("projection"))


def _series(spark, sf):
    return prio(spark, sf).select("id", F.col("iter").alias("ver"), "p")


@query("r3_decay_keep", sql("prio", "SELECT id, round(p, 6) + 0.0 AS p FROM prio WHERE iter = 29"))
def decay_keep(spark, sf):
    return priority.fold_decay(_series(spark, sf), priority.Keep()).select("id", r6("p").alias("p"))


@query(
    "r4_decay_linear",
    sql(
        "prio",
        """SELECT id, round(p, 6) + 0.0 AS p, iter::BIGINT AS ver, round(a, 6) + 0.0 AS a,
        round(ln(p*exp(a*2)), 6) + 0.0 AS ahead FROM s WHERE iter = 29""",
        recursive=True,
        s="""SELECT id, iter, p, 0.0::DOUBLE AS a FROM prio WHERE iter = 0
        UNION ALL SELECT n.id, n.iter, n.p, 0.8*ln(n.p/s.p) + 0.2*s.a
        FROM s JOIN prio n ON n.id = s.id AND n.iter = s.iter + 1""",
    ),
)
def decay_linear(spark, sf):
    model = priority.ExpLinear()
    out = priority.fold_decay(_series(spark, sf), model)
    ahead = F.log(model.at(F.lit(31)))
    return out.select("id", r6("p").alias("p"), "ver", r6("a").alias("a"), r6(ahead).alias("ahead"))


@query(
    "r5_decay_quadratic",
    sql(
        "prio",
        "SELECT id, round(p, 6) + 0.0 AS p, iter::BIGINT AS ver, round(a, 6) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM s WHERE iter = 29",
        recursive=True,
        s="""SELECT id, iter, p, 0.0::DOUBLE AS a, -1.0::DOUBLE AS b, NULL::DOUBLE AS rate FROM prio WHERE iter = 0
        UNION ALL SELECT id, iter, p, CASE WHEN rate IS NULL THEN 0 ELSE 0.8*bend + 0.2*a END,
            CASE WHEN rate IS NULL THEN r ELSE 0.8*(r - bend*(2*iter - 1)) + 0.2*b END, r
        FROM (SELECT n.id, n.iter, n.p, ln(n.p/s.p) AS r, (ln(n.p/s.p) - s.rate)/2 AS bend, s.a, s.b, s.rate
              FROM s JOIN prio n ON n.id = s.id AND n.iter = s.iter + 1)""",
    ),
)
def decay_quadratic(spark, sf):
    out = priority.fold_decay(_series(spark, sf), priority.ExpQuadratic())
    b = F.round("b", 4) + F.lit(0.0)
    return out.select("id", r6("p").alias("p"), "ver", r6("a").alias("a"), b.alias("b"))


@query(
    "r7_renew_slice",
    sql(
        "ev w3",
        f"""SELECT id, round(CASE WHEN id < (SELECT count(*)//4 FROM events) THEN list_dot_product(h, h) ELSE {LENGTH} END, 6) + 0.0 AS p
        FROM (SELECT g.*, [(p2 - y)*v FOR v IN {EXT}] AS h FROM (
              SELECT g.*, 1/(1+exp(-list_dot_product(x, [0.1, 0.2, 0.3]) - 0.4)) AS p2 FROM g) g)""",
        g=_graded("ev", False),
    ),
)
def renew_slice(spark, sf):
    """Priorities of the first quarter of the rows renewed under another parameter."""
    rows = ev(spark, sf)
    decay = priority.Keep()
    state = priority.priorities(rows, LR3, W3)
    total = rows.count()
    part = prep.batch_slice(rows, 0, total // 4, total)
    fresh = priority.priorities(part, LR3, np.array([0.1, 0.2, 0.3, 0.4]))
    return priority.renew(state, fresh, decay, 1, total // 4).select("id", r6("p").alias("p"))


@query(
    "k1_top_points",
    sql("ev w3", f"SELECT id, round({LENGTH}, 6) + 0.0 AS p FROM g ORDER BY {LENGTH} DESC, id LIMIT 100",
        g=_graded("ev", False)),
)
def top_points(spark, sf):
    return top_k(priority.priorities(ev(spark, sf), LR3, W3), 100, "p", "id").select("id", r6("p").alias("p"))


@query(
    "k1_top_points_by_selection",
    sql("ev", "SELECT id, round(x[2], 6) + 0.0 AS p FROM ev ORDER BY x[2] DESC, id LIMIT 3333"),
)
def top_points_by_selection(spark, sf):
    """Many equal values, and the selection that needs no heap of k rows."""
    rows = ev(spark, sf).select("id", F.get("x", F.lit(1)).alias("p"))
    return top_k(rows, 3333, "p", "id", heap_rows=50).select("id", r6("p").alias("p"))


@query(
    "k2_top_in_batch",
    sql("ev w3", f"""SELECT id, round({LENGTH}, 6) + 0.0 AS p FROM g, (SELECT count(*)//10 AS t FROM events)
        WHERE id >= 2*t AND id < 5*t ORDER BY {LENGTH} DESC, id LIMIT 50""", g=_graded("ev", False)),
)
def top_in_batch(spark, sf):
    rows = ev(spark, sf)
    total = rows.count()
    part = prep.batch_slice(rows, 2 * (total // 10), 3 * (total // 10), total)
    return top_k(priority.priorities(part, LR3, W3), 50, "p", "id").select("id", r6("p").alias("p"))


PAIRS = """SELECT id, j - 1 AS j, g[j] AS g, abs(g[j]*s.v) AS size FROM g, range(1, 5) t(j)
    JOIN (SELECT k, sum(g[k]) AS v FROM g, range(1, 5) u(k) GROUP BY k) s ON s.k = t.j
    ORDER BY size DESC, id, j LIMIT 1000"""


@query(
    "k3_top_pairs",
    sql("ev w3", "SELECT id, j::INT AS j, round(g, 6) + 0.0 AS g, round(size, 4) + 0.0 AS size FROM pairs",
        g=_graded("ev", False), pairs=PAIRS),
)
def top_pairs(spark, sf):
    rows = ev(spark, sf)
    _, _, total = gradients.reduce_gradient(rows, LR3, W3)
    pairs = priority.top_pairs(gradients.gradients(rows, LR3, W3, keep=["id"]), total, 1000)
    return pairs.select("id", "j", r6("g").alias("g"), (F.round("size", 4) + F.lit(0.0)).alias("size"))


@query(
    "a12_pair_sums",
    sql("ev w3", "SELECT j::INT AS j, round(sum(g), 6) + 0.0 AS g, count(*) AS n FROM pairs GROUP BY j",
        g=_graded("ev", False), pairs=PAIRS),
)
def pair_sums(spark, sf):
    rows = ev(spark, sf)
    _, _, total = gradients.reduce_gradient(rows, LR3, W3)
    pairs = priority.top_pairs(gradients.gradients(rows, LR3, W3, keep=["id"]), total, 1000)
    return priority.pair_sums(pairs).select("j", r6("g").alias("g"), "n")


# --- training on top rows -----------------------------------------------------


STATE = ("p", "ver", "a", "b", "rate", "both")


def _fresh_sql(decay, now):
    """New state columns of a row ``o`` whose priority ``r.p`` was renewed at version ``now``."""
    if decay == "keep":
        return {**{c: f"o.{c}" for c in STATE}, "p": "r.p", "ver": now}
    gap = f"({now} - o.ver)"
    ratio = "(CASE WHEN o.p <> 0 AND r.p/o.p > 0 THEN ln(r.p/o.p) ELSE 0 END)"
    slope = f"({ratio}/nullif({gap}, 0))"
    if decay == "linear":
        fresh = {"p": "r.p", "ver": now, "a": f"0.8*{slope} + 0.2*o.a"}
    else:
        both = f"({now} + o.ver)::DOUBLE"
        bend = f"(({slope} - o.rate)/nullif({both} - o.both, 0))"
        fresh = {
            "p": "r.p", "ver": now, "rate": slope, "both": both,
            "a": f"CASE WHEN o.rate IS NULL THEN 0 ELSE 0.8*{bend} + 0.2*o.a END",
            "b": f"CASE WHEN o.rate IS NULL THEN {slope} ELSE 0.8*({slope} - {bend}*{both}) + 0.2*o.b END",
        }
    return {c: f"CASE WHEN {gap} = 0 THEN o.{c} ELSE {fresh[c]} END" if c in fresh else f"o.{c}" for c in STATE}


def _renewed_sql(old, fresh, decay, now):
    columns = _fresh_sql(decay, now)
    return f"""SELECT o.id, {", ".join(f"CASE WHEN r.id IS NULL THEN o.{c} ELSE {columns[c]} END AS {c}" for c in STATE)}
        FROM {old} o LEFT JOIN {fresh} r ON r.id = o.id"""


def _value_sql(decay, now):
    if decay == "linear":
        return f"p*exp(a*({now}-ver))"
    return f"p*exp(a*({now}*{now}-ver*ver) + b*({now}-ver))" if decay == "quadratic" else "p"


def _steps_sql(steps, renew, k, rate, decay="keep", how="length", variation=""):
    """Prioritised training unrolled step by step (renew, select, apply)."""
    n = "(SELECT count(*) FROM events)"
    rn, kk = f"floor({n}*{renew})::BIGINT", f"floor({n}*{k})::BIGINT"
    parts = {"nn": f"SELECT floor(count(*)*{renew})/count(*) AS f, floor(count(*)*{k})/count(*) AS t FROM events"}
    parts["q0"] = "SELECT [((37*j) % 11 - 5)/10 FOR j IN range(4)] AS w"
    grad = lambda wq: (
        f"SELECT id, x, y, [(p-y)*v FOR v IN {EXT}] AS g FROM (SELECT *, {P3} AS p FROM ev, {wq})"
    )
    mean = lambda src: f"SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(g[j]) AS m FROM {src}, range(1, 5) t(j) GROUP BY j)"
    moved = lambda old, new, f: f"SELECT [(1 - nn.{f})*o.m[j] + nn.{f}*f.m[j] FOR j IN [1,2,3,4]] AS m FROM {old} o, {new} f, nn"
    dot = "list_dot_product(g, g)" if how == "length" else "list_dot_product(g, m)"
    parts["g0"] = grad("q0")
    parts["m0"] = mean("g0")
    parts["s0"] = f"SELECT id, {dot} AS p, 0::BIGINT AS ver, 0.0::DOUBLE AS a, -1.0::DOUBLE AS b, NULL::DOUBLE AS rate, NULL::DOUBLE AS both FROM g0, m0"
    for i in range(1, steps + 1):
        now = f"({i}*(({rn} + {kk}) // 32))" if "p" in variation else f"{i}"
        parts[f"g{i}"] = grad(f"q{i - 1}")
        inside = f"(o.id - ({i - 1}*{rn}) % {n} + {n}) % {n} < {rn}"
        parts[f"f{i}"] = f"SELECT id, {dot} AS p, g FROM g{i} o, m{i - 1} WHERE {inside}"
        parts[f"r{i}"] = _renewed_sql(f"s{i - 1}", f"f{i}", decay, now)
        parts[f"fm{i}"] = mean(f"f{i}")
        parts[f"d{i}"] = moved(f"m{i - 1}", f"fm{i}", "f")
        parts[f"t{i}"] = f"SELECT id FROM r{i} ORDER BY {_value_sql(decay, now)} DESC, id LIMIT (SELECT {kk})"
        parts[f"h{i}"] = f"SELECT id, {dot} AS p, g FROM g{i} SEMI JOIN t{i} USING (id), d{i}"
        parts[f"s{i}"] = _renewed_sql(f"r{i}", f"h{i}", decay, now) if "l" in variation else f"SELECT * FROM r{i}"
        parts[f"tm{i}"] = mean(f"h{i}")
        parts[f"m{i}"] = moved(f"d{i}", f"tm{i}", "t") if "a" in variation else f"SELECT m FROM d{i}"
        also = " + f.m[j]" if "r" in variation else ""
        parts[f"q{i}"] = f"SELECT [w[j] - {rate}*(t.m[j]{also}) FOR j IN [1,2,3,4]] AS w FROM q{i - 1}, tm{i} t, fm{i} f"
    return parts


def _w_body(steps):
    return " UNION ALL ".join(
        f"SELECT {i} AS step, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w FROM q{i}, range(1, 5) t(j)"
        for i in range(1, steps + 1)
    )


def _long(df):
    return (
        df.where(F.col("iter") > 0)
        .select(F.col("iter").alias("step"), F.posexplode("w").alias("j", "w"))
        .withColumn("w", r6("w"))
    )


@query("r8_top_gradient_step", sql("ev", _w_body(1), **_steps_sql(1, 0.2, 0.01, 0.5)))
def top_gradient_step(spark, sf):
    rows = ev(spark, sf)
    k = int(rows.count() * 0.01)
    ids = top_k(priority.priorities(rows, LR3, W3), k, "p", "id")
    _, _, g = priority.top_gradient(rows, ids, k, LR3, W3)
    w = W3 - 0.5 * g / k
    return spark.createDataFrame([(1, j, float(v)) for j, v in enumerate(w)], "step int, j int, w double").withColumn(
        "w", r6("w")
    )


@query("r9_prioritised_training", sql("ev", _w_body(3), **_steps_sql(3, 0.2, 0.05, 0.5)))
def prioritised_training(spark, sf):
    out, _ = priority.train_prioritised(ev(spark, sf), LR3, W3, 0.5, 0.05, 0.2, steps=3)
    return _long(out)


@query("r9_prioritised_linear_decay", sql("ev", _w_body(3), **_steps_sql(3, 0.4, 0.05, 0.5, "linear")))
def prioritised_linear(spark, sf):
    """Slices of 40%, so that the third step renews rows a second time."""
    out, _ = priority.train_prioritised(
        ev(spark, sf), LR3, W3, 0.5, 0.05, 0.4, decay="linear", steps=3
    )
    return _long(out)


@query("r9_prioritised_projection", sql("ev", _w_body(2), **_steps_sql(2, 0.2, 0.05, 0.5, how="projection")))
def prioritised_projection(spark, sf):
    out, _ = priority.train_prioritised(
        ev(spark, sf), LR3, W3, 0.5, 0.05, 0.2, init="projection", how="projection", steps=2
    )
    return _long(out)


def _variation(name, decay, variation, steps=3, how="length", renew=0.4):
    """A query that renews 40% of the rows in a step, so that rows are renewed again from the third step on."""

    @query(name, sql("ev", _w_body(steps), **_steps_sql(steps, renew, 0.05, 0.5, decay, how, variation)))
    def run(spark, sf):
        out, _ = priority.train_prioritised(
            ev(spark, sf), LR3, W3, 0.5, 0.05, renew, init=how, how=how, decay=decay, variation=variation, steps=steps
        )
        return _long(out)


_variation("r9_renewed_rows_added", "keep", "r")
_variation("r9_top_rows_renewed", "linear", "l")
_variation("r9_mean_moved_by_top_rows", "keep", "a", how="projection")
_variation("r9_versions_by_points", "linear", "p")
_variation("r9_quadratic_decay", "quadratic", "", steps=4, renew=0.6)


@query("r9_resume", sql("ev", _w_body(4), **_steps_sql(4, 0.4, 0.05, 0.5, "linear", "projection", "l")))
def prioritised_resume(spark, sf):
    """Two archived steps, then two more from their state: priorities, mean gradient, version and place."""
    path, rows = scratch(spark), ev(spark, sf)
    for resume in (False, True):
        out, _ = priority.train_prioritised(
            rows, LR3, W3, 0.5, 0.05, 0.4, "projection", "projection", "linear", "l", steps=2, keeping=Keeping(path, resume=resume)
        )
    return _long(out)


@query(
    "r15_priority_log",
    sql(
        "ev",
        """SELECT 1 AS iter, id, round(p, 6) + 0.0 AS p FROM s1
        UNION ALL SELECT 2, id, round(p, 6) + 0.0 FROM s2""",
        **_steps_sql(2, 0.2, 0.05, 0.5),
    ),
)
def priority_log(spark, sf):
    path = scratch(spark)
    priority.train_prioritised(ev(spark, sf), LR3, W3, 0.5, 0.05, 0.2, steps=2, log=path)
    return spark.read.parquet(path).select("iter", "id", r6("p").alias("p"))


@query("r13_exact_points", sql("ev", _w_body(2), **_steps_sql(2, 1.0, 0.05, 0.5)))
def exact_points(spark, sf):
    """All priorities renewed in every step."""
    return _long(priority.train_exact(ev(spark, sf), LR3, W3, 0.5, 0.05, steps=2))


@query(
    "r14_exact_dimensions",
    sql(
        "ev w3",
        f"""SELECT 1 AS step, (t.j-1)::INT AS j, round(w[t.j] - coalesce(0.5*s.g/s.n/kk, 0), 6) + 0.0 AS w
        FROM w3 CROSS JOIN range(1, 5) t(j) CROSS JOIN (SELECT floor(count(*)*0.1*4) AS kk FROM events) k
        LEFT JOIN (SELECT j, sum(g) AS g, count(*) AS n FROM pairs GROUP BY j) s ON s.j = t.j - 1""",
        g=_graded("ev", False),
        pairs=PAIRS.replace("LIMIT 1000", "LIMIT (SELECT floor(count(*)*0.1*4)::BIGINT FROM events)"),
    ),
)
def exact_dimensions(spark, sf):
    return _long(priority.train_dimensions(ev(spark, sf), LR3, W3, 0.5, 0.1, steps=1))


def _batch_variant_sql(steps, block=None):
    """Renew a quarter of the rows, take the top 5% of a batch of 40%, renew these too; unrolled.

    With ``block`` the direction is the sum of block means, else a mean that keeps 0.9 of itself.
    """
    n = "(SELECT count(*) FROM events)"
    rn, size = f"floor({n}*0.25)::BIGINT", f"({n}//10*4)"
    kk = f"round({size}*0.05)::BIGINT"
    grad = lambda wq: f"SELECT id, x, y, [(p-y)*v FOR v IN {EXT}] AS g FROM (SELECT *, {P3} AS p FROM ev, {wq})"
    each = "range(1, 5) t(j)"
    mean = lambda src: f"SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(g[j]) AS m FROM {src}, {each} GROUP BY j)"
    means = lambda src: f"""SELECT k, list(m ORDER BY j) AS m, any_value(c) AS c FROM (
        SELECT id // {block} AS k, j, avg(g[j]) AS m, count(*) AS c FROM {src}, {each} GROUP BY 1, 2) GROUP BY k"""
    summed = lambda src: f"SELECT list(m ORDER BY j) AS m FROM (SELECT j, sum(m[j]) AS m FROM {src}, {each} GROUP BY j)"
    kept = lambda old, new: f"SELECT [0.9*o.m[j] + (1 - 0.9)*f.m[j] FOR j IN [1,2,3,4]] AS m FROM {old} o, {new} f"
    dot = "list_dot_product(g, m)"
    parts = {"q0": "SELECT [((37*j) % 11 - 5)/10 FOR j IN range(4)] AS w", "g0": grad("q0")}
    if block:
        parts["b0"] = means("g0")
    parts["m0"] = summed("b0") if block else mean("g0")
    parts["s0"] = f"SELECT id, {dot} AS p FROM g0, m0"
    inside = lambda start, count: f"(o.id - ({start}) % {n} + {n}) % {n} < {count}"
    for i in range(1, steps + 1):
        parts[f"g{i}"] = grad(f"q{i - 1}")
        parts[f"f{i}"] = f"SELECT id, {dot} AS p, g FROM g{i} o, m{i - 1} WHERE {inside(f'{i - 1}*{rn}', rn)}"
        if block:
            parts[f"n{i}"] = means(f"f{i}")
            parts[f"b{i}"] = f"""SELECT o.k, CASE WHEN f.k IS NULL THEN o.m
                ELSE [o.m[j]*(1 - f.c/{block}) + f.m[j]*f.c/{block} FOR j IN [1,2,3,4]] END AS m FROM b{i - 1} o LEFT JOIN n{i} f ON f.k = o.k"""
            parts[f"d{i}"] = summed(f"b{i}")
        else:
            parts[f"n{i}"] = mean(f"f{i}")
            parts[f"d{i}"] = kept(f"m{i - 1}", f"n{i}")
        parts[f"r{i}"] = f"SELECT o.id, coalesce(f.p, o.p) AS p FROM s{i - 1} o LEFT JOIN f{i} f ON f.id = o.id"
        parts[f"t{i}"] = f"SELECT id FROM r{i} o WHERE {inside(f'{i - 1}*{size}', size)} ORDER BY p DESC, id LIMIT (SELECT {kk})"
        parts[f"h{i}"] = f"SELECT id, {dot} AS p, g FROM g{i} SEMI JOIN t{i} USING (id), d{i}"
        parts[f"s{i}"] = f"SELECT o.id, coalesce(h.p, o.p) AS p FROM r{i} o LEFT JOIN h{i} h ON h.id = o.id"
        parts[f"tm{i}"] = mean(f"h{i}")
        parts[f"m{i}"] = f"SELECT m FROM d{i}" if block else kept(f"d{i}", f"tm{i}")
        parts[f"q{i}"] = f"SELECT [w[j] - 0.5*t.m[j] FOR j IN [1,2,3,4]] AS w FROM q{i - 1}, tm{i} t"
    return parts


@query("r11_block_variant", sql("ev", _w_body(5), **_batch_variant_sql(5, 1000)))
def block_variant(spark, sf):
    """Blocks of 1000 ids, a quarter of the rows renewed, the top 5% of a batch of 40%; slices and batches wrap."""
    rows = ev(spark, sf)
    out, _, _ = priority.train_block(
        rows, LR3, W3, 0.5, 0.05, 1000, 0.25, batch=rows.count() // 10 * 4, steps=5
    )
    return _long(out)


@query("r12_decayed_mean_variant", sql("ev", _w_body(5), **_batch_variant_sql(5)))
def decayed_mean_variant(spark, sf):
    """Three steps and two resumed ones; slices and batches wrap."""
    rows, path = ev(spark, sf), scratch(spark)
    size = rows.count() // 10 * 4
    for steps, resume in ((3, False), (2, True)):
        out, _ = priority.train_decayed_mean(
            rows, LR3, W3, 0.5, 0.05, 0.9, 0.25, batch=size, steps=steps, keeping=Keeping(path, resume=resume)
        )
    return _long(out)


HIST_G = f"SELECT iter, id, [(p-y)*v FOR v IN {EXT}] AS g FROM (SELECT *, {P3} AS p FROM ev, hist3)"


@query(
    "r16_priority_history",
    sql("ev hist3", f"SELECT iter, id, round({LENGTH}, 6) + 0.0 AS p FROM g WHERE iter BETWEEN 3 AND 5", g=HIST_G),
)
def priority_history(spark, sf):
    """Records 1 to 5, of which 1 and 2 are there already."""
    h = hist(spark, 4)
    done = h.where(F.col("iter") <= 2)
    out = evaluation.priority_history(ev(spark, sf), LR3, h, "length", [(1, 5)], done)
    return out.select("iter", "id", r6("p").alias("p"))


@query(
    "r16_projection_history",
    sql(
        "ev hist3",
        "SELECT g.iter, id, round(list_dot_product(g, m), 6) + 0.0 AS p FROM g JOIN m ON m.iter = g.iter",
        g=HIST_G + " WHERE iter IN (3, 7)",
        m="""SELECT iter, list(m ORDER BY j) AS m FROM (
        SELECT iter, j, avg(g[j]) AS m FROM g, range(1, 5) t(j) GROUP BY iter, j) GROUP BY iter""",
    ),
)
def projection_history(spark, sf):
    out = evaluation.priority_history(ev(spark, sf), LR3, hist(spark, 4), "projection", [(3, 3), (7, 7)])
    return out.select("iter", "id", r6("p").alias("p"))
