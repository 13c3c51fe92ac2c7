"""Scans, sinks and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradframe.catalog.registry import query
from gradframe.catalog.views import DAYS, day_hist, emb, ev, hist, li, local, prio, r6, runs, scratch, sql, table
from gradframe.functions import vec
from gradframe.functions.models import LR
from gradframe.operators import evaluation, prep
from gradframe.sources import fixedrecord, history, images, scores, tables

EV_ROWS = """SELECT id, round(x[1], 6) + 0.0 AS x0, round(x[2], 6) + 0.0 AS x1,
    round(x[3], 6) + 0.0 AS x2, y FROM ev"""


def _event_lines(spark, sf, sep):
    """Events as text in id order: id, x0, x1, x2, y."""
    rows = ev(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    cells = F.concat(F.array(F.col("id").cast("double")), "x", "y").cast("array<string>")
    return rows.select(F.array_join(cells, sep).alias("value"))


def _written(spark, sf, sep, lines=None):
    path = scratch(spark)
    (_event_lines(spark, sf, sep) if lines is None else lines).write.text(path)
    return path


def _flat(df):
    x = lambda j: r6(F.get("x", F.lit(j))).alias(f"x{j}")
    return df.select("id", x(0), x(1), x(2), F.get("y", F.lit(0)).alias("y"))


@query("s1_delimited_scan", sql("ev", EV_ROWS))
def delimited_scan(spark, sf):
    path = _written(spark, sf, ",")
    return _flat(tables.read_table(spark, path, ",", y=[-1], skip=[0]))


@query("s2_tsv_and_long_separator", sql("ev", EV_ROWS + " UNION ALL " + EV_ROWS))
def separators(spark, sf):
    tsv = tables.read_table(spark, _written(spark, sf, "\t"), tables.SEPARATORS["tsv"], skip=[0])
    wide = tables.read_table(spark, _written(spark, sf, "::"), "::", skip=[0])
    return _flat(tsv.unionByName(wide))


@query(
    "s3_sequence_scan",
    sql(
        "ev",
        """SELECT id, (t-1)::INT AS step, round(CASE WHEN t = 1 THEN x[1] ELSE x[1+t] END, 6) + 0.0 AS a, y
        FROM ev, range(1, 3) s(t) WHERE t = 1 OR id % 2 = 1""",
    ),
)
def sequence_scan(spark, sf):
    """Odd ids hold two steps of two numbers, even ids one."""
    rows = ev(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    x = lambda j: F.get("x", F.lit(j))
    one = F.array(x(0), x(1))
    both = F.when(F.col("id") % 2 == 1, F.concat(one, F.array(x(2), F.lit(0.0)))).otherwise(one)
    cells = F.concat("y", both).cast("array<string>")
    path = _written(spark, sf, ",", rows.select(F.array_join(cells, ",").alias("value")))
    seqs = tables.read_sequences(spark, path, unit=2, y=[0])
    return seqs.select("id", "y", F.posexplode("xs").alias("step", "s")).select(
        "id", "step", r6(F.get("s", F.lit(0))).alias("a"), F.get("y", F.lit(0)).alias("y")
    )


def _bytes(spark, sf, pixels):
    """Rows of test bytes per embedding, in id order."""
    rows = emb(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    x = F.transform(
        F.sequence(F.lit(0), F.lit(pixels - 1)),
        lambda j: F.pmod(F.col("id") * 31 + j * 7, F.lit(256)).cast("double"),
    )
    return rows.select(x.alias("x"), F.col("cls").alias("label"), F.pmod("cls", F.lit(2)).alias("coarse"))


def _image_sql(pixels, label="cls"):
    return sql(
        "emb",
        f"""SELECT id, {label}::INT AS label, sum((id*31 + j*7) % 256)::BIGINT AS ink,
        max((id*31 + j*7) % 256)::BIGINT AS top FROM emb, range({pixels}) t(j) GROUP BY id, {label}""",
    )


def _image_rows(df):
    return df.select(
        "id",
        (F.array_position("y", F.lit(1.0)) - 1).cast("int").alias("label"),
        F.aggregate("x", F.lit(0.0), lambda s, v: s + v).cast("bigint").alias("ink"),
        F.array_max("x").cast("bigint").alias("top"),
    )


@query("s4_mnist_scan", _image_sql(784))
def mnist_scan(spark, sf):
    folder = local(scratch(spark))
    rows = _bytes(spark, sf, images.MNIST_PIXELS)
    image_file, label_file = images.MNIST[True]
    fixedrecord.write_records(
        rows, f"{folder}/{image_file}", {"x": ("u1", images.MNIST_PIXELS)}, bytes(images.IMAGE_HEADER)
    )
    fixedrecord.write_records(
        rows, f"{folder}/{label_file}", {"label": ("u1", 0)}, bytes(images.LABEL_HEADER)
    )
    return _image_rows(images.mnist(spark, folder))


@query("s5_cifar10_scan", _image_sql(3072))
def cifar10_scan(spark, sf):
    folder = local(scratch(spark))
    rows = _bytes(spark, sf, images.CIFAR_PIXELS)
    fields = {"label": ("u1", 0), "x": ("u1", images.CIFAR_PIXELS)}
    fixedrecord.write_records(rows, f"{folder}/{images.CIFAR10[False][0]}", fields)
    return _image_rows(images.cifar(spark, folder, 10, train=False))


@query("s6_cifar100_scan", _image_sql(3072))
def cifar100_scan(spark, sf):
    folder = local(scratch(spark))
    rows = _bytes(spark, sf, images.CIFAR_PIXELS)
    fields = {"coarse": ("u1", 0), "label": ("u1", 0), "x": ("u1", images.CIFAR_PIXELS)}
    fixedrecord.write_records(rows, f"{folder}/{images.CIFAR100[True][0]}", fields)
    return _image_rows(images.cifar(spark, folder, 100, train=True))


@query("s8_first_rows", sql("ev", EV_ROWS + " WHERE id < 1000"))
def first_rows(spark, sf):
    return _flat(tables.read_table(spark, _written(spark, sf, ","), skip=[0], first=1000))


@query("s9_sharded_scan", sql("ev", EV_ROWS + " WHERE id % 4 = 1"))
def sharded_scan(spark, sf):
    return _flat(tables.read_table(spark, _written(spark, sf, ","), skip=[0], shard=(4, 1)))


@query(
    "s10_history_table",
    sql(
        "ev day_hist",
        """SELECT what, iter, n, round(time, 6) + 0.0 AS time, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w FROM (
        SELECT 'last' AS what, * FROM day_hist WHERE iter = (SELECT max(iter) FROM day_hist)
        UNION ALL SELECT 'third', iter, time, n, w FROM (
            SELECT *, row_number() OVER (ORDER BY iter) AS r FROM day_hist) WHERE r = 3
        ), range(1, 4) t(j)""",
    ),
)
def history_table(spark, sf):
    path = scratch(spark)
    history.append(day_hist(spark, sf), path)
    table_ = history.read(spark, path)
    last = history.last(table_)
    both = history.rows(spark, [tuple(last)]).withColumn("what", F.lit("last")).unionByName(
        history.nth(table_, 2).withColumn("what", F.lit("third"))
    )
    return both.select("what", "iter", "n", r6("time").alias("time"), F.posexplode("w").alias("j", "w")).withColumn(
        "w", r6("w")
    )


DAY_ROWS = """SELECT iter, n, round(time, 6) + 0.0 AS time, (j-1)::INT AS j, round(w[j], 6) + 0.0 AS w FROM day_hist, range(1, 4) t(j)"""


def _day_rows(table_):
    return table_.select("iter", "n", r6("time").alias("time"), F.posexplode("w").alias("j", "w")).withColumn("w", r6("w"))


@query("s10_history_text", sql("ev day_hist", DAY_ROWS))
def history_text(spark, sf):
    """A history through lines of text."""
    cells = F.concat(F.array(F.col("iter").cast("double"), "time", F.col("n").cast("double")), "w").cast("array<string>")
    whole = F.concat(F.array(F.col("iter").cast("string"), F.col("time").cast("string"), F.col("n").cast("string")), F.slice(cells, 4, 3))
    path = scratch(spark)
    day_hist(spark, sf).select(F.array_join(whole, ",").alias("value")).write.text(path)
    return _day_rows(history.read_text(spark, path))


@query("s10_history_binary", sql("ev day_hist", DAY_ROWS))
def history_binary(spark, sf):
    """A history through packed records."""
    folder = local(scratch(spark))
    fields = {"iter": ("<i4", 0), "time": ("<f8", 0), "n": ("<u8", 0), "w": ("<f8", 3)}
    fixedrecord.write_records(day_hist(spark, sf), folder, fields)
    return _day_rows(history.read_binary(spark, folder, 3))


@query(
    "s10_model_file",
    sql("ev day_hist", """SELECT (row_number() OVER (ORDER BY iter, j) - 1)::INT AS j, round(w[t.j], 6) + 0.0 AS w
        FROM day_hist, range(1, 4) t(j)"""),
)
def model_file(spark, sf):
    """All days' numbers as one model: a line with its shape, then a line per day."""
    path = scratch(spark)
    days = day_hist(spark, sf).select("iter", F.array_join(F.col("w").cast("array<string>"), ",").alias("value"))
    shape = days.agg(F.lit(-1).alias("iter"), F.concat_ws(",", F.count("*").cast("string"), F.lit("3")).alias("value"))
    shape.unionByName(days).orderBy("iter").select("value").coalesce(1).write.text(path)
    return history.read_model(spark, path, shape_line=True).select("j", r6("w").alias("w"))


def _graded(spark, sf):
    return evaluation.gradient_history(ev(spark, sf), LR(3), hist(spark, 4), [(2, 3)])


GRAD_SQL = """SELECT iter, id, (j-1)::INT AS j,
    round((p - y)*(CASE WHEN j <= 3 THEN x[j] ELSE 1 END), 6) + 0.0 AS g FROM (
    SELECT iter, id, x, y, 1/(1+exp(-(list_dot_product(x, w[1:3]) + w[4]))) AS p
    FROM ev, hist3 WHERE iter IN (2, 3)), range(1, 5) t(j)"""


@query("s12_gradient_sink", sql("ev hist3", GRAD_SQL))
def gradient_sink(spark, sf):
    path = scratch(spark)
    scores.write_by_iter(_graded(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("iter", "id", F.posexplode("g").alias("j", "g")).withColumn("g", r6("g"))


PRIO_ROWS = "SELECT iter, id, round(p, 6) + 0.0 AS p FROM prio"


@query("s13_priority_sink", sql("prio", PRIO_ROWS))
def priority_sink(spark, sf):
    """Two runs: the second resumes after the records of the first."""
    path = scratch(spark)
    rows = prio(spark, sf)
    scores.write_by_iter(rows.where(F.col("iter") < DAYS // 2), path)
    scores.write_by_iter(rows, path, done=spark.read.parquet(path))
    return spark.read.parquet(path).select("iter", "id", r6("p").alias("p"))


SCORE_SQL = """SELECT run AS grp, iter, round(time, 6) + 0.0 AS time, round(loss, 6) + 0.0 AS loss FROM runs"""


@query("s14_score_sink", sql("runs", SCORE_SQL))
def score_sink(spark, sf):
    path = scratch(spark)
    rows = runs(spark, sf).withColumnRenamed("run", "grp")
    scores.write_scores(rows.where(F.col("iter") < 3), path)
    scores.write_scores(rows, path, done=spark.read.parquet(path))
    return spark.read.parquet(path).select("grp", "iter", r6("time").alias("time"), r6("loss").alias("loss"))


@query(
    "s15_score_scan",
    sql(
        "runs",
        """SELECT iter::DOUBLE AS iteration, round(time, 6) + 0.0 AS time, 0.0::DOUBLE AS points,
        round(loss, 6) + 0.0 AS loss, run::DOUBLE AS delta FROM runs""",
    ),
)
def score_scan(spark, sf):
    """A 6-column file, read by its layout and upgraded to 7 columns."""
    path = scratch(spark)
    runs(spark, sf).select(
        "iter", "time", "loss", F.lit(0.5), F.lit(0.0).alias("difference"), "run"
    ).write.csv(path)
    seven = scores.upgrade_scores(scores.read_scores(spark, path, 6))
    return seven.select(
        "iteration", r6("time").alias("time"), F.col("data-point").alias("points"), r6("loss").alias("loss"), "delta"
    )


@query("s16_priority_scan", sql("prio", PRIO_ROWS))
def priority_scan(spark, sf):
    """Priorities through a binary file of float64 blocks, one block per iteration."""
    folder = local(scratch(spark))
    rows = prio(spark, sf)
    ids = rows.where(F.col("iter") == 0)
    points = ids.count()
    ordered = rows.repartitionByRange("iter", "id").sortWithinPartitions("iter", "id")
    fixedrecord.write_records(ordered, folder, {"p": ("<f8", 0)})
    back = scores.read_priorities(spark, folder, points, "<f8")
    # users are numbered without gaps from the smallest one
    least = ids.agg(F.min("id")).first()[0] or 0
    return back.select("iter", (F.col("id") + F.lit(least)).alias("id"), r6("p").alias("p"))


@query("s16_gradient_scan", sql("ev hist3", GRAD_SQL.replace("SELECT iter, id,", "SELECT iter - 2 AS iter, id,", 1)))
def gradient_scan(spark, sf):
    """Gradients through a binary file of float64 blocks; blocks are numbered from 0."""
    folder, rows = local(scratch(spark)), _graded(spark, sf)
    ordered = rows.repartitionByRange("iter", "id").sortWithinPartitions("iter", "id")
    fixedrecord.write_records(ordered, folder, {"g": ("<f8", 4)})
    back = scores.read_gradients(spark, folder, ev(spark, sf).count(), 4)
    return back.select("iter", "id", F.posexplode("g").alias("j", "g")).withColumn("g", r6("g"))


@query(
    "s19_target_columns",
    sql("ev", "SELECT id, round(x[1], 6) + 0.0 AS a, round(x[2], 6) + 0.0 AS b, round(x[3], 6) + 0.0 AS c, y AS d FROM ev"),
)
def target_columns(spark, sf):
    """Several label columns: the last two."""
    df = tables.read_table(spark, _written(spark, sf, ","), y=[3, 4], skip=[0])
    x, y = (lambda j: F.get("x", F.lit(j))), (lambda j: F.get("y", F.lit(j)))
    return df.select("id", r6(x(0)).alias("a"), r6(x(1)).alias("b"), r6(y(0)).alias("c"), y(1).alias("d"))


@query(
    "p1_column_roles",
    sql("ev", "SELECT id, round(x[1], 6) + 0.0 AS x0, round(x[3], 6) + 0.0 AS x1, y FROM ev"),
)
def column_roles(spark, sf):
    """A filler -1 among the skipped columns changes nothing."""
    df = tables.read_table(spark, _written(spark, sf, ","), y=[4], skip=[-1, 0, 2])
    x = lambda j: r6(F.get("x", F.lit(j))).alias(f"x{j}")
    return df.select("id", x(0), x(1), F.get("y", F.lit(0)).alias("y"))


@query(
    "p2_line_filter",
    """SELECT count(*) FILTER (event_id % 7 > 1) AS kept, count(*) FILTER (event_id % 7 = 1) AS rejected
    FROM events""",
)
def line_filter(spark, sf):
    """Every 7th line becomes a comment, the one after it loses a cell."""
    rows = ev(spark, sf)
    cells = F.concat(F.array(F.col("id").cast("double")), "x", "y").cast("array<string>")
    kind = F.col("id") % 7
    text = F.array_join(F.when(kind == 1, F.slice(cells, 1, 4)).otherwise(cells), ",")
    path = _written(
        spark, sf, ",", rows.select(F.when(kind == 0, F.concat(F.lit("#"), text)).otherwise(text).alias("value"))
    )
    kept = tables.read_table(spark, path, skip=[0], width=5).agg(F.count("*").alias("kept"))
    bad = tables.read_rejects(spark, path, width=5).agg(F.count("*").alias("rejected"))
    one = F.lit(1)
    return kept.withColumn("k", one).join(bad.withColumn("k", one), "k").drop("k")


@query(
    "p3_scale",
    sql(
        "li",
        """SELECT b.j::INT AS j, round(sum(2*(x[b.j+1]-lo)/(hi-lo)-1), 4) + 0.0 AS total,
        round(min(2*(x[b.j+1]-lo)/(hi-lo)-1), 6) + 0.0 AS low,
        round(max(2*(x[b.j+1]-lo)/(hi-lo)-1), 6) + 0.0 AS high FROM li, b GROUP BY b.j""",
        b="SELECT j, min(x[j+1]) AS lo, max(x[j+1]) AS hi FROM li, range(4) t(j) GROUP BY j",
    ),
)
def scale(spark, sf):
    rows = prep.scale(li(spark, sf), width=4).select(F.posexplode("x").alias("j", "v"))
    return rows.groupBy("j").agg(
        (F.round(F.sum("v"), 4) + F.lit(0.0)).alias("total"), r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high")
    )


@query(
    "p4_shuffle",
    sql("emb", "SELECT count(*) AS n, sum(id)::BIGINT AS ids, TRUE AS moved FROM emb"),
)
def shuffled(spark, sf):
    """All rows, in another order: the order column no longer follows the ids."""
    rows = prep.shuffle(emb(spark, sf).select("id"), seed=7).withColumn(
        "at", F.monotonically_increasing_id()
    )
    return rows.agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"), (F.abs(F.corr("id", "at")) < 0.5).alias("moved")
    )


@query(
    "p5_one_hot",
    sql("emb", "SELECT id, j::INT AS j, CASE WHEN cls = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM emb, range(10) t(j)"),
)
def one_hot(spark, sf):
    return emb(spark, sf).select("id", F.posexplode(vec.one_hot("cls", 10)).alias("j", "v"))


@query("p6_bias_column", sql("emb", "SELECT id, 65 AS width, round(list_sum(x) + 1, 6) + 0.0 AS total FROM emb"))
def bias(spark, sf):
    x = vec.with_bias("x")
    return emb(spark, sf).select("id", F.size(x).alias("width"), r6(vec.total(x)).alias("total"))


@query(
    "p7_cyclic_batch",
    sql(
        "ev",
        """SELECT id, y FROM ev, (SELECT count(*) AS n FROM events)
        WHERE (id - (n - n//30) + n) % n < n//10""",
    ),
)
def cyclic_batch(spark, sf):
    """A tenth of the rows, from a thirtieth before the end on; it wraps."""
    rows = ev(spark, sf)
    total = rows.count()
    return prep.batch_slice(rows, total - total // 30, total // 10, total).select("id", F.get("y", F.lit(0)).alias("y"))


@query(
    "p8_shape_check",
    """SELECT count(*) AS n, 'x holds ' || min(len(embedding) - CASE WHEN vec_id % 10 = 3 THEN 1 ELSE 0 END) || '..'
    || max(len(embedding)) || ' values, not 64' AS refused FROM embeddings""",
)
def shape_check(spark, sf):
    """Whole rows pass; rows of which every tenth lacks a number are refused, and the message says why."""
    rows = emb(spark, sf)
    n = prep.check_shape(rows, 64, 1)
    short = rows.withColumn("x", F.when(F.col("id") % 10 == 3, F.slice("x", 1, 63)).otherwise(F.col("x")))
    try:
        prep.check_shape(short, 64, 1)
        refused = None
    except ValueError as why:
        refused = str(why)
    return spark.createDataFrame([(n, refused)], "n bigint, refused string")


RECORDS = "SELECT iter, id, round(p, 6) + 0.0 AS p FROM prio WHERE iter BETWEEN 2 AND 4 OR iter = 9"


@query("p9_record_filter", sql("prio", RECORDS))
def record_filter(spark, sf):
    return prep.pick_records(prio(spark, sf), [(2, 4), (9, 9)]).select("iter", "id", r6("p").alias("p"))


@query(
    "p10_class_threshold",
    "SELECT event_id AS id, CASE WHEN value/50 >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS c FROM events",
)
def threshold(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), vec.classify(F.col("value") / 50).alias("c")
    )


@query(
    "a6_ranges",
    sql(
        "emb",
        """SELECT (j-1)::INT AS j, round(min(x[j]), 6) + 0.0 AS lo, round(max(x[j]), 6) + 0.0 AS hi
        FROM emb, range(1, 65) t(j) GROUP BY j""",
    ),
)
def ranges(spark, sf):
    return prep.ranges(emb(spark, sf), "x", 64).select("j", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(
    "j2_positional_join",
    sql("emb", "SELECT id, cls AS label, round(x[1], 6) + 0.0 AS first FROM emb"),
)
def positional_join(spark, sf):
    """Numbers and labels from two binary files, joined on the record number."""
    a, b = local(scratch(spark)), local(scratch(spark))
    rows = emb(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    fixedrecord.write_records(rows, a, {"x": ("<f8", 64)})
    fixedrecord.write_records(rows, b, {"cls": ("<i4", 0)})
    left = fixedrecord.decode(fixedrecord.read_records(spark, a, 512), {"x": ("<f8", 64)})
    right = fixedrecord.decode(fixedrecord.read_records(spark, b, 4), {"cls": ("<i4", 0)})
    both = left.select("row", "x").join(right.select("row", "cls"), "row")
    return both.select(
        F.col("row").alias("id"), F.col("cls").cast("int").alias("label"), r6(F.get("x", F.lit(0))).alias("first")
    )


@query("j4_semi_join", sql("prio", "SELECT iter, id, round(p, 6) + 0.0 AS p FROM prio WHERE iter IN (SELECT iter FROM prio WHERE p > 450)"))
def semi_join(spark, sf):
    """Rows of the records that hold some large priority."""
    return prep.holding(prio(spark, sf), F.col("p") > 450).select("iter", "id", r6("p").alias("p"))


@query("j5_anti_join_resume", sql("prio", "SELECT iter, id, round(p, 6) + 0.0 AS p FROM prio WHERE iter NOT IN (SELECT iter FROM prio WHERE p > 450)"))
def anti_join(spark, sf):
    rows = prio(spark, sf)
    done = rows.where(F.col("p") > 450).select("iter")
    return evaluation.pending(rows, done).select("iter", "id", r6("p").alias("p"))


@query(
    "e1_set_overlap",
    """SELECT (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click'
              INTERSECT SELECT user_id FROM events WHERE event_type = 'error')) AS common,
       (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click'
              UNION SELECT user_id FROM events WHERE event_type = 'error')) AS "all" """,
)
def set_overlap(spark, sf):
    from gradframe.operators.prio import jaccard

    e = table(spark, sf, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id")
    return jaccard(of("click"), of("error"), "user_id").select("common", "all")


@query("e2_concatenate", sql("ev hist3", GRAD_SQL))
def concatenate(spark, sf):
    """Gradient tables of single records put together."""
    rows, h = ev(spark, sf), hist(spark, 4)
    one = lambda i: evaluation.gradient_history(rows, LR(3), h, [(i, i)])
    both = one(2).unionByName(one(3))
    return both.select("iter", "id", F.posexplode("g").alias("j", "g")).withColumn("g", r6("g"))
