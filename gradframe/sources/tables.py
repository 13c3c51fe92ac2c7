"""Labelled numeric rows from delimited text.

A row becomes ``(id, x, y)``: ``id`` is the running number of the kept line,
``x`` the columns that are neither labels nor skipped, ``y`` the labels.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut
from gradframe.plans.sizes import small

COMMENT = "#"  # fixed value: lines starting so are no data
SEPARATORS = {"csv": ",", "tsv": "\t"}  # fixed values


def lines(spark: SparkSession, path: str | list[str], header: bool = False) -> DataFrame:
    """Data lines of text files: no header, comment or empty lines."""
    return (
        spark.read.schema("value string")
        .options(sep="\u0001", quote="", header=header, comment=COMMENT, maxCharsPerColumn=-1)
        .csv(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        .where(F.length(F.trim("value")) > 0)
    )


def number_rows(df: DataFrame, name: str = "id") -> DataFrame:
    """Number rows 0, 1, 2, ... by file, block and place, without a global sort.

    ``df`` carries ``_file`` and ``_block`` from :func:`lines`. Only one count
    per file block is brought together; the counts are written, so that the text is read
    once for them and once for the rows.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    blocks = cut(placed.groupBy("_file", "_block").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    ))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return placed.join(small(starts, blocks.count()), ["_file", "_block"]).select(
        (F.col("_start") + F.col("_place") - F.col("_first")).alias(name),
        *[c for c in df.columns if c not in ("_file", "_block")],
    )


def _cells(sep: str) -> Column:
    return F.transform(
        F.split("value", re.escape(sep)), lambda c: F.trim(c).try_cast("double")
    )


def _leading_files(spark: SparkSession, path: str | list[str], first: int, count: Callable) -> list[str]:
    """Files in the order of their names that hold ``first`` rows, or all; ``count(files)`` gives the rows of some.

    They are tried in steps that double, so no more is read than twice what is needed, in whole files.
    """
    files = sorted(unquote(file) for file in spark.read.text(path).inputFiles())
    taken, found, step = 0, 0, 1
    while taken < len(files) and found < first:
        found += count(files[taken : taken + step])
        taken, step = taken + step, 2 * step
    return files[:taken]


def _parsed(spark, path, sep, header, width):
    rows = lines(spark, path, header).withColumn("_cells", _cells(sep))
    if width is None:
        first = rows.select(F.size("_cells")).first()
        width = first[0] if first else 0
    good = (F.size("_cells") == width) & ~F.exists("_cells", lambda c: c.isNull())
    return rows, good, width


def _good(spark, path, sep, header, width):
    rows, good, _ = _parsed(spark, path, sep, header, width)
    return rows.where(good)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    y: Sequence[int] = (-1,),
    skip: Sequence[int] = (),
    header: bool = False,
    first: int = 0,
    shard: tuple[int, int] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Read rows; negative ``y`` counts from the end, -1 in ``skip`` is a filler.

    The first line fixes the number of columns unless ``width`` does. ``first``
    keeps exactly that many rows (0 for all) and reads no files beyond those that hold them, ``shard=(n, p)`` the rows whose
    number is p modulo n.
    """
    rows, good, width = _parsed(spark, path, sep, header, width)
    if first:
        of = lambda files: _good(spark, files, sep, header, width).count()
        path = _leading_files(spark, path, first, of)
        rows, good, width = _parsed(spark, path, sep, header, width)
    labels = [c % width for c in y] if width else []
    dropped = {c for c in skip if c >= 0}
    xs = [i for i in range(width) if i not in dropped and i not in labels]
    pick = lambda ids: F.array(*[F.get("_cells", F.lit(i)) for i in ids]).cast("array<double>")
    out = number_rows(
        rows.where(good).select("_file", "_block", pick(xs).alias("x"), pick(labels).alias("y"))
    )
    return _limited(out, first, shard)


def read_sequences(
    spark: SparkSession,
    path: str | list[str],
    unit: int,
    y: Sequence[int] = (0,),
    sep: str = ",",
    first: int = 0,
    header: bool = False,
) -> DataFrame:
    """Rows of any length: label columns and a run cut into steps of ``unit``."""
    rows = lines(spark, path, header).withColumn("_cells", _cells(sep))
    labels = F.array(*[F.lit(c) for c in y]).cast("array<int>")
    run = F.filter("_cells", lambda c, i: ~F.array_contains(labels, i))
    rows = rows.withColumn("_run", run).where(
        (F.size("_cells") > max(y, default=-1))
        & (F.size("_run") > 0)
        & (F.size("_run") % unit == 0)
        & ~F.exists("_cells", lambda c: c.isNull())
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.size("_run"), F.lit(unit)), lambda s: F.slice("_run", s, unit)
    )
    ys = F.array(*[F.get("_cells", F.lit(i)) for i in y]).cast("array<double>")
    return _limited(
        number_rows(rows.select("_file", "_block", steps.alias("xs"), ys.alias("y"))), first, None
    )


def read_rejects(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    header: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Lines that :func:`read_table` leaves out: wrong width or not numeric."""
    rows, good, _ = _parsed(spark, path, sep, header, width)
    return rows.where(~good).select(F.col("_file").alias("file"), F.col("value").alias("line"))


def _limited(df: DataFrame, first: int, shard: tuple[int, int] | None) -> DataFrame:
    if first:
        df = df.where(F.col("id") < first)
    if shard:
        df = df.where(F.pmod("id", F.lit(shard[0])) == shard[1])
    return df


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """Write ``x`` then ``y`` as delimited text."""
    cells = F.concat("x", F.col("y").cast("array<double>"))
    df.select(F.array_join(cells.cast("array<string>"), sep).alias("value")).write.mode(mode).text(path)
