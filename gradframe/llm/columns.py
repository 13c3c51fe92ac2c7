"""Column expressions and small plans that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"  # fixed values: what separates words
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK = 256  # matches whose offsets are appended to one array
BROADCAST_ROWS = 200_000  # tables of plain numbers up to this many rows are broadcast


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def private(df: DataFrame) -> str:
    """A prefix that no column of the frame begins with, for columns in between."""
    prefix = "_tmp"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix + "_"


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, dots and spaces in names included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does just that where every character is a single byte; other texts
    go through the slower ``translate``.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def positions(count: Column) -> Column:
    """``0 .. count-1``, empty for zero or less."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def located(text: Column, pattern: str) -> tuple[Column, Column]:
    """All leftmost matches of a pattern, and the pieces of the text around them.

    Piece ``k`` stands before match ``k``, so the place of a match is the length
    of all pieces and matches before it.
    """
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def starts(matches: Column, pieces: Column) -> Column:
    """Code point offset of every match, from the result of :func:`located`.

    Appending to an array copies it, so the offsets are made in chunks: first those of the
    chunks, then those inside each chunk.
    """
    count = F.size(matches)
    chunks = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    within = lambda c: F.sequence(c * CHUNK, F.least(count, (c + 1) * CHUNK) - 1)
    span = lambda k: F.length(F.get(pieces, k)) + F.length(F.get(matches, k))
    begin = lambda at: F.struct(at.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    total = lambda c: F.aggregate(within(c), F.lit(0).cast("bigint"), lambda acc, k: acc + span(k))
    first = lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    bases = F.aggregate(F.transform(chunks, total), begin(F.lit(0)), first, lambda acc: acc["out"])

    def step(acc: Column, k: Column) -> Column:
        here = F.array_append(acc["out"], acc["at"] + F.length(F.get(pieces, k)))
        return F.struct((acc["at"] + span(k)).alias("at"), here.alias("out"))

    inner = lambda c, base: F.aggregate(within(c), begin(base), step, lambda acc: acc["out"])
    return F.flatten(F.zip_with(chunks, bases, inner))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a small table of plain numbers for broadcast after counting its rows.

    The table should have been written before, since it is read twice. Larger ones are
    joined by shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.count() <= limit else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
