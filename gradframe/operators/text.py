"""Words of documents as numbers: dictionary and bag of words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gradframe.plans.lineage import checkpoint_dir, cut, spread
from gradframe.plans.ordered import ranked
from gradframe.plans.sizes import BROADCAST_ROWS, small

PUNCTUATION = r"[!-/:-@\[-`{-~]"  # fixed value: the ASCII punctuation characters
BLANK = r"[ \t\n\r\f\x0B]+"
HEAVY_PLACES = 100_000  # of a word in all documents, beyond which its rows are not shuffled


def words(text: str = "text") -> Column:
    """Words of a text: punctuation out, lower case, cut at blanks.

    A blank at either end leaves an empty word, to be dropped after exploding.
    The expression is meant to stand inside ``explode``: as a column of its own
    it would be computed again by the filters that Spark derives for explodes.
    """
    return F.split(F.lower(F.regexp_replace(text, PUNCTUATION, "")), BLANK)


def tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, word)`` of every word of every document."""
    return spread(docs.select("doc_id", "text")).select(
        "doc_id", F.posexplode(words()).alias("pos", "word")
    ).where(F.col("word") != "")


def _counted(docs: DataFrame) -> DataFrame:
    return tokens(docs).groupBy("doc_id", "word").agg(F.count("*").alias("cnt"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, word, cnt)``: how often a word stands in each document.

    The counts are written, since they are read several times: as columns in compressed files, which take a tenth of
    the room of rows in a checkpoint.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/words-{uuid.uuid4().hex}"
    counts = _counted(docs)
    counts.write.parquet(path)
    return spark.read.schema(counts.schema).parquet(path)


def _place(found: DataFrame) -> Column:
    """Order of ``(doc_id, pos)``, nulls first; one number for whole ids, as the least struct of a word takes a sort of all words."""
    if not isinstance(found.schema["doc_id"].dataType, IntegralType):
        return F.struct("doc_id", "pos")
    below = F.expr("-9223372036854775809BD")
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), below) * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos")


def _numbered(docs: DataFrame) -> DataFrame:
    """``(word_id, word, often)`` of all words; ``often`` is the number of a word's places.

    Words meet as their first place and number of places in each task, so documents' words are neither written nor shuffled.
    """
    found = tokens(docs)
    first = found.groupBy("word").agg(F.min(_place(found)).alias("first"), F.count("*").alias("often"))
    numbered = ranked(first, [], ["first"], "word_id")
    return numbered.select((F.col("word_id") - 1).alias("word_id"), "word", "often")


def dictionary(docs: DataFrame) -> DataFrame:
    """``(word_id, word)``, numbered from 0 by first appearance.

    Tasks reduce their words to the first place of each, and only distinct words are
    ordered, in ranges, so neither a frequent word nor a large vocabulary meets in one task.
    """
    return _numbered(docs).select("word_id", "word")


def bag_of_words(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Sparse counts ``(doc_id, word_id, cnt)``.

    Words are counted per document before they meet the dictionary. That is broadcast while it is small. Of
    a larger one only the heavy words are, which stand in more than ``HEAVY_PLACES`` places and so are few; the rest is joined
    by shuffle, where no word has more rows than that.
    """
    numbered = cut(_numbered(docs))
    found = numbered if known is None else known.join(numbered.select("word", "often"), "word")
    total = numbered.count()
    pick = lambda rows: rows.select("doc_id", "word_id", "cnt")
    if total <= BROADCAST_ROWS:
        return pick(_counted(docs).join(small(found.drop("often"), total), "word"))
    counts = word_counts(docs)
    heavy = cut(found.where(F.col("often") > HEAVY_PLACES).drop("often"))
    rest = counts.join(small(heavy.select("word")), "word", "left_anti")
    light = found.where(F.col("often") <= HEAVY_PLACES).drop("often")
    return pick(counts.join(small(heavy), "word")).unionByName(pick(rest.join(light, "word")))
