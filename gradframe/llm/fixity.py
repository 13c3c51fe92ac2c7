"""Merkle fixity audit of WARC replicas.

Records get their places in an archive from running sums of their lengths. Each replica's
records are hashed; ranges of offsets of fixed width are hashed over the digests of
what begins in them, and wider ranges over those, up to one root. The audit compares
roots and goes down only where digests differ, to the records that were changed, are
missing or were added. Groups hold the records of one range or at most ``FAN`` ranges.

Defined cases: a null url or html counts as empty, a null id as an empty one; equal records are placed one after the
other; pages of any length are hashed whole in the task that reads them; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import bounded_broadcast
from gradframe.plans import ordered
from gradframe.plans.lineage import cut

RANGE_BITS = 16  # bytes of the narrowest ranges, as a power of two
FAN_BITS = 4
HEAD = (  # fixed values: the head of a record, in parts around its values
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:", ">\r\nWARC-Target-URI: ",
    "\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", "\r\n\r\n", "\r\n\r\n",
)


def record(key: Column, url: Column, html: Column) -> Column:
    """One WARC response record as text, its length taken from the UTF-8 bytes."""
    page = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit(HEAD[0]), F.md5(F.coalesce(key.cast("string"), F.lit(""))), F.lit(HEAD[1]),
        F.coalesce(url.cast("string"), F.lit("")), F.lit(HEAD[2]), F.octet_length(page).cast("string"),
        F.lit(HEAD[3]), page, F.lit(HEAD[4]),
    )


def recorded(pages: DataFrame) -> DataFrame:
    """``page_id, record`` of every page."""
    return pages.select(pages["page_id"], record(pages["page_id"], pages["url"], pages["html"]).alias("record"))


def digested(records: DataFrame) -> DataFrame:
    """``page_id, length, sha256`` of every record; no page is shuffled for it."""
    return records.select(
        "page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("sha256")
    )


def digests(pages: DataFrame) -> DataFrame:
    """``page_id, length, sha256`` of every page's record."""
    return digested(recorded(pages))


def placed(records: DataFrame) -> DataFrame:
    """Add ``warc_offset``: records lie in the order of their page ids, those of one id by length and digest."""
    run = ordered.running(records, [], ["page_id", "length", "sha256"], {"_end": F.col("length")})
    return run.select("page_id", (F.col("_end") - F.col("length")).alias("warc_offset"), "length", "sha256")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees over ``replica, warc_offset, sha256``, from records' ranges to the root."""
    top = leaves.agg(F.max("warc_offset")).first()[0] or 0
    bits, levels = RANGE_BITS, []
    below = leaves.select("replica", F.col("warc_offset").alias("place"), F.col("sha256").alias("digest"))
    shift = RANGE_BITS
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "")
        level = cut(
            below.groupBy("replica", F.shiftright("place", shift).alias("node")).agg(F.sha2(joined, 256).alias("digest"))
        )
        levels.append(level)
        if top >> bits == 0:
            return levels
        below, shift, bits = level.withColumnRenamed("node", "place"), FAN_BITS, bits + FAN_BITS


def _differing(level: DataFrame) -> DataFrame:
    """Nodes whose digests are not the same in both replicas."""
    sides = level.groupBy("node").agg(
        F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")
    )
    return sides.where((F.col("n") < 2) | (F.col("x") != F.col("y"))).select("node")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """``warc_offset, status`` of records of ``one`` and ``two`` that differ: changed, missing or added in ``two``.

    Both hold ``warc_offset, sha256`` in one order of offsets.
    """
    leaves = cut(
        one.select(F.lit(1).alias("replica"), "warc_offset", "sha256").union(
            two.select(F.lit(2).alias("replica"), "warc_offset", "sha256")
        )
    )
    levels = tree(leaves)
    suspects = cut(_differing(levels[-1]))
    for level in reversed(levels[:-1]):
        inside = level.join(
            bounded_broadcast(suspects.withColumnRenamed("node", "up")), F.shiftright("node", FAN_BITS) == F.col("up"), "left_semi"
        )
        suspects = cut(_differing(inside))
    records = leaves.join(
        bounded_broadcast(suspects), F.shiftright("warc_offset", RANGE_BITS) == F.col("node"), "left_semi"
    )
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("replica") == k, F.col("sha256"))))
    found = records.groupBy("warc_offset").agg(side(1).alias("a"), side(2).alias("b"))
    return found.where("a <> b").select(
        "warc_offset",
        F.when(F.size("b") == 0, "missing").when(F.size("a") == 0, "added").otherwise("changed").alias("status"),
    )


def _fault(key: Column) -> Column:
    """How the second replica of the test table is damaged: by the digest of the page's id."""
    start = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 2)
    return F.when(start.isin("07", "7e"), "changed").when(start == "2a", "missing")


def audited(pages: DataFrame) -> DataFrame:
    """Audit an archive of all pages against a replica with planted damage.

    The replica is made from the pages a second time: its records are damaged, hashed from their own bytes and
    placed from their own lengths. A changed record has another first byte; a lost one leaves
    a hole of its length.
    """
    whole = recorded(pages)
    first = cut(placed(digested(whole)))
    hurt = F.when(_fault(F.col("page_id")) == "changed", F.concat(F.lit("X"), F.substr("record", F.lit(2)))).otherwise(F.col("record"))
    second = placed(digested(whole.withColumn("record", hurt))).where(F.coalesce(_fault(F.col("page_id")) != "missing", F.lit(True)))
    found = cut(audit(first.select("warc_offset", "sha256"), second.select("warc_offset", "sha256")))
    return first.join(bounded_broadcast(found), "warc_offset", "left").select(
        "page_id", "warc_offset", "length", "sha256", F.coalesce("status", F.lit("same")).alias("status")
    )


def oracle() -> str:
    text = lambda part: "'" + part.replace("\r\n", "' || chr(13) || chr(10) || '") + "'"
    h = [text(part) for part in HEAD]
    return f"""
with records as (select page_id, {h[0]} || md5(coalesce(page_id::varchar, '')) || {h[1]} || coalesce(url, '') || {h[2]}
  || strlen(coalesce(html, ''))::varchar || {h[3]} || coalesce(html, '') || {h[4]} as r from pages),
hashed as (select page_id, strlen(r)::bigint as length, sha256(r) as sha256,
  substr(md5(coalesce(page_id::varchar, '')), 1, 2) as s from records)
select page_id, (sum(length) over (order by page_id nulls first, length, sha256 rows unbounded preceding) - length)::bigint as warc_offset,
  length, sha256, case when s in ('07', '7e') then 'changed' when s = '2a' then 'missing' else 'same' end as status from hashed"""
