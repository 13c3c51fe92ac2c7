"""I-Match fingerprints from randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies in a band, found by counting
over all distinct sets of terms. The lower edge of the band bounds the lexicon: a term needs 1/RARE
of all documents, so there are at most RARE times as many terms as a document has on
average. Each of several random subsets of the lexicon, of several densities, gives one hash
of the sorted distinct terms that a text has in it. The likeness of two fingerprints is the share of
subsets that agree, at the sparsest density at which both texts still fill enough subsets.

Terms are kept as 64-bit hashes. All of it is DataFrame functions; a document's text is shuffled
once, to lie beside its successor, and its terms are not shuffled again.

Defined cases: a null text counts as empty; texts of any length are read whole; a text with few lexicon terms has a fingerprint
of the same kind over all its terms beside it, so its near copies are still like it; rows without an id come last, have no
successor and are edited with nothing; repeated ids follow each other in the order of
their texts; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradframe.llm.columns import bounded_broadcast, lower_ascii, text_of, words
from gradframe.plans import ordered
from gradframe.plans.lineage import cut

COMMON = 0.2  # terms in more than this share of documents are left out
RARE = 2_000  # so are terms in less than one of this many
LEAST_DF = 2
SPARSER = (0, 2, 4, 7)  # at each density a subset holds 1 / (SUBSETS * 2 ** s) of the lexicon
SUBSETS = 32  # of each density, disjoint; at most 128 in all
FILLED = 10  # subsets of both texts that must hold terms to compare at a density
ENOUGH = 16  # filled subsets of the lexicon, below which all terms of a text count too
BLOCK = 128  # neighbouring ids that are brought together
LEXICON_ROWS = 1_000_000  # 64-bit numbers; a larger lexicon is joined by shuffle
SPREAD = 1 << 20
ENTRY_BITS = 24
ALL_TERMS = -1 << 31  # sign of entries over all terms of a text, not only over those of the lexicon


def terms(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(words(lower_ascii(text)))


def lexicon(docs: DataFrame) -> DataFrame:
    """``h`` of every term whose share of distinct sets of terms lies in the band.

    Each of the documents with one set of terms counts as that part of it, so none is brought together for it.
    """
    keyed = docs.select(F.transform(terms(F.col("text")), lambda x: F.xxhash64(x)).alias("hs")).select(
        "hs", F.xxhash64(F.sort_array("hs")).alias("key")
    )
    often = cut(keyed.groupBy("key").agg(F.count("*").alias("n")))
    count = often.count()
    repeated = bounded_broadcast(often.where("n > 1"))
    spread = keyed.join(repeated, "key", "left").select(
        F.explode("hs").alias("h"), (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("share")
    )
    found = spread.groupBy("h").agg(F.round(F.sum("share")).alias("df"))
    return found.where(
        (F.col("df") >= max(LEAST_DF, -(-count // RARE))) & (F.col("df") <= max(LEAST_DF, COMMON * count))
    ).select("h")


def _with_next(docs: DataFrame) -> DataFrame:
    """``block, doc_id, rank, text, next``: every text with the one that follows in descending order of ids.

    Ids are brought together in blocks; a block's last text is followed by the first
    of the next lower block that holds documents, the very last by the very first.
    """
    block = F.when(
        F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SPREAD)) - (1 << 62)
    ).otherwise(F.floor(F.col("doc_id") / BLOCK))
    placed = docs.withColumn("block", block.cast("bigint"))
    heads = cut(
        placed.where("doc_id is not null").groupBy("block").agg(F.max(F.struct("doc_id", "text"))["text"].alias("head"))
    )
    below = ordered.lagged(heads.select("block"), [], ["block"], F.col("block"), "below")
    top = heads.agg(F.max("block")).first()[0]
    after = below.select("block", F.coalesce("below", F.lit(top)).alias("below")).join(
        heads.select(F.col("block").alias("below"), "head"), "below"
    )
    falling = Window.partitionBy("block").orderBy(F.col("doc_id").desc(), F.col("text").desc())
    ranked = placed.select(
        "block", "doc_id", F.row_number().over(falling).alias("rank"), "text", F.lead("text").over(falling).alias("near")
    )
    follows = F.when(F.col("doc_id").isNull(), "").otherwise(F.coalesce("near", "head", F.lit("")))
    return ranked.join(after.select("block", "head"), "block", "left").select(
        "block", "doc_id", "rank", "text", follows.alias("next")
    )


def _subset(h: Column, sparser: int) -> Column:
    """Number of the subset that a term is in at a density, null for none."""
    mixed = F.xxhash64(h, F.lit(sparser))
    number = F.lit(SPARSER.index(sparser) * SUBSETS) + F.pmod(F.shiftright(mixed, 20), F.lit(SUBSETS)).cast("int")
    return F.when(F.pmod(mixed, F.lit(1 << sparser)) == 0, number)


def _numbers(h: Column) -> Column:
    """Numbers of all subsets that a term is in."""
    return F.array_compact(F.array(*[_subset(h, s) for s in SPARSER]))


def _bits(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")


def _entry(number: Column, members: Column) -> Column:
    """The entry of a subset: its number, then 24 bits of a hash of its sorted distinct terms."""
    return F.shiftleft(number, ENTRY_BITS).bitwiseOR(_bits(F.xxhash64(F.sort_array(members)), ENTRY_BITS))


def _whole_entries(found: Column) -> Column:
    """The entries of one array of distinct terms."""
    members = F.flatten(F.transform(found, lambda h: F.transform(_numbers(h), lambda k: F.struct(k.alias("k"), h.alias("h")))))
    numbers = lambda m: F.array_distinct(F.transform(m, lambda x: x["k"]))
    of = lambda m, k: F.transform(F.filter(m, lambda x: x["k"] == k), lambda x: x["h"])
    return F.get(F.transform(F.array(members), lambda m: F.transform(numbers(m), lambda k: _entry(k, of(m, k)))), 0)


def _fingerprints(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Fingerprints of ``text`` and ``edited`` of every row, as arrays of entries.

    A text's terms stay in its partition: the join is a broadcast and the rows are grouped by what
    they are partitioned by. A text whose lexicon terms fill few subsets of the first density gets the entries of
    all its terms too, as negative numbers.
    """
    key = ("block", "doc_id", "rank")
    hashed = lambda c: F.transform(terms(F.col(c)), lambda x: F.xxhash64(x))
    sides = rows.select(
        *key,
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), hashed("text").alias("every")),
                          F.struct(F.lit(1).alias("side"), hashed("edited").alias("every")))).alias("x"),
    ).select(*key, "n_chars", "edited_sha256", F.col("x.side").alias("side"), F.col("x.every").alias("every"))
    note = F.struct("n_chars", "edited_sha256", "every")
    # a null leads the terms of each text and carries what belongs to the text as a whole
    spread = sides.select(
        *key, "side", note.alias("note"), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.col("every"))).alias("h")
    ).select(*key, "side", F.when(F.col("h").isNull(), F.col("note")).alias("note"), "h")
    small = known.count() <= LEXICON_ROWS
    marked = known.select("h", _numbers(F.col("h")).alias("numbers"))
    near = spread.join(F.broadcast(marked) if small else marked, "h", "left").where("h is null or numbers is not null")
    members = near.select(*key, "side", "note", "h", F.explode(F.coalesce("numbers", F.array(F.lit(-1)))).alias("k"))
    subsets = members.groupBy(*key, "side", "k").agg(F.collect_list("h").alias("hs"), F.first("note", True).alias("note"))
    entry = F.when(F.col("k") >= 0, _entry(F.col("k"), F.col("hs"))).alias("e")
    found = subsets.select(*key, "side", "note", entry).groupBy(*key, "side").agg(
        F.sort_array(F.collect_list("e")).alias("known_fp"), F.first("note", True).alias("note")
    )
    few = F.size(F.filter("known_fp", lambda e: e < SUBSETS << ENTRY_BITS)) < ENOUGH
    whole = F.transform(_whole_entries(F.col("note.every")), lambda e: e.bitwiseOR(F.lit(ALL_TERMS)))
    made = found.select(*key, "side", "note", F.when(few, F.concat("known_fp", F.sort_array(whole))).otherwise(F.col("known_fp")).alias("fp"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("fp")))
    return made.groupBy(*key).agg(
        F.max("note.n_chars").alias("n_chars"), F.max("note.edited_sha256").alias("edited_sha256"),
        of(0).alias("fp"), of(1).alias("edited_fp"),
    )


def likeness(one: Column, two: Column) -> Column:
    """Share of subsets in which both agree, at the sparsest density that both fill well enough.

    Subsets of the lexicon come first, those of all terms are for texts with too few lexicon terms. If only one
    has too few, both have no more than those few in common.
    """

    def at(fp: Column, j: int, base: int) -> Column:
        low = base + (j * SUBSETS << ENTRY_BITS)
        return F.filter(fp, lambda e: e.between(low, low + (SUBSETS << ENTRY_BITS) - 1))

    def share(j: int, base: int) -> Column:
        a, b = at(one, j, base), at(two, j, base)
        number = lambda e: F.shiftright(e, ENTRY_BITS)
        either = F.size(F.array_union(F.transform(a, number), F.transform(b, number)))
        return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)

    full = lambda fp, j, base: F.size(at(fp, j, base)) >= FILLED
    choice = F.when(F.lit(False), F.lit(0.0))
    for base in (0, ALL_TERMS):
        for j in reversed(range(len(SPARSER))):
            choice = choice.when(full(one, j, base) & full(two, j, base), share(j, base))
    without = lambda fp: F.exists(fp, lambda e: e < 0)
    return choice.when(without(one) & without(two), share(0, ALL_TERMS)).otherwise(share(0, 0)).cast("double")


def spelled(fp: Column) -> Column:
    """A fingerprint as text: its entries in hexadecimal."""
    return F.array_join(F.transform(fp, lambda e: F.lower(F.hex(e))), " ")


def fingerprinted(df: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    docs = df.select(df["doc_id"].cast("bigint").alias("doc_id"), text_of(df).alias("text"))
    known = cut(lexicon(docs))
    part = F.floor(F.length("text") / 3).cast("int")
    kept = F.left(F.col("text"), (F.length("text") - part).cast("int"))
    edited = _with_next(docs).withColumn("edited", F.concat(kept, F.left(F.col("next"), part))).drop("next")
    # written first: a range split reads its input twice
    prints = cut(_fingerprints(edited, known).withColumn("place", -F.col("rank")).drop("block", "rank"))
    rows = ordered.split(prints, [], ["doc_id", "place"])
    named = rows.where("doc_id is not null")
    following = ordered.lagged(named, [], ["doc_id", "place"], F.col("fp"), "next_fp")
    # the text after the last is the first
    first = named.agg(F.max(F.struct("doc_id", "place", "fp"))["fp"].alias("fp")).first()["fp"]
    wrapped = (F.array(*[F.lit(e) for e in first]) if first else F.array()).cast("array<int>")
    every = following.withColumn("next_fp", F.coalesce("next_fp", wrapped)).unionByName(
        rows.where("doc_id is null").withColumn("next_fp", F.lit(None).cast("array<int>"))
    )
    return every.select(
        "doc_id", "n_chars", "edited_sha256",
        spelled(F.col("fp")).alias("fingerprint"), spelled(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp")), F.lit(0.0)).alias("near_next"),
    )
