"""Prefix trie of conversations, built as a distributed burst trie.

A turn's id is a 128-bit hash of role and text; a conversation is the sequence of its turn ids. Equal
conversations are one class from the start, with the number of its members and the least of
their ids, so copies cost nothing further on.

All classes lie in one suffix container under the root at first. A container of more than
``CONTAINER`` turns under several classes bursts: its node becomes a trie head, the class that ends there stays with
the head, and the others go to containers by their next turn id. This is repeated until no
container is oversized. The remaining containers are dealt to shards, sorted, and swept into nodes: a
sweep keeps only the nodes on the path to the present conversation open. Heads are summed up from
the deepest to the root.

Conversations ending at one node may be any number. Their ids are range-split, joined to pieces in
the ranges, and the pieces hashed one after the other, so no task holds them all.

Defined cases: rows without a conversation id are left out; a null role or text is empty; turns of equal
number (null comes first) are ordered by the hex of :func:`turn_key`; repeated rows are turns of their own; an empty
table has no node, not even a root; other columns are not looked at. A sequence is one row of 16
bytes a turn; texts are not moved beyond the task that reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import text_of
from gradframe.plans import ordered
from gradframe.plans.lineage import cut
from gradframe.session import ship

CONTAINER = 1 << 14  # turns of a suffix container that does not burst
BASE_OF = 5  # conversations that begin alike in the query's rule
SHARED = 9  # turns taken from the base are fewer than these
OUT_ROWS = 10_000
NODE = (
    "head string, root boolean, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, class string"
)


def turn_key(role: Column, text: Column) -> Column:
    """Hex of 256 bits that tell turns apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def turns(df: DataFrame) -> DataFrame:
    """``conv_id, pos, key, bytes``: places from 0, turn ids, bytes of the texts.

    The order is range-split, so a conversation of any length is spread.
    """
    role, text = text_of(df, "role"), text_of(df, "text")
    keyed = df.where(df["conv_id"].isNotNull()).select(
        df["conv_id"].cast("bigint").alias("conv_id"), df["turn"].cast("bigint").alias("turn"),
        turn_key(role, text).alias("hex"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    ranked = ordered.ranked(keyed, ["conv_id"], [F.col("turn").asc_nulls_first(), "hex"], "place")
    return ranked.select(
        "conv_id", (F.col("place") - 1).alias("pos"), F.unhex(F.substring("hex", 1, 32)).alias("key"), "bytes"
    )


def rebuilt(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, key, bytes`` of conversations that begin with turns of another one, by a rule on the id.

    Only the first ``SHARED - 1`` turns of a base are joined. A conversation left without turns has one row of nulls.
    """
    c = F.col("conv_id")
    heads = rows.groupBy("conv_id").agg(F.count("*").alias("length")).select(
        "conv_id", (F.crc32(c.cast("string")) % SHARED).alias("h"), (c - c % BASE_OF).alias("base"), "length"
    )
    heads = cut(heads)
    lengths = heads.select(c.alias("base"), F.col("length").alias("base_length"))
    placed = cut(heads.join(lengths, "base", "left").select(
        "conv_id", "h", "base", "length", F.least("h", F.coalesce("base_length", F.lit(0))).alias("given")
    ))
    first = rows.where(F.col("pos") < SHARED - 1).withColumnRenamed("conv_id", "base")
    taken = placed.join(first, "base").where("pos < h").select("conv_id", "pos", "key", "bytes")
    own = rows.join(placed.select("conv_id", "h", "given"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "key", "bytes")
    none = placed.where("given = 0 and length <= h").select(
        "conv_id", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("bigint").alias("bytes")
    )
    return taken.unionByName(own).unionByName(none)


def trie(rows: DataFrame, container: int = CONTAINER) -> DataFrame:
    """All nodes of the trie of conversations ``conv_id, pos, key, bytes``.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (in a node's subtree: bytes of its last text for each member but one) and ``ends_sha256``.
    """
    ship(rows.sparkSession)
    place = F.struct("pos", "key", "bytes")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), place))).alias("s"))
    members = cut(whole.select(
        "conv_id", F.col("s.key").alias("keys"), F.col("s.bytes").alias("bytes"),
        F.sha2(F.array_join(F.transform("s.key", F.hex), ""), 256).alias("class"),
    ))
    classes = members.groupBy("class").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.min_by(F.struct("keys", "bytes"), "conv_id").alias("s"),
    ).select("class", "n", "least", "s.keys", "s.bytes")

    settled, heads = _burst(classes, container)
    nodes = cut(_swept(settled))
    summed = _summed(heads, nodes)
    firsts = heads.select(F.col("head"), F.col("least").alias("above"))
    # a container's top hangs below a head, all other nodes below one of their container
    below = nodes.where("not root").drop("head", "root")
    tops = nodes.where("root").join(firsts, "head", "left").select(
        "depth", "conv_id", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "class"
    )
    all_nodes = below.unionByName(tops).unionByName(summed)
    empty = hashlib.sha256(b"").hexdigest()
    return all_nodes.join(_ends(members), "class", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def _burst(classes: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """The classes with the containers they settle in, and the heads of containers that burst."""
    state = cut(classes.withColumns({"head": F.lit(""), "up": F.lit(None).cast("string"), "depth": F.lit(0)}))
    settled = heads = None
    while True:
        sizes = state.groupBy("head").agg(
            F.sum(F.size("keys") - F.col("depth")).alias("turns"), F.count("*").alias("several"), F.first("up").alias("up"),
            F.first("depth").cast("bigint").alias("depth"), F.sum("n").alias("n"), F.min("least").alias("least"),
            F.first(F.get("bytes", F.col("depth") - 1)).alias("last"),
            F.max(F.when(F.size("keys") == F.col("depth"), F.col("class"))).alias("class"),
        )
        burst = cut(sizes.where((F.col("turns") > container) & (F.col("several") > 1)).drop("turns", "several"))
        over = burst.select("head", F.lit(True).alias("over"))
        heads = burst if heads is None else heads.unionByName(burst)
        if not burst.take(1):
            settled = state if settled is None else settled.unionByName(state)
            return settled, heads
        marked = state.join(over, "head", "left")
        rest = marked.where("over is null").drop("over")
        settled = rest if settled is None else settled.unionByName(rest)
        step = F.get("keys", F.col("depth"))
        state = cut(marked.where("over").drop("over").where(F.size("keys") > F.col("depth")).select(
            "class", "n", "least", "keys", "bytes", F.sha2(F.concat(F.col("head"), F.hex(step)), 256).alias("head"),
            F.col("head").alias("up"), (F.col("depth") + 1).alias("depth"),
        ))


def _swept(settled: DataFrame) -> DataFrame:
    """Nodes of the remaining containers, each container sorted and swept in one shard.

    ``head`` names the head above a container's top, which alone has ``root``.
    """
    shards = max(settled.sparkSession.sparkContext.defaultParallelism, int(settled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled.repartition(shards, "head").sortWithinPartitions("head", "keys")
    return dealt.select("head", "up", "depth", "keys", "bytes", "n", "least", "class").mapInArrow(_sweep, NODE)


class _Open:
    """A node on the path to the present conversation."""

    def __init__(self, depth: int, last: int, least: int):
        self.depth, self.last, self.least = depth, last, least
        self.n, self.children, self.leaves, self.saved, self.ends = 0, 0, 0, 0, None
        self.below: list[tuple] = []  # children's results, which wait for the least member


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.strip().split()[0] for part in NODE.split(",")]
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in NODE.split(",")])
    out: list[tuple] = []
    path: list[_Open] = []
    now, up, before = None, None, []

    def close() -> None:
        node = path.pop()
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.last
        for depth, least, *rest in node.below:
            out.append((None, False, depth, least, node.least, *rest))
        mine = (node.depth, node.least, node.n, node.children, leaves, saved, node.ends)
        if path:
            above = path[-1]
            above.below.append(mine)
            above.n += node.n
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            above.least = min(above.least, node.least)
        else:
            out.append((up, True, mine[0], mine[1], None, *mine[2:]))

    def ready() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for head, above, depth, keys, sizes, n, least, kind in zip(*[c.to_pylist() for c in batch.columns]):
            if head != now:
                while path:
                    close()
                now, up, before = head, above, keys
                path.append(_Open(depth, sizes[depth - 1] if depth else 0, least))
                same = depth
            else:
                same = depth
                while same < len(keys) and same < len(before) and keys[same] == before[same]:
                    same += 1
                while path[-1].depth > same:
                    close()
                before = keys
            for d in range(same, len(keys)):
                path.append(_Open(d + 1, sizes[d], least))
            end = path[-1]
            end.n += n
            end.ends = kind
            end.least = min(end.least, least)
            if len(out) >= OUT_ROWS:
                yield ready()
                out.clear()
    while path:
        close()
    yield ready()


def _summed(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """The heads as nodes, summed up from the deepest level to the root."""
    sums = nodes.where("root and head is not null").select("head", "n_leaves", "saved_tokens")
    done = None
    first = F.col("above.least").alias("parent_conv_id")
    above = heads.select(F.col("head").alias("up"), F.struct("least").alias("above"))
    deepest = heads.agg(F.max("depth")).first()[0]
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        below = sums.groupBy("head").agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")
        )
        level = cut(heads.where(F.col("depth") == depth).join(below, "head").join(above, "up", "left").select(
            "head", "up", "depth", F.col("least").alias("conv_id"), first, F.col("n").alias("n_convs"), "n_children", "n_leaves",
            (F.col("below") + (F.col("n") - 1) * F.coalesce("last", F.lit(0))).alias("saved_tokens"), "class",
        ))
        sums = sums.unionByName(level.where("up is not null").select(F.col("up").alias("head"), "n_leaves", "saved_tokens"))
        done = level if done is None else done.unionByName(level)
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "class"]
    return done.select(*columns) if done is not None else nodes.where("false").select(*columns)


def _ends(members: DataFrame) -> DataFrame:
    """``class, ends_sha256``: the hash of the members' ids in ascending order, comma-joined."""
    split = ordered.split(members.select("class", "conv_id"), ["class"], ["conv_id"])
    pieces = cut(split.groupBy("class", ordered.RANGE).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    ))
    several = pieces.groupBy("class").agg(F.count("*").alias("pieces")).where("pieces > 1")
    alone = pieces.join(several, "class", "left_anti").select("class", F.sha2("ids", 256).alias("ends_sha256"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for kind, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if kind != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = kind, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_pylist([{"class": k, "ends_sha256": v} for k, v in done], schema=ends)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"class": now, "ends_sha256": digest.hexdigest()}], schema=ends)

    ends = pa.schema([("class", pa.string()), ("ends_sha256", pa.string())])
    rows = pieces.join(several.select("class"), "class", "left_semi").repartition("class").sortWithinPartitions("class", ordered.RANGE)
    return alone.unionByName(rows.select("class", "ids").mapInArrow(chained, "class string, ends_sha256 string"))


#: crc32 of the id's digits: per byte an exclusive or, then eight steps of the polynomial
_CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda acc, op: CASE WHEN op >= 0 THEN xor(acc, op) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384::BIGINT) ELSE acc >> 1 END), 4294967295::BIGINT)"""


def oracle() -> str:
    """The same nodes of the rebuilt conversations in DuckDB."""
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS hex, strlen(text) AS bytes FROM t),
p AS (SELECT conv_id, hex, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, hex) - 1 AS pos FROM k),
c AS (SELECT conv_id, {_CRC} % {SHARED} AS h, conv_id - conv_id % {BASE_OF} AS base FROM (SELECT DISTINCT conv_id FROM p)),
r AS (SELECT c.conv_id, 0 AS part, pos, hex, bytes FROM c JOIN p ON p.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, hex, bytes FROM c JOIN p ON p.conv_id = c.conv_id AND pos >= h),
s AS (SELECT c.conv_id, coalesce(list(hex ORDER BY part, pos) FILTER (hex IS NOT NULL), []) AS keys,
  coalesce(list(bytes ORDER BY part, pos) FILTER (hex IS NOT NULL), []) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
e AS (SELECT conv_id AS member, keys, unnest(range(len(keys) + 1)) AS depth, sizes FROM s),
n AS (SELECT list_slice(keys, 1, depth) AS path, depth, min(member) AS conv_id, count(*) AS n_convs,
  any_value(CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END) AS last_bytes,
  sha256(coalesce(string_agg(CASE WHEN len(keys) = depth THEN member::VARCHAR END, ',' ORDER BY member), '')) AS ends_sha256
  FROM e GROUP BY ALL),
ch AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON n.path = ch.path),
u AS (SELECT list_slice(path, 1, up) AS path, n_convs, last_bytes, n_children FROM (SELECT *, unnest(range(depth + 1)) AS up FROM f)),
a AS (SELECT path, sum((n_convs - 1) * last_bytes)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY path)
SELECT f.conv_id, f.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
FROM f JOIN a ON a.path = f.path LEFT JOIN f above ON f.depth > 0 AND above.depth = f.depth - 1 AND above.path = list_slice(f.path, 1, f.depth - 1)
"""
