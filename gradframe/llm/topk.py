"""Exact top-k search by inner product over quantised vectors, by MaxScore.

A component ``x`` becomes the integer ``floor(256 * x)``. A vector is taken as a document that holds
one term for each dimension, the pair of dimension and value; a query gives the term ``(t, v)`` the
score ``q[t] * v``, which is at once the term's bound. Rows are packed into shards where they are read;
a shard holds for each dimension the postings of its vectors by value.

Within a shard the terms of a query are split at a level ``c``: terms that score more than ``c``
are essential, all others are not. A vector's other terms together score at most the sum over dimensions
of ``min(c, highest score there)``; ``c`` is the greatest level for which this stays below the query's k-th best
score so far. So a vector without an essential term cannot enter the result, and only the postings of
essential terms are traversed. Vectors found there are probed some dimensions at a time, the
weightiest first, while their score so far and the bounds that are left still compete; what is
left is scored exactly.

Queries are the rows whose id is divisible by ``every``; they go in blocks to all shards, first to one
shard each for a k-th best score to begin with, then to all others. The shards' results are merged.

Defined cases: rows without an id, null vectors and vectors with null or non-finite components
take no part; components that shorter vectors lack count as zero; equal ids are rows of their own, and only the
query's own row is left out of its result; an empty table gives an empty result; other columns are
not looked at. Scores are exact integers, held within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradframe.plans.lineage import cut
from gradframe.plans.sizes import BROADCAST_BYTES
from gradframe.session import ship

SCALE = 256
K = 5
EVERY = 50
SHARD_ROWS = 4096
SHARD_BYTES = 4 << 20  # of one shard's vectors, about
BLOCK_ROWS = 256  # queries that travel together
BLOCK_BYTES = 1 << 20
PROBED = 16  # dimensions between two looks at which vectors still compete
SLACK = 1e-9  # of the greatest possible score: sums of doubles are no more than this away from the integers
FEW = 64  # competing vectors that are scored at once
EXACT = 1 << 53  # whole numbers that doubles hold
LONG = (-(1 << 63), (1 << 63) - 1)
LARGEST = np.finfo(np.float64).max
TABLE = [("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("ids", pa.binary())]
QUERIES = [*TABLE, ("homes", pa.binary()), ("places", pa.binary())]
HIT = "shard bigint, place bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles; those that overflow a double are the largest one."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vector.astype(np.float64)), -LARGEST, LARGEST)


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in fields)


def _packed(parts: list[np.ndarray], **numbers: list[int]) -> pa.RecordBatch:
    """One row with vectors as a table, shorter ones filled with zeros, and numbers beside them."""
    table = np.zeros((len(parts), max(map(len, parts))))
    for row, part in zip(table, parts):
        row[: len(part)] = part
    kind = "int16" if table.size and np.abs(table).max() < 1 << 15 else "float64"
    values = [len(parts), table.shape[1], kind, table.astype(kind).tobytes()]
    values += [np.array(c, np.int64).tobytes() for c in numbers.values()]
    fields = TABLE[:4] + [(name, pa.binary()) for name in numbers]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, fields)], names=[n for n, _ in fields])


def _table(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["width"]).astype(np.float64)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}


def shards(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``shard, n, width, kind, vectors, ids``: the rows packed where they are read; no shuffle, so no hot key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, width = [], [], 0
        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(name)
                parts.append(quantised(row.values.to_numpy(zero_copy_only=False)))
                width = max(width, len(parts[-1]))
                if len(ids) == SHARD_ROWS or 8 * width * len(ids) > SHARD_BYTES:
                    yield _packed(parts, ids=ids)
                    ids, parts, width = [], [], 0
        if ids:
            yield _packed(parts, ids=ids)

    ship(df.sparkSession)
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    rows = df.where(df[key].isNotNull() & df[vector].isNotNull() & F.forall(df[vector], finite))
    made = rows.select(df[key].cast("bigint").alias("id"), df[vector].alias("vector")).mapInArrow(pack, _ddl(TABLE))
    return cut(made.select(F.monotonically_increasing_id().alias("shard"), "*"))


def _asked(packed: DataFrame, every: int) -> DataFrame:
    """The queries in blocks, with the shard and the place of each; ``shard`` is the first one's."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, homes, places, parts, width = [], [], [], [], 0
        for row in _rows(batches):
            own, table = _longs(row["ids"]), _table(row)
            for place in np.flatnonzero(own % every == 0).tolist():
                ids.append(int(own[place]))
                homes.append(row["shard"])
                places.append(place)
                parts.append(table[place])
                width = max(width, len(parts[-1]))
                if len(ids) == BLOCK_ROWS or 8 * width * len(ids) > BLOCK_BYTES:
                    yield _packed(parts, ids=ids, homes=homes, places=places)
                    ids, homes, places, parts, width = [], [], [], [], 0
        if ids:
            yield _packed(parts, ids=ids, homes=homes, places=places)

    made = packed.mapInArrow(gather, _ddl(QUERIES)).select(F.monotonically_increasing_id().alias("block"), "*")
    return cut(made)


class Postings:
    """The vectors of a shard, and for each dimension its vectors in the order of their values."""

    def __init__(self, table: np.ndarray, ids: np.ndarray):
        self.table, self.ids, (self.n, self.width) = table, ids, table.shape
        self.order = np.argsort(table, axis=0, kind="stable").T.astype(np.int32).copy()
        self.values = np.sort(table, axis=0).T.copy()
        self.columns = table.T.copy()
        self.peak = np.abs(table).max(axis=0, initial=0)

    def best(self, query: np.ndarray, k: int, floor: float, own: int) -> list[tuple[int, int]]:
        """``id, score`` of the ``k`` best vectors that score at least ``floor``; ``own`` is the query's place here or -1."""
        q = np.zeros(self.width)
        q[: len(query)] = query[: self.width]
        with np.errstate(over="ignore"):
            slack = 1 + SLACK * float((np.abs(q) * self.peak).sum())
            found = self.competing(q, floor - slack)
        found = found[found != own]
        hits = sorted(zip(self.scores(q, found), self.ids[found].tolist()), key=lambda h: (-h[0], h[1]))
        return [(name, score) for score, name in hits if score >= floor][:k]

    def competing(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Places of all vectors that score ``floor`` or more, and few others."""
        highest = np.maximum(q * self.values[:, 0], q * self.values[:, -1])
        level = split_level(highest, floor)
        if level == -np.inf:
            return np.arange(self.n)
        bound = np.minimum(highest, level)
        docs, gains = [], []
        for t in np.flatnonzero(highest > level):  # the essential terms of dimension t are those beyond level / q[t]
            values = self.values[t]
            if q[t] > 0:
                part = slice(values.searchsorted(level / q[t], "right"), None)
            elif q[t] < 0:
                part = slice(None, values.searchsorted(level / q[t], "left"))
            else:
                part = slice(None)
            docs.append(self.order[t, part])
            gains.append(q[t] * values[part] - bound[t])
        if not docs:
            return np.empty(0, np.int64)
        docs = np.concatenate(docs)
        limit = np.bincount(docs, np.concatenate(gains), self.n) + bound.sum()
        seen = np.zeros(self.n, bool)
        seen[docs] = True
        probes = np.argsort(-np.abs(q) * self.peak, kind="stable")
        for d in probes[:PROBED]:  # an essential term is in the limit already
            limit += np.minimum(q[d] * self.columns[d] - bound[d], 0)
        found = np.flatnonzero(seen & (limit >= floor))
        limit = limit[found]
        for low in range(PROBED, self.width, PROBED):
            if len(found) < FEW:
                break
            dims = probes[low : low + PROBED]
            terms = q[dims] * self.table[np.ix_(found, dims)]
            limit += np.minimum(terms - bound[dims], 0).sum(axis=1)
            keep = limit >= floor
            found, limit = found[keep], limit[keep]
        return found

    def scores(self, q: np.ndarray, places: np.ndarray) -> list[int]:
        """Exact inner products, held within 64 bits."""
        rows = self.table[places]
        if float((np.abs(q) * self.peak).sum()) < EXACT:
            return (rows @ q).astype(np.int64).tolist()
        own, (low, high) = [int(x) for x in q], LONG
        return [min(high, max(low, sum(a * int(b) for a, b in zip(own, row)))) for row in rows]


def split_level(highest: np.ndarray, floor: float) -> float:
    """The greatest level for which the sum of ``min(level, highest)`` is below ``floor``; -inf if none is known."""
    if not np.isfinite(floor) or not np.isfinite(highest).all():
        return -np.inf
    if highest.sum() < floor:
        return np.inf
    order = np.sort(highest)
    before = np.concatenate([[0.0], np.cumsum(order)[:-1]])
    level = (floor - before) / np.arange(len(order), 0, -1)  # with the lowest dimensions at their highest
    return float(level[np.flatnonzero(level <= order)[0]])


def _hits(row: dict, index: Postings, k: int, floors: np.ndarray) -> list[tuple]:
    own, homes, places = (_longs(row[c]) for c in ("q_ids", "q_homes", "q_places"))
    out = []
    for at, query in enumerate(_table({c: row[f"q_{c}"] for c in ("n", "width", "kind", "vectors")})):
        mine = int(places[at]) if homes[at] == row["shard"] else -1
        out += [(at, homes[at], places[at], own[at], *hit) for hit in index.best(query, k, floors[at], mine)]
    return out


def _floors(blocks: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """The blocks with each query's k-th best score in one shard, minus infinity where that holds fewer vectors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            floors, counts = np.full(row["q_n"], -np.inf), np.zeros(row["q_n"], int)
            for at, *_, score in _hits(row, Postings(_table(row), _longs(row["ids"])), k, floors.copy()):
                counts[at] += 1
                if counts[at] == k:
                    floors[at] = np.nextafter(float(score), -np.inf)
            columns = [pa.array([row["block"]]), pa.array([floors.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "floors"])

    first = blocks.withColumn("shard", F.col("home")).join(packed, "shard")
    return cut(first.mapInArrow(search, "block bigint, floors binary"))


def search(df: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row whose id is divisible by ``every``."""
    if k < 1 or every < 1:
        raise ValueError("k and every are at least 1")
    packed = shards(df, vector, key)
    asked = _asked(packed, every)
    named = [F.col(c).alias(f"q_{c}") for c, _ in QUERIES]
    first = F.conv(F.hex(F.reverse(F.substring("homes", 1, 8))), 16, -10).cast("bigint")
    blocks = asked.select("block", first.alias("home"), *named)
    blocks = blocks.join(_floors(blocks, packed, k), "block").drop("home")

    # all blocks meet all shards: a stripe holds some shards, and every block goes to every stripe
    tasks = packed.sparkSession.sparkContext.defaultParallelism
    size = asked.agg(F.sum(F.length("vectors"))).first()[0] or 0
    stripes = 1 if size <= BROADCAST_BYTES else 4 * tasks
    number = F.pmod(F.xxhash64("shard"), F.lit(stripes)).alias("stripe")
    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(stripes - 1).cast("bigint"))).alias("stripe"))
    spread = packed.repartition(4 * tasks, "shard").select("*", number)
    pairs = spread.join(F.broadcast(dealt) if stripes == 1 else dealt, "stripe")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for row in _rows(batches):
            if row["shard"] != last:
                last, index = row["shard"], Postings(_table(row), _longs(row["ids"]))
            found = [hit[1:] for hit in _hits(row, index, k, np.frombuffer(row["floors"], np.float64))]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*found)) or [[]] * 5]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "query_id", "vec_id", "score"])

    order = Window.partitionBy("shard", "place").orderBy(F.col("score").desc(), "vec_id")
    best = pairs.mapInArrow(probe, HIT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """All pairs of a query and a candidate in DuckDB."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q, row_number() OVER () AS id
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id, a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0) DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= {K}
"""
