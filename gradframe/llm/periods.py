"""Periodic runs of words, by longest common extensions from suffix trees.

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(min_length, min_periods * q)`` words that no neighbouring word extends keeping that period.

For a document the suffix trees of its words and of their reversal are built by Ukkonen's
algorithm. An Euler tour, kept at the leaves, turns the lowest common ancestor of two leaves into a
minimum over a range, answered in constant time from a sparse table, so the longest common extension of any
two places, forwards or backwards, costs constant time. By the runs theorem the longest Lyndon
word at each place, for the order of the words and for its reverse, holds a root of every run;
each such candidate is extended in both directions.

Trees are only built where runs can lie. With the default bounds every window of 9 words inside a run
occurs again inside it, a period away (``_window``), so words outside stretches of windows that occur twice within a
third of the stretch belong to no run, and a stretch shorter than ``min_length`` holds none. This is
exact: equal hashes of unlike windows only make a stretch longer.

Defined cases: null and empty texts have no words and no runs; a text without runs collapses to
its words joined by one space; repeated rows each have their result; an empty table gives an empty
result; other columns are not looked at. A document is held whole by one task: memory is linear
in its number of words, and trees take about a kilobyte for each word inside its stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import positions, text_of, words
from gradframe.llm.shingles import mixed
from gradframe.session import ship

MIN_LENGTH = 24
MIN_PERIODS = 3
OUT_BYTES = 8 << 20  # of collapsed texts handed to Spark in one batch, about
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class SuffixTree:
    """Ukkonen's tree of a list of numbers; the end counts as a number less than all others."""

    def __init__(self, symbols: list[int]):
        text = [s + 1 for s in symbols] + [0]
        n = len(text)
        width = max(text) + 1
        start, stop, link, child = [0], [0], [0], {}  # by node; an edge's words are text[start:stop]
        node, edge, length, pending = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = (stop[below] if stop[below] < i + 1 else i + 1) - start[below]
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    if text[start[below] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = child[key] = len(start)
                    start.append(start[below])
                    stop.append(start[below] + length)
                    link.append(0)
                    child[split * width + symbol] = split + 1
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    start[below] += length
                    child[split * width + text[start[below]]] = below
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if not node and length:
                    length -= 1
                    edge = i - pending + 1
                elif node:
                    node = link[node]
        self.size, self.start, self.stop = n, start, stop
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self.first = np.searchsorted(keys[order], np.arange(len(start) + 1, dtype=np.int64) * width).tolist()
        self.leaves, lows = self.tour()
        self.place = np.argsort(self.leaves)
        table = [np.array(lows, np.int32)]
        while 2 << len(table) - 1 <= n:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def tour(self, backwards: bool = False) -> tuple[list[int], list[int]]:
        """Euler tour, kept where it meets a leaf: the suffixes, and the depth in words of the highest node since the last.

        ``backwards`` visits children in the reversed order of their first words, the end still first.
        """
        n, start, stop, below, first = self.size, self.start, self.stop, self.below, self.first
        leaves, lows, todo = [], [], [(0, 0, 0)]
        while todo:
            node, depth, low = todo.pop()
            depth += stop[node] - start[node]
            a, b = first[node], first[node + 1]
            if a == b:
                leaves.append(n - depth)
                lows.append(low)
                continue
            children = below[a:b]
            if backwards:
                ended = start[children[0]] == n - 1
                children = children[:ended] + children[ended:][::-1]
            for k in range(len(children) - 1, 0, -1):
                todo.append((children[k], depth, depth))
            todo.append((children[0], depth, low))
        return leaves, lows

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``one`` and ``two``, pair by pair."""
        x, y = self.place[one], self.place[two]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            pick = level == k
            out[pick] = np.minimum(self.table[k][low[pick]], self.table[k][high[pick] - (1 << int(k))])
        return out

    def ranks(self, backwards: bool = False) -> np.ndarray:
        """Place of every suffix but the empty one in the order of all suffixes, or in the reversed order of words."""
        return np.argsort(self.tour(True)[0])[:-1] if backwards else self.place[:-1]


def _next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For every place the next one of less rank, else the end: where its longest Lyndon word stops."""
    n = len(ranks)
    out, values, open_ = [n] * n, ranks.tolist(), []
    for i, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """``start, length, period`` of every run of an array of numbers, by start, then period."""
    found = []
    for low, high in _stretches(ids, min_length, min_periods):
        part = _runs(np.unique(ids[low:high], return_inverse=True)[1], min_length, min_periods)
        part[:, 0] += low
        found.append(part)
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _runs(ids: np.ndarray, min_length: int, min_periods: int) -> np.ndarray:
    n = len(ids)
    forward, backward = SuffixTree(ids.tolist()), SuffixTree(ids[::-1].tolist())
    place = np.arange(n)
    found = []
    for ranks in (forward.ranks(), forward.ranks(backwards=True)):
        end = _next_smaller(ranks)
        inside = end < n
        one, two = place[inside], end[inside]
        after = forward.common(one, two)
        # what ends before place i begins at n - i in the reversal
        before = backward.common(n - one, n - two)
        period, length = two - one, two + after - one + before
        held = length >= np.maximum(min_length, min_periods * period)
        found.append(np.stack([one - before, length, period], axis=1)[held])
    return np.unique(np.concatenate(found), axis=0)


def _window(min_length: int, min_periods: int) -> int:
    """The longest window of which all inside a run occur again in it, whatever its period is."""
    return max(1, min(max(min_length, min_periods * q) - 2 * q + 1 for q in range(1, min_length + 1)))


def _stretches(ids: np.ndarray, min_length: int, min_periods: int) -> Iterator[tuple[int, int]]:
    """Disjoint parts that no run leaves: windows inside them occur twice in them."""
    width = _window(min_length, min_periods)
    todo = [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if high - low < min_length:
            continue
        repeated = _repeated(ids[low:high], width, (high - low) // min_periods)
        edge = np.flatnonzero(np.diff(repeated, prepend=False, append=False))
        parts = [(low + int(a), low + int(b) + width - 1) for a, b in zip(edge[::2], edge[1::2])]
        if parts == [(low, high)]:
            yield low, high
        else:
            todo += parts


def _repeated(ids: np.ndarray, width: int, most: int) -> np.ndarray:
    """Whether the window that begins at a place occurs (or one of equal hash) at most ``most`` words away too."""
    with np.errstate(over="ignore"):
        h = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        total = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            total *= np.uint64(0xD6E8FEB86659FD93)
            total += h[k : len(h) - width + 1 + k]
    order = np.argsort(total, kind="stable")
    same = (np.diff(total[order]) == 0) & (np.diff(order) <= most)
    out = np.zeros(len(total), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _collapsed(tokens: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(tokens)
    change = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([tokens[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def detect(df: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``doc_id, text``.

    ``runs`` are structs of ``start, length, period`` by start, then period; ``collapsed`` is the
    text's words, joined by one space, without those that a run holds after its first period.
    """
    if min_length < 1 or min_periods < 2:
        raise ValueError("a run has at least two periods")
    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, counts, found, texts = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        at = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
        columns = [
            pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), structs), pa.array(texts, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for given in batches:
            for doc, text in zip(given.column(0).to_pylist(), given.column(1)):
                tokens = text.as_py().encode().split()  # bytes split at just the ASCII white space
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
                found = runs_of(ids, min_length, min_periods)
                rows.append((doc, len(tokens), found, _collapsed(tokens, found)))
                held += len(rows[-1][3]) + 24 * len(found)
                if held > OUT_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        yield batch(rows)

    texts = df.select(df["doc_id"].cast("bigint").alias("doc_id"), text_of(df).alias("text"))
    return texts.mapInArrow(scan, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """``doc_id, text`` with periodic tails planted by a rule on the id in about a tenth of the documents.

    Rows without an id stay as they are.
    """
    h = F.crc32(df["doc_id"].cast("bigint").cast("string"))
    w, g = words(text_of(df)), F.floor(h / 10).cast("bigint")

    def tail(w):
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1).cast("bigint") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(positions(n), lambda i: F.get(w, place(i))), " "))

    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    held = F.when(chosen, F.element_at(F.transform(F.array(w), tail), 1))
    return df.select(df["doc_id"], F.coalesce(held, text_of(df)).alias("text"))


def summarised(found: DataFrame) -> DataFrame:
    """Digest columns of the result of :func:`detect`: the run of greatest exponent, hashes of runs and text."""

    def later(x, y):
        more = x["length"] * y["period"] - y["length"] * x["period"]
        order = F.when(more > 0, -1).when(more < 0, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
        return order.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    best = F.get(F.array_sort("runs", later), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    some = F.size("runs") > 0
    return found.withColumn("best", F.when(some, best)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
