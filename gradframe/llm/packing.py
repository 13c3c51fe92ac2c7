"""Best-fit packing of tokenized documents into sequences.

Documents are cut into pieces of at most ``capacity`` tokens and range-sorted by length,
which gives every piece its rank among the pieces of equal length. Packing then goes in
supersteps, one per length, longest first: all pieces of a length are matched at once
with their successors among the gaps, that is with the smallest gaps that hold them; ranks
decide which piece gets which place of which sequence; gaps are updated and the
next length follows. The sorted gaps are kept as runs (equal gap, consecutive sequence numbers), of
which there are no more than a small multiple of the capacity, whatever the number of documents is.
The result is what best-fit decreasing gives.

Defined cases: a null or empty text is one piece with the end id only; repeated rows
are packed once each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import text_of
from gradframe.plans import ordered
from gradframe.plans.lineage import cut
from gradframe.session import ship

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"  # a file of the tokenizers library
_DOUBLE_SPACE = re.compile(r"\s\s")
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


@lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    """The tokenizer; two faster ones of the same ranks for texts without its added tokens; and a test for those tokens.

    The second is for texts without two white space signs in a row, since only such runs need the
    look-ahead of the splitting pattern.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    whole = tokenizers.Tokenizer.from_file(path)
    added = {token.content for token in whole.get_added_tokens_decoder().values()}
    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in whole.get_vocab(with_added_tokens=False).items() if token not in added}
    make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    full = public_tokenizers.PATTERN
    found = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
    return whole, make("full", full), make("plain", full.replace(r"\s+(?!\S)|", "")), found


def token_ids(text: str, vocabulary: str = VOCABULARY, end: int = END_ID) -> np.ndarray:
    """Ids of a text as ``tokenizers`` gives them, and the end id, as unsigned 32-bit numbers."""
    whole, full, plain, added = _encoders(vocabulary)
    if added is not None and added.search(text):
        ids = whole.encode(text, add_special_tokens=False).ids
    else:
        ids = (full if _DOUBLE_SPACE.search(text) else plain).encode_ordinary(text)
    ids.append(end)
    return np.array(ids, "<u4")


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces: whole ones at the end, a shorter one first."""
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(a, (b - a)) for a, b in zip(starts, [*starts[1:], length])]


def pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for the pieces of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = token_ids(text.as_py(), vocabulary, end)
                key = key.as_py()
                for number, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    rows.append((key, number, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = df.select(df["doc_id"].cast("bigint"), text_of(df).alias("text"))
    return texts.mapInArrow(encode, PIECES)


def successor_steps(lengths: dict[int, int], capacity: int) -> Iterator[tuple]:
    """The supersteps: ``(length, from_rank, to_rank, each, sequence, offset)``.

    Pieces of the length with ranks from ``from_rank`` to ``to_rank`` go to
    consecutive sequences from ``sequence`` on, ``each`` to a sequence, side by side from ``offset``.
    """
    runs: dict[int, deque] = {}
    gaps: list[int] = []  # those with a run, ascending
    free = 0

    def add(gap: int, first: int, count: int) -> None:
        if gap == 0 or count == 0:
            return
        if not runs.get(gap):
            insort(gaps, gap)
            runs[gap] = deque()
        runs[gap].append((first, count))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 1
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                opened = -(-left // (capacity // length))
                add(capacity, free, opened)
                free += opened
                at = bisect_left(gaps, length)
            gap = gaps[at]
            first, count = runs[gap].popleft()
            if not runs[gap]:
                gaps.pop(at)
            each = min(gap // length, left)
            used = min(count, left // each)
            placed = each * used
            yield length, rank, rank + placed - 1, each, first, capacity - gap
            if count > used:  # what is left of the run stays first in line
                if not runs.get(gap):
                    insort(gaps, gap)
                    runs[gap] = deque()
                runs[gap].appendleft((first + used, count - used))
            add(gap - each * length, first, used)
            left, rank = left - placed, rank + placed


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``."""
    ranked = ordered.ranked(df, ["length"], ["doc_id", "piece"], "_rank")
    counts = df.groupBy("length").count().collect()  # at most ``capacity`` rows
    steps = list(successor_steps({r["length"]: r["count"] for r in counts}, capacity))
    table = df.sparkSession.createDataFrame(
        steps, "_l bigint, _from bigint, _to bigint, _each bigint, _first bigint, _base bigint"
    )
    # bounded by the capacity, not by the data
    near = ranked.join(
        F.broadcast(table), (F.col("length") == F.col("_l")) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    )
    place = F.col("_rank") - F.col("_from")
    return near.select(
        *df.columns,
        (F.col("_first") + F.floor(place / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_base") + (place % F.col("_each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def packed(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    ship(df.sparkSession)
    return pack(cut(pieces(df, capacity, vocabulary)), capacity)
