"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

A document is a sparse vector: the damped counts of its words, hashed into a fixed number of
slots and scaled to length one, and its structure statistics and metadata in steps,
one slot for each step. The model gives each slot a weight and a short factor vector; the
interactions of all pairs of slots come from the sum-of-squares identity

    sum over i < j of <v_i, v_j> x_i x_j = (|sum of v_i x_i|^2 - sum of |v_i x_i|^2) / 2,

so a score is linear in the number of words. Training takes full-batch steps: tasks sum gradients over
their rows, the driver adds the sums (of fixed size) and moves the parameters.

Defined cases: a null text counts as empty and is scored by its statistics; rows without a label
are only scored; a document labelled twice counts twice; an empty or unlabelled table gives
the score of the untrained model; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import text_of
from gradframe.llm.shingles import word_hashes
from gradframe.plans.lineage import cut
from gradframe.session import ship

FOLDS = 5  # documents whose id's checksum leaves 0 are held out
SAMPLE = 6_000  # labelled rows at most to learn from, those with the least hashes of their ids
SLOTS = 1 << 14
STEPS = 16  # of every statistic
FACTORS = 4
ROUNDS = 30
RATE = 0.15
DECAY = 1e-4
THRESHOLD = 0.3
#: Statistics of a text and the values their steps lie between; ``n_chars`` is the table's column.
STATISTICS = (
    ("log length", 0, 13), ("log words", 0, 11), ("mean word", 0, 16), ("capitals", 0, 1), ("digits", 0, 0.3),
    ("symbols", 0, 0.5), ("marks", 0, 0.3), ("words a line", 0, 60), ("repeated words", 0, 1), ("log n_chars", 0, 13),
)
WIDTH = SLOTS + STEPS * len(STATISTICS) + 1
_LETTERS = np.zeros((5, 256), bool)
_LETTERS[0, 65:91] = True
_LETTERS[1, 48:58] = True
_LETTERS[2, list(b"#*$%&|<>{}[]=~^_\\\\")] = True
_LETTERS[3, list(b"!?.,;:")] = True
_LETTERS[4, [10]] = True


@dataclass
class Model:
    weights: np.ndarray  # WIDTH
    factors: np.ndarray  # WIDTH x FACTORS


def untrained(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    return Model(np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, FACTORS)))


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one document."""
    data = np.frombuffer(text, np.uint8)
    words = word_hashes(text)
    counts = np.bincount(data, minlength=256)
    upper, digits, symbols, marks, lines = (int(counts[x].sum()) for x in _LETTERS)
    size, n = max(len(data), 1), max(len(words), 1)
    slots, often = np.unique((words >> np.uint64(50)).astype(np.int64), return_counts=True)
    values = np.log1p(often)
    values /= max(np.sqrt((values**2).sum()), 1e-9)
    stats = (
        np.log1p(len(data)), np.log1p(len(words)), len(data) / n, upper / size, digits / size, symbols / size,
        marks / size, n / (lines + 1), 1 - len(np.unique(words)) / n, np.log1p(max(n_chars or 0, 0)),
    )
    steps = [
        SLOTS + STEPS * k + min(STEPS - 1, int(STEPS * max(0.0, s - low) / (high - low)))
        for k, (s, (_, low, high)) in enumerate(zip(stats, STATISTICS))
    ]
    share = 1 / np.sqrt(len(STATISTICS))
    return (
        np.concatenate([slots, steps, [WIDTH - 1]]),
        np.concatenate([values, np.full(len(steps), share), [1.0]]),
    )


def margins(model: Model, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray):
    """Log-odds of rows that lie one after another, and the factor sums the gradient needs."""
    scaled = model.factors[slots] * values[:, None]
    sums = np.add.reduceat(scaled, bounds[:-1], axis=0)
    squares = np.add.reduceat((scaled**2).sum(1), bounds[:-1])
    linear = np.add.reduceat(model.weights[slots] * values, bounds[:-1])
    return linear + 0.5 * ((sums**2).sum(1) - squares), sums, scaled


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(model: Model, slots, values, bounds, labels) -> np.ndarray:
    """Sum over the rows of the log loss' gradient, as ``WIDTH x (1 + FACTORS)``."""
    z, sums, scaled = margins(model, slots, values, bounds)
    error = np.repeat(_chance(z) - labels, np.diff(bounds)) * values
    out = np.empty((WIDTH, 1 + FACTORS))
    out[:, 0] = np.bincount(slots, error, WIDTH)
    apart = np.repeat(sums, np.diff(bounds), axis=0) - scaled
    for k in range(FACTORS):
        out[:, 1 + k] = np.bincount(slots, error * apart[:, k], WIDTH)
    return out


def _fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _rows(df: DataFrame, labelled: bool) -> DataFrame:
    """Features of documents as arrays, with the label."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py().encode(), n.as_py()) for t, n in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64())), batch.column(2)],
                names=["slots", "vals", "label"],
            )

    return df.mapInArrow(make, "slots array<bigint>, vals array<double>, label double")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out."""
    spark = documents.sparkSession
    known = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull()).select("doc_id", labels["quality"].cast("double").alias("label"))
    chosen = known.where(_fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # the sample's size bounds what is broadcast
    rows = documents.join(F.broadcast(cut(chosen)), "doc_id").select("text", "n_chars", "label")
    parts = spark.sparkContext.defaultParallelism
    data = cut(_rows(rows, True).repartition(parts))
    model = untrained()
    total = data.count()
    if not total:
        return model
    moment, scale = np.zeros((WIDTH, 1 + FACTORS)), np.zeros((WIDTH, 1 + FACTORS))
    for step in range(1, rounds + 1):
        held = spark.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            out = np.zeros((WIDTH, 1 + FACTORS))
            for batch in batches:
                if batch.num_rows:
                    slots, vals = batch.column(0), batch.column(1)
                    bounds = slots.offsets.to_numpy() - slots.offsets[0].as_py()
                    out += gradient(held.value, slots.flatten().to_numpy(), vals.flatten().to_numpy(), bounds, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()])], names=["g"])

        sums = data.mapInArrow(add, "g binary").collect()  # one of fixed size for each task
        slope = sum(np.frombuffer(r["g"], np.float32).astype(float) for r in sums).reshape(WIDTH, -1) / total
        held.destroy()
        slope[:, 1:] += DECAY * model.factors
        moment = 0.9 * moment + 0.1 * slope
        scale = 0.99 * scale + 0.01 * slope**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-6)
        model = Model(model.weights - move[:, 0], model.factors - move[:, 1:])
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n_chars in zip(batch.column(1), batch.column(2)):
                slots, values = features(text.as_py().encode(), n_chars.as_py())
                z, _, _ = margins(held.value, slots, values, np.array([0, len(slots)]))
                out.append(float(_chance(z)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rated = documents.select("doc_id", "text", "n_chars").mapInArrow(rate, "doc_id bigint, score double")
    return rated.select(
        "doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score every document."""
    ship(documents.sparkSession)
    own = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"), text_of(documents).alias("text"),
        documents["n_chars"].cast("bigint").alias("n_chars"),
    )
    return score(own, fit(own, labels))
