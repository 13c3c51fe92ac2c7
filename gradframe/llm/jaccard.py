"""Near-duplicate join by Jaccard similarity of word shingles, with token-combination prefixes.

Tokens (shingle hashes) have one order for all documents: by a frequency level from
hashed counts over all documents, then by value. Two sets that are similar enough share
at least ``c + 1`` tokens in prefixes that are ``c`` tokens longer than the plain prefix
filter's. Rare tokens are indexed on their own. Frequent ones, split into ``c`` subclasses
by value, are indexed as pairs: if all shared prefix tokens are frequent, some subclass holds two of
them. ``c`` follows a set's size band, so the number of pairs stays linear in the prefix.
Pairs of sets under one signature are then sifted by bitmaps, which the first pass over the texts makes of
all sets, and what these leave is verified on the whole sets, made for the nodes of such pairs only.

Equal sets are one node from the start. Each node is first compared with the least node of
that signature which it shares most, among those that its bitmap leaves; once the links found are joined to components, nodes are compared with
the least nodes of their other signatures. What then still lies in different components is compared under
every signature: pairs under short lists, but those with the least node, by a join with a bitmap filter; the nodes of long lists, which are
mostly large groups of near copies, as a whole, block by block, bitmaps before sets, leaving out pairs of blocks that lie in one component. Signatures
of tokens so frequent that their lists may be very long are dealt to salts by node, and the least nodes of
the salts are compared with each other.
No link between components can be lost, and groups of copies are not multiplied out. Links are
counted afterwards, over all pairs of sets of a component, in the same blocks.

Defined cases: a document without words or text has the empty set and is linked with nothing;
rows without an id get no component and link nothing; repeated ids are rows of
one document; texts of any length are read whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradframe.llm.columns import private, quoted, text_of
from gradframe.llm.graph import components
from gradframe.llm.shingles import mixed, set_key, shingle_set
from gradframe.plans import ordered
from gradframe.plans.lineage import cut, release
from gradframe.session import ship

PERCENT = 80
BUCKET_BITS = 20  # of the hashed counts: their number is fixed, whatever the table's size is
COUNTERS = 1 << 14  # that travel together
BAND = 1.25
JOIN_WORDS = 16  # 64-bit numbers of the bitmap that a join looks at
HELD_SETS = 500
HELD_ROWS = 10_000  # of results handed to Spark in one batch, about
LEAST_BITS, SKETCH_BITS = 10, 14  # of the smallest and the largest sketch, as powers of two
SET_BYTES = 8 << 20  # of sets handed to Spark in one batch, about
LONG_LIST = 64  # nodes under a signature, beyond which they are compared in blocks
HOT_LIST = 1 << 12  # possible nodes under a signature, beyond which it is dealt to salts
SALTS = 64
BLOCK_TOKENS = 1 << 17  # of the sets of a block
LEAST_TOKENS = 1 << 9  # that a set counts as in a block, so that a block holds at most 256 sets
TOKENS_AT_ONCE = 1 << 14
FEW_ROWS = 1 << 16  # of a written table that goes on as one partition
SOUGHT_NODES = 1 << 20  # whose texts are found by a broadcast of their ids, so that texts stay where they are
SUBCLASS_TOKENS = 16  # aimed-at frequent tokens of one subclass in a prefix


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for row, text in enumerate(batch.column(column)):
            yield batch, row, shingle_set(text.as_py().encode())


def _measured(df: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n_shingles, node, sketch`` of every row, and the number of (row, token) pairs by the upper bits of the token.

    Both come from one pass. The empty set has no node and no sketch. A task counts into an array of fixed size, up to 65,535 in a
    counter, and hands it on in blocks, those that are mostly empty as places and counts; they are added up block by block, and the
    driver receives the sums.
    """
    blocks = (1 << BUCKET_BITS) // COUNTERS
    names = ["doc_id", "n_shingles", "node", "sketch", "block", "places", "counts"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for _, _, tokens in _sets([batch], 1):
                sizes.append(len(tokens))
                nodes.append(set_key(tokens) if len(tokens) else None)
                sketches.append(sketch(tokens).tobytes() if len(tokens) else None)
                held.append((tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                if len(held) == HELD_SETS:
                    _add(total, np.concatenate(held))
                    held = []
            n = batch.num_rows
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 2], names=names)
        if held:
            _add(total, np.concatenate(held))
        for k, part in enumerate(np.minimum(total, 65_535).astype(np.uint16).reshape(blocks, COUNTERS)):
            places = np.flatnonzero(part).astype(np.uint16)
            if not len(places):
                continue
            sparse = 2 * len(places) < COUNTERS
            data = [[places.tobytes() if sparse else None], [(part[places] if sparse else part).tobytes()]]
            columns = [*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), *[pa.array(d, pa.binary()) for d in data]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                total = sums.setdefault(k, np.zeros(COUNTERS, np.int64))
                at = slice(None) if places.as_py() is None else np.frombuffer(places.as_py(), np.uint16)
                total[at] += np.frombuffer(data.as_py(), np.uint16)
        for k, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()])], names=["block", "counts"])

    kinds = "doc_id bigint, n_shingles bigint, node bigint, sketch binary, block int, places binary, counts binary"
    both = cut(df.select("doc_id", "text").mapInArrow(measure, kinds))
    parts = both.where("block is not null").select("block", "places", "counts").repartition("block").mapInArrow(add, "block int, counts binary")
    total = np.zeros((blocks, COUNTERS), np.int64)
    for row in parts.collect():  # one row per block
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return both.where("block is null").select("doc_id", "n_shingles", "node", "sketch"), total.reshape(-1)


def _add(total: np.ndarray, buckets: np.ndarray) -> None:
    found, often = np.unique(buckets, return_counts=True)
    total[found] += often


def _levels(counts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Frequency level of every bucket, the first that counts as frequent, and the first of possibly very long lists.

    A bucket well above what chance gives the buckets holds a frequent token.
    """
    mean = counts.mean()
    levels = np.minimum(np.unique(counts, return_inverse=True)[1], 65535) if counts.any() else counts
    bound = mean + 8 * np.sqrt(mean) + 16
    first = lambda least: int(levels[counts > least].min()) if (counts > least).any() else int(levels.max()) + 1
    return levels.astype(np.uint16), first(bound), first(max(bound, HOT_LIST))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of the set, of at least two bits a token up to ``SKETCH_BITS``."""
    bits = 1 << min(SKETCH_BITS, max(LEAST_BITS, int(2 * len(tokens) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out)


def difference(one: bytes, two: bytes) -> int:
    """No more than the number of tokens that are in one of two sets only.

    The larger bitmap is folded to the size of the smaller. Each bit that differs comes from a token
    of its own that the other set does not have.
    """
    x, y = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ folded(y, len(x))).sum())


def folded(drawn: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the set has with so many 64-bit numbers, made of one with as many or more."""
    return np.bitwise_or.reduce(drawn.reshape(-1, words))


def _band(size: int) -> int:
    return int(log(size) / log(BAND) + 1e-9)


def _subclasses(band: int) -> int:
    return max(1, round((100 - PERCENT) / 100 * BAND ** (band + 1) / SUBCLASS_TOKENS))


def signatures(tokens: np.ndarray, levels: np.ndarray, frequent: int, hot: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit signatures of a sorted set, and which of them may have very long lists."""
    n = len(tokens)
    level = levels[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    plain = n - ceil(PERCENT * n / 100)
    band = _band(n)
    longest = order[: plain + _subclasses(band + 1) + 1]
    common = level[longest] >= frequent
    out = [tokens[longest[~common]]]
    long = [np.zeros(len(out[0]), bool)]
    if common.sum() > 1:
        for b in (band, band + 1):
            c = _subclasses(b)
            prefix = order[: plain + c + 1]
            prefix = prefix[level[prefix] >= frequent]
            for k in range(c):
                own = prefix[tokens[prefix] % np.uint64(c) == k]
                found, both = _pairs(tokens[own], level[own] >= hot, b)
                out.append(found)
                long.append(both)
    sigs, first = np.unique(np.concatenate(out), return_index=True)
    return sigs.view(np.int64), np.concatenate(long)[first]


def _pairs(tokens: np.ndarray, long: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.triu_indices(len(tokens), 1)
    order = np.argsort(tokens)
    tokens, long = tokens[order], long[order]
    with np.errstate(over="ignore"):
        found = mixed(tokens[one] * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens[two] + np.uint64(band)))
    return found, long[one] & long[two]


def _postings(df: DataFrame, levels: np.ndarray, frequent: int, hot: int) -> DataFrame:
    """``sig, salt, node`` of every distinct set; copies inside one task give theirs once."""
    known = df.sparkSession.sparkContext.broadcast(levels)
    names = ["sig", "salt", "node"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, salts, nodes, held = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            lengths = [len(s) for s in sigs]
            whole = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
            columns = [whole(sigs, np.int64), whole(salts, np.int32), np.repeat(np.array(nodes, np.int64), lengths)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for _, _, tokens in _sets(batches, 0):
            if not len(tokens):
                continue
            node = set_key(tokens)
            if node in seen:
                continue
            seen.add(node)
            found, long = signatures(tokens, known.value, frequent, hot)
            sigs.append(found)
            salts.append(np.where(long, 1 + node % SALTS, 0).astype(np.int32))
            nodes.append(node)
            held += len(found)
            if held > 100_000:
                yield flushed()
                sigs, salts, nodes, held = [], [], [], 0
        yield flushed()

    return df.select("text").mapInArrow(index, "sig bigint, salt int, node bigint")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, tokens`` of texts."""
    nodes, sets, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    for _, _, tokens in _sets(batches, 0):
        nodes.append(set_key(tokens))
        sets.append(tokens.tobytes())
        held += len(sets[-1])
        if held > SET_BYTES:
            yield batch()
            nodes, sets, held = [], [], 0
    yield batch()


def _few(df: DataFrame) -> tuple[DataFrame, int]:
    """Written rows of plain numbers, and how many there are.

    Up to ``FEW_ROWS`` go on as a single partition that joins by broadcast, so that their joins and groups take a
    task in place of several for each shuffle partition; more stay as they are.
    """
    n = df.count()
    return (F.broadcast(df.coalesce(1)), n) if n <= FEW_ROWS else (df, n)


class Sets:
    """Sketches of all nodes, and whole sets of nodes, made from one document's text for each node when they are first asked for."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, sketches: DataFrame, repeated: bool):
        self.docs, self.nodes, self.sketches, self.repeated = docs, nodes, sketches, repeated
        self.made: DataFrame | None = None
        self.asked: DataFrame | None = None

    def of(self, named: DataFrame) -> DataFrame:
        """``node, tokens`` of the nodes in ``named`` and of all asked for before."""
        new = self.nodes.join(named.select("node").distinct(), "node", "left_semi")
        if self.asked is not None:
            new = new.join(self.asked, "node", "left_anti")
        wanted, n = _few(cut(new.select("node", F.col("first").alias("doc_id"))))
        if self.made is None or n:
            sought = F.broadcast(wanted) if n <= SOUGHT_NODES else wanted
            texts = self.docs.join(sought.select("doc_id"), "doc_id", "left_semi").select("text")
            built = texts.mapInArrow(_build, "node bigint, tokens binary")
            # an id with several texts brings other sets too
            own = built.join(sought.select("node"), "node", "left_semi")
            own = cut(own.dropDuplicates(["node"]) if self.repeated else own)
            self.made = own if self.made is None else self.made.unionByName(own)
            asked = wanted.select("node")
            self.asked = asked if self.asked is None else _few(cut(self.asked.union(asked)))[0]
        return self.made


def _near_sizes(x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"


def _sifted(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs ``a, b`` but those whose sketches already differ in more bits than similar sets can, written.

    100 * shared >= 80 * union means that at most a ninth of both sizes together differs. All columns are numbers.
    """
    pairs, _ = _few(pairs)
    names = pairs.columns

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                (100 + PERCENT) * difference(x.as_py(), y.as_py()) <= (100 - PERCENT) * (m.as_py() + n.as_py())
                for x, m, y, n in zip(*batch.columns[len(names) :])
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(near, pa.bool_()))

    drawn = lambda side: sets.sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"s_{side}"), F.col("n").alias(f"n_{side}"))
    sketched = pairs.join(drawn("a"), "a").join(drawn("b"), "b").select(*names, "s_a", "n_a", "s_b", "n_b")
    return cut(sketched.mapInArrow(narrow, ", ".join(f"{c} bigint" for c in names)))


def _verified(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs ``a, b``, written and each there once, whose whole sets are similar enough."""
    pairs, _ = _few(pairs)
    made = sets.of(pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                same.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    # the sets of one side go to those of the other, which are moved once for each node
    of = lambda side: made.select(F.col("node").alias(side), F.col("tokens").alias(f"set_{side}"))
    hubs = of("a").join(pairs.select("a").distinct(), "a", "left_semi")
    both = of("b").join(pairs, "b").join(hubs, "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(compare, "a bigint, b bigint")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes lie in different components."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    placed = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return placed.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n, words`` of ``node, n, sketch``; the words are a bitmap of fixed size for use in a join's condition."""
    for batch in batches:
        drawn = [folded(np.frombuffer(s.as_py(), np.int64), JOIN_WORDS) for s in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(drawn, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "words"])


def _short_lists(placed: DataFrame, lists: DataFrame, sets: Sets) -> DataFrame:
    """All pairs of different components under signatures of at most ``LONG_LIST`` nodes, but those that ``_roots`` has tried.

    Those are the pairs with the least node of a salt. The join itself leaves out pairs whose bitmaps differ in more
    bits than similar sets can.
    """
    apart = cut(placed.join(lists.select("sig"), "sig", "left_semi"))
    release(apart.sparkSession)
    words = sets.sketches.join(apart.select("node").distinct(), "node", "left_semi").select("node", "n", "sketch")
    drawn = apart.join(words.mapInArrow(_words, "node bigint, n bigint, words array<bigint>"), "node")
    differing = " + ".join(f"bit_count(l.words[{i}] ^ r.words[{i}])" for i in range(JOIN_WORDS))
    near = f"{100 + PERCENT} * ({differing}) <= {100 - PERCENT} * (l.n + r.n)"
    return (
        drawn.alias("l").join(drawn.alias("r"), "sig")
        .where(f"l.node < r.node and l.node <> r.lo and l.root <> r.root and {_near_sizes('l.n', 'r.n')} and {near}")
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )


def _long_lists(placed: DataFrame, lists: DataFrame, sets: Sets) -> DataFrame:
    """Links between different components under longer lists: nodes joined by such lists are compared in blocks.

    A pair of blocks gives no more links than are needed to join its components.
    """
    rows = cut(placed.join(lists, "sig"))
    stars, _ = _few(cut(rows.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()))
    groups, _ = _few(cut(components(stars).withColumnRenamed("root", "grp")))
    nodes = rows.select("node", "root").distinct().join(groups, "node").join(sets.nodes.select("node", "n"), "node")
    nodes = cut(nodes.withColumn("copies", F.lit(0).cast("bigint")))
    return _in_blocks(nodes, sets, _joining, "a bigint, b bigint", apart=True).distinct()


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Number of common tokens of every set of ``one`` with every set of ``two``."""
    out = np.zeros((len(one), len(two)), np.int64)
    x, y = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(x, y)

    def cells(tokens: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
        held = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    (at_x, row), (at_y, col) = cells(x, one), cells(y, two)
    for low in range(0, len(common), TOKENS_AT_ONCE):
        high = min(low + TOKENS_AT_ONCE, len(common))
        tables = []
        for at, owner, sets in ((at_x, row, one), (at_y, col, two)):
            part = slice(*np.searchsorted(at, (low, high)))
            table = np.zeros((len(sets), high - low), np.float32)
            table[owner[part], at[part] - low] = 1
            tables.append(table)
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64)  # sums below 2^24 are exact
    return out


def _in_blocks(nodes: DataFrame, sets: Sets, compare: Callable, schema: str, apart: bool) -> DataFrame:
    """Compare all nodes ``node, n, root, grp, copies`` of a group with each other, block by block.

    A group's nodes are ordered by component and dealt to blocks of bounded size. Every pair of blocks meets in
    a task, which holds one such pair at a time; with ``apart`` pairs of blocks of a single component are left out,
    and of the others the sketches meet first, so that only sets are moved that may be similar to one of another component.
    A set is moved once for each block of its group at most.
    """
    weight = F.greatest("n", F.lit(LEAST_TOKENS)).cast("bigint")
    nodes, n = _few(nodes)
    if n <= FEW_ROWS:
        upto = F.sum(weight).over(Window.partitionBy("grp").orderBy("root", "node"))
        run = nodes.withColumn("upto", upto)
    else:
        run = ordered.running(nodes, ["grp"], ["root", "node"], {"upto": weight})
    dealt, _ = _few(cut(run.withColumn("own", F.floor((F.col("upto") - weight) / BLOCK_TOKENS).cast("int"))))
    blocks, _ = _few(cut(dealt.groupBy("grp", "own").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))))
    met = blocks.alias("l").join(blocks.alias("r"), "grp").where("l.own <= r.own")
    if apart:
        met = met.where("l.lo <> l.hi or r.lo <> r.hi or l.lo <> r.lo")
    met, _ = _few(cut(met.select("grp", F.col("l.own").alias("x"), F.col("r.own").alias("y"))))
    side = lambda c: dealt.join(met.withColumn("own", F.col(c)), ["grp", "own"]).select(
        "grp", "x", "y", "own", "node", "root", "copies"
    )
    visits, n = _few(cut(side("x").unionByName(side("y").where("x <> y"))))
    names = ["grp", "x", "y", "own", "node", "root", "copies"]
    together = lambda rows: rows.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    if apart and n:
        drawn = together(visits.join(sets.sketches, "node").select(*names, "n", "sketch"))
        visits, _ = _few(cut(drawn.mapInArrow(_possible, ", ".join(f"{c} bigint" for c in names))))
    moved = visits.select("node").distinct()
    rows = together(visits.join(sets.of(moved).join(moved, "node", "left_semi"), "node").select(*names, "tokens"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, x, y), held in _met(batches, np.uint64):
            out += compare(x, y, held)
            if len(out) > HELD_ROWS:
                yield _numbers(out, schema)
                out = []
        yield _numbers(out, schema)

    return rows.mapInArrow(visit, schema)


def _met(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[tuple, list[tuple]]]:
    """``grp, x, y`` and what else the rows hold that meet there, of rows in their order; the last column is an array."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns[:-1]], batch.columns[-1]):
            if row[:3] != now:
                if held:
                    yield now, held
                now, held = row[:3], []
            held.append((*row[3:-1], np.frombuffer(row[-1].as_py(), kind)))
    if held:
        yield now, held


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks without nodes that, by all sketches of the other one, are similar to none of another component."""
    out = []
    schema = "grp, x, y, own, node, root, copies"
    for now, held in _met(batches, np.uint64):
        by_size: dict[int, list[int]] = {}
        for k, h in enumerate(held):
            if h[0] == now[2]:
                by_size.setdefault(len(h[5]), []).append(k)
        n, root = np.array([h[4] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
        tables = {size: np.stack([held[k][5] for k in own]) for size, own in by_size.items()}
        found: set[int] = set()
        for i, h in enumerate(held):
            if h[0] != now[1]:
                continue
            for size, own in by_size.items():
                least = min(size, len(h[5]))
                other = np.bitwise_or.reduce(tables[size].reshape(len(own), -1, least), axis=1)
                differing = np.bitwise_count(folded(h[5], least) ^ other).sum(axis=1, dtype=np.int64)
                m = n[own]
                near = (100 + PERCENT) * differing <= (100 - PERCENT) * (m + n[i])
                near &= (100 * np.minimum(m, n[i]) >= PERCENT * np.maximum(m, n[i])) & (root[own] != root[i])
                if near.any():
                    found.add(i)
                    found.update(np.array(own)[near].tolist())
        out += [(*now, *held[k][:4]) for k in sorted(found)]
        if len(out) > HELD_ROWS:
            yield _numbers(out, schema)
            out = []
    yield _numbers(out, schema)


def _numbers(rows: list[tuple[int, ...]], schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(",")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _similar(x: int, y: int, held: list[tuple]) -> tuple[list[tuple], list[tuple], np.ndarray]:
    """Both blocks' nodes, and which pairs of them are similar enough; a node is not so to itself."""
    one, two = [h for h in held if h[0] == x], [h for h in held if h[0] == y]
    if not one or not two:
        return one, two, np.zeros((len(one), len(two)), bool)
    sizes = lambda block: np.array([len(h[4]) for h in block], np.int64)
    shared = shared_counts([h[4] for h in one], [h[4] for h in two])
    found = 100 * shared >= PERCENT * (sizes(one)[:, None] + sizes(two)[None, :] - shared)
    if x == y:
        np.fill_diagonal(found, False)
    return one, two, found


def _joining(x: int, y: int, held: list[tuple]) -> list[tuple[int, int]]:
    """Links that join the components of two blocks, no more than needed."""
    one, two, found = _similar(x, y, held)
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while above.get(r, r) != r:
            r = above[r]
        return r

    out = []
    for i, j in zip(*(c.tolist() for c in np.nonzero(found))):
        a, b = top(one[i][2]), top(two[j][2])
        if a != b:
            above[a] = b
            out.append((one[i][1], two[j][1]))
    return out


def _counting(x: int, y: int, held: list[tuple]) -> list[tuple[int, int]]:
    """For the nodes of two blocks the number of documents in similar sets of the other one."""
    one, two, found = _similar(x, y, held)
    copies = lambda block: np.array([h[3] for h in block], np.int64)
    out = [(h[1], int(n)) for h, n in zip(one, found @ copies(two))] if two else []
    if x != y and one:
        out += [(h[1], int(n)) for h, n in zip(two, found.T @ copies(one))]
    return out


def _linked_copies(labelled: DataFrame, sets: Sets) -> DataFrame:
    """``node, linked``: the number of documents in all sets that are similar to the node's.

    Similar sets lie in one component, so each component is a group.
    """
    inside = cut(labelled.where("root is not null").select("node", "n", "root", F.col("root").alias("grp"), "copies"))
    found = _in_blocks(inside, sets, _counting, "node bigint, linked bigint", apart=False)
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def _shared(docs: DataFrame, levels: np.ndarray, frequent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """``sig, salt, node, lo`` of signatures that more than one set may have, and links ``a, b`` of the salts' least nodes."""
    group = Window.partitionBy("sig", "salt")
    postings = _postings(docs, levels, frequent, hot)
    marked = postings.withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)})
    shared = cut(marked.where("lo < hi or salt > 0").drop("hi"))
    # at most SALTS rows of a signature meet here
    hubs = shared.where("salt > 0").select("sig", "lo").distinct()
    least = hubs.withColumn("least", F.min("lo").over(Window.partitionBy("sig"))).where("least <> lo")
    return shared, least.select(F.col("least").alias("a"), F.col("lo").alias("b"))


def _roots(named: DataFrame, sets: Sets, counts: np.ndarray) -> DataFrame:
    """``node, root`` of the nodes that are linked with others."""
    spark = named.sparkSession
    shared, hubs = _shared(named, *_levels(counts))
    release(spark)
    sizes = sets.nodes.select("node", "n")
    edges = shared.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).unionByName(hubs)
    stars, _ = _few(cut(
        edges.groupBy("a", "b").agg(F.count("*").alias("often"))
        .join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        .where(_near_sizes("na", "nb")).select("a", "b", "often")
    ))
    stars, _ = _few(_sifted(stars, sets))
    # first each node with the one it shares most signatures with, then what this leaves apart
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("often", "a")).alias("a")).select("a", "b")
    tried = cut(best)
    links, _ = _few(cut(_verified(tried, sets)))
    roots, _ = _few(cut(components(links)))

    def joined(more: DataFrame) -> None:
        nonlocal links, roots
        more, n = _few(cut(more))
        release(spark)
        if n:
            links, _ = _few(cut(links.union(more)))
            roots, _ = _few(cut(components(links)))

    rest = cut(_apart(stars.select("a", "b"), roots).join(tried, ["a", "b"], "left_anti"))
    if rest.take(1):
        joined(_verified(rest, sets))
        tried = cut(tried.union(rest))
    for lists in (_long_lists, _short_lists):
        release(spark)
        placed = shared.join(roots, "node", "left").select("sig", "node", "lo", F.coalesce("root", "node").alias("root"))
        counted = placed.groupBy("sig").agg(
            F.min("node").alias("hub"), F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")
        )
        long = F.col("m") > LONG_LIST  # two nodes alone have been tried as a node and the least one
        split, n = _few(cut(counted.where("x < y and m > 2").where(long if lists is _long_lists else ~long).select("sig", "hub")))
        if not n:
            continue
        found = lists(placed, split, sets)
        if lists is _short_lists:
            rest = _sifted(cut(found.join(_few(tried)[0], ["a", "b"], "left_anti")), sets)
            found = _verified(rest, sets) if rest.take(1) else rest
        joined(found)
    return roots


def _components(df: DataFrame) -> tuple[DataFrame, Sets, DataFrame]:
    """Every row's set, the sets, and the nodes with ``root, component_id``, the first null where alone."""
    ship(df.sparkSession)
    texts = df.select(df["doc_id"].cast("bigint").alias("doc_id"), text_of(df).alias("text"))
    members, counts = _measured(texts)
    own = members.where("doc_id is not null and node is not null")
    nodes, _ = _few(cut(own.groupBy("node").agg(
        F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("copies"), F.max("n_shingles").alias("n")
    )))
    repeated = bool(own.groupBy("doc_id").count().where("count > 1").take(1))
    named = texts.where("doc_id is not null")
    sketches = cut(own.groupBy("node").agg(F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    sets = Sets(named, nodes, sketches, repeated)
    roots = _roots(named, sets, counts)
    release(df.sparkSession)
    # a node alone has a group of its own: nulls would meet in one task
    labelled = nodes.join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node"))
    smallest = labelled.groupBy("grp").agg(F.min("first").alias("component_id"))
    labelled = cut(labelled.join(smallest, "grp").select("node", "n", "root", "copies", "component_id"))
    return members, sets, labelled


def _own_component() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")


def join(df: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row of ``doc_id, text``.

    ``n_links`` is the number of other documents whose set equals the row's or is similar to it.
    All pairs of sets of a component are verified for it. A document with several texts counts
    once for each of its sets.
    """
    members, sets, labelled = _components(df)
    plan = cut(labelled.join(_linked_copies(labelled, sets), "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    ))
    links = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
    return members.join(plan, "node", "left").select(
        "doc_id", "n_shingles", _own_component(), F.coalesce(links, F.lit(0)).cast("bigint").alias("n_links")
    )


def representatives(df: DataFrame) -> DataFrame:
    """The rows of one document of each component, the one with the least id.

    Rows without an id stay. Of repeated rows with that id one stays.
    """
    p = private(df)
    members, sets, labelled = _components(df.select("doc_id", "text"))
    found = members.join(labelled, "node", "left").select("doc_id", _own_component())
    keep = cut(found.where("doc_id = component_id").select(F.col("doc_id").alias(f"{p}id")).distinct())
    del members, sets, labelled, found  # their files go before whole rows are moved
    release(df.sparkSession)
    own = df.join(keep, df["doc_id"] == F.col(f"{p}id"), "left_semi").dropDuplicates(["doc_id"])
    return own.unionByName(df.where(df["doc_id"].isNull())).select(*quoted(df.columns))


def oracle() -> str:
    """All pairs of documents with a common shingle in DuckDB; for tables of some thousand documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS t FROM d),
u AS (SELECT doc_id, unnest(t) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (len(a.t) + len(b.t) - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, len(s.t) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM s JOIN m ON m.node = doc_id LEFT JOIN n ON n.x = doc_id
"""
