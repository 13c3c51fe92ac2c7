"""Periodic runs, the conversation trie and exact top-k search on odd rows, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from gradframe.llm import conversations, periods, topk
from tests.llm import brute


def runs_of(w, min_length=24, min_periods=3):
    """Stretches of equal words ``q`` apart, for every ``q`` by itself."""
    out = set()
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(min_length, min_periods * q):
                if not any(w[i : j + q - r] == w[i + r : j + q] for r in range(1, q)):
                    out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc, text):
    w = brute.words(text)
    if doc is None:
        return w
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def summary(doc, text):
    w = planted(doc, text)
    runs = runs_of(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    most = best + (1000 * best[1] // best[2],) if best else (None,) * 4
    return (len(runs), *most, sha(lines), sha(kept))


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.randint(1, 4)
        w = [rng.randrange(k) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            at, p, n = rng.randrange(len(w) + 1), rng.randint(1, 12), rng.randint(1, 60)
            w[at:at] = ([rng.randrange(k + 3) for _ in range(p)] * 60)[:n]
        bounds = rng.choice([(24, 3), (24, 3), (10, 2), (1, 2), (30, 4)])
        got = [tuple(map(int, r)) for r in periods.runs_of(np.array(w, np.int64), *bounds)]
        assert got == runs_of(w, *bounds), (w, bounds)


def test_longest_common_extensions():
    rng = random.Random(2)
    w = [rng.randrange(2) for _ in range(120)] + [0, 1, 2] * 20
    tree, order = periods.SuffixTree(w), sorted(range(len(w)), key=lambda i: w[i:])
    assert tree.ranks().argsort().tolist() == [i + 0 for i in order]
    one, two = np.array([(i, j) for i in range(len(w)) for j in range(i)]).T
    for i, j, got in zip(one, two, tree.common(one, two)):
        assert w[i : i + got] == w[j : j + got]
        assert max(i, j) + got == len(w) or w[i + got] != w[j + got]


def test_runs_of_documents(spark, edge, edge_texts, none):
    rows = [(d, t) for d, t in edge_texts.items() if d != 14]  # the brute-force version is too slow for two long ones
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    ids = [d for d in range(100, 400) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows = [(d, t) for d, t in rows if len(brute.words(t)) < 5_000]
    rows += [(d, words(30 + 7 * k)) for k, d in enumerate(ids[:12])] + [(ids[12], "solo"), (ids[13], ""), (ids[14], None)]
    rows += [(500, ("a b " * 20 + "c ") * 4), (None, "x " * 30), (None, None), (500, ("a b " * 20 + "c ") * 4)]
    df = spark.createDataFrame([(d, t, 1, "x", "y", []) for d, t in rows], "doc_id int, text string, runs int, start string, collapsed string, best array<int>")
    got = periods.summarised(periods.detect(periods.planted(df))).collect()
    key = lambda r: (str(r[0]), r[1:])
    mine = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got]
    assert sorted(mine, key=key) == sorted([(d, *summary(d, t)) for d, t in rows], key=key)
    assert periods.detect(edge).count() == edge.count()  # the long texts too
    assert periods.summarised(periods.detect(periods.planted(none))).count() == 0
    with pytest.raises(ValueError):
        periods.detect(none, min_periods=1)


def key_of(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).hexdigest()


def whole_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key_of(role, text), len((text or "").encode())))
    for c in own:
        own[c] = [t[2:] for t in sorted(own[c])]
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        members[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    under = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            under[tuple(turns[:d])].append(c)
    out = []
    for path, convs in under.items():
        inside = [p for p in under if p[: len(path)] == path]
        ends = sorted(c for c in convs if len(members[c]) == len(path))
        out.append((
            min(convs), len(path), min(under[path[:-1]]) if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in inside),
            sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in inside) for p in inside),
            sum((len(under[p]) - 1) * (p[-1][1] if p else 0) for p in inside),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def odd_conversations():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 4)))
    stock = [[(rng.choice(["user", None, ""]), word()) for _ in range(6)] for _ in range(4)]
    rows = []
    for c in [*range(-12, 60), 10**12]:
        base = list(rng.choice(stock)) if rng.random() < 0.7 else []
        turns = base[: rng.randint(0, 6)] + [("assistant", word()) for _ in range(rng.randint(0 if base else 1, 5))]
        rows += [(c, t if rng.random() < 0.95 else None, *turn) for t, turn in enumerate(turns)]
    for c in range(100, 160):  # copies, a third of all
        rows += [(c, t, *turn) for t, turn in enumerate(stock[0])]
    rows += [(200, 1, "user", None), (200, 1, "user", None), (200, 1, None, "x" * 200_000), (None, 1, "user", "lost"), (201, None, None, None)]
    return rows


@pytest.mark.parametrize("container", [1, 6, 40, conversations.CONTAINER])
def test_conversation_trie(spark, container):
    rows = odd_conversations()
    kind = "conv_id bigint, turn bigint, role string, text string, pos string, head int, key string, depth string, n int, class string"
    df = spark.createDataFrame([(*r, "p", 1, "k", "d", 2, "c") for r in rows], kind)
    turns = conversations.turns(df)
    got = conversations.trie(conversations.rebuilt(turns), container).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == whole_trie(rows)
    if container == 6:
        got = conversations.trie(turns, container).select(*COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == whole_trie(rows, rebuild=False)


def test_conversation_ends_in_pieces(spark, monkeypatch):
    """Members of one node lie in several ranges."""
    from gradframe.plans import ordered

    monkeypatch.setattr(ordered, "RANGE_BITS", 3)
    rows = [(c, 0, "user", "same") for c in range(5, 300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = conversations.trie(conversations.turns(df)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == whole_trie(rows, rebuild=False)


def test_conversation_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.trie(conversations.rebuilt(conversations.turns(df))).count() == 0


def whole_search(rows, k, every):
    held = []
    for name, vector in rows:
        if name is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            held.append((name, [math.floor(Fraction(x) * 256) for x in vector]))
    out = []
    for i, (name, q) in enumerate(held):
        if name % every == 0:
            found = [(min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, v)))), other) for j, (other, v) in enumerate(held) if j != i]
            best = sorted(found, key=lambda h: (-h[0], h[1]))[:k]
            out += [(name, rank, other, score) for rank, (score, other) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, topk.SHARD_ROWS])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    rng = random.Random(8)
    vector = lambda n=8: [rng.gauss(0, 0.2) for _ in range(n)]
    rows = [(i, vector()) for i in range(-30, 90)]
    rows += [(i, [0.25] * 8) for i in (200, 201, 202, 203, 204, 205, 210)]  # ties
    rows += [(10, vector()), (10, rows[40][1]), (20, rows[50][1])]  # repeated ids and rows
    rows += [(300, None), (310, []), (320, [None] * 8), (330, [float("nan")] * 8), (340, [float("inf")] * 8)]
    rows += [(350, vector(3)), (360, vector(12)), (None, vector()), (370, [0.0] * 8), (380, [-0.001] * 8)]
    df = spark.createDataFrame(
        [(i, v, 1, "s", 0, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, shard string, block int, score double"
    ).repartition(3)
    for k, every in ((5, 10), (1, 1), (200, 50)):
        got = topk.search(df, k, every).collect()
        assert sorted(map(tuple, got)) == whole_search(rows, k, every), (k, every)


def test_top_k_of_huge_numbers(spark):
    rows = [(0, [1e15, 2.0]), (1, [1e15, -3.0]), (2, [-1e15, 1.0]), (3, [1e300, 0.0]), (4, [-1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, 3, 2).collect())) == whole_search(rows, 3, 2)


def test_top_k_by_shuffle(spark, monkeypatch):
    """Queries too many to be broadcast are dealt to stripes."""
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(topk, "SHARD_ROWS", 5)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    near = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, topk.search(df, 5, 10).collect())) == whole_search(near, 5, 10)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.search(df).count() == 0


def test_competing_vectors_hold_all_that_reach_the_floor():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, d = rng.integers(1, 60), rng.integers(1, 40)
        table = np.floor(rng.normal(0, rng.choice([1, 3, 40, 1000]), (n, d)))
        index, q = topk.Postings(table, np.arange(n)), np.floor(rng.normal(0, 30, d))
        scores = table @ q
        for floor in (-np.inf, np.median(scores), scores.max(), 0.0, scores.max() + 1):
            assert set(np.flatnonzero(scores >= floor)) <= set(index.competing(q, floor - 1e-3).tolist())
