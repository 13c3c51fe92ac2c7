"""The numbered operators on odd texts, against plain Python, and on an empty table."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradframe.llm import (
    extraction, factorisation, fixity, graph, imatch, jaccard, licences, mixing, packing, personal, queries, rules,
)
from tests.llm import brute

WITHOUT_ID = 2


def by_id(rows):
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


def test_rules_measure_and_judge(edge, edge_texts):
    rows = rules.judge(edge).collect()
    assert len(rows) == edge.count()
    for d, r in by_id(rows).items():
        want = brute.measures(edge_texts[d])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_rules_keep_whole_rows(edge):
    kept = rules.accepted(edge)
    assert kept.columns == edge.columns
    want = Counter(r.doc_id for r in rules.judge(edge).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert {r._tmp_text for r in kept.collect()} <= {"y"}


def test_jaccard_components(edge, edge_texts):
    rows = jaccard.join(edge).collect()
    assert len(rows) == edge.count()
    want = brute.components(edge_texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    kept = jaccard.representatives(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in ids if d is not None) == sorted({root for _, root in want.values()})
    assert ids.count(None) == WITHOUT_ID


@pytest.mark.parametrize("long, hot", [(64, 1 << 12), (2, 1), (1, 1 << 12), (1000, 1)])
def test_jaccard_frequent_tokens_and_chains(spark, monkeypatch, long, hot):
    """Many near copies of long texts, chains of links, and a passage that unlike texts share.

    Lists of signatures count as long, or as possibly very long, from different lengths on.
    """
    import random

    monkeypatch.setattr(jaccard, "LONG_LIST", long)
    monkeypatch.setattr(jaccard, "HOT_LIST", hot)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 8 * jaccard.LEAST_TOKENS)

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, base, passage = {}, [word() for _ in range(400)], [word() for _ in range(70)]
    for d in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(400)] = word()
        texts[d] = " ".join(copy)
    chain = [word() for _ in range(100)]
    for d in range(100, 115):
        texts[d] = " ".join(chain)
        chain = chain[4:] + [word() for _ in range(4)]
    for d in range(200, 240):
        texts[d] = " ".join(passage + [word() for _ in range(rng.randint(5, 40))])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute.components(texts)


def test_jaccard_counts_all_links(spark, monkeypatch):
    """Links inside a component and to copies count, whatever blocks the sets lie in."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 4 * jaccard.LEAST_TOKENS)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(100)]
    near = lambda k: " ".join(base[:k] + [word()] + base[k + 1 :])
    texts = {d: near(40) for d in range(3)}  # three mutual near copies
    other = [word() for _ in range(120)]
    for d in range(10, 40):
        at = rng.randrange(110)
        texts[d] = " ".join(other[:at] + [word() for _ in range(rng.randint(1, 6))] + other[at + 4 :])
    texts |= {50: texts[12], 51: texts[12], 60: "five words that are alone", 61: "", 62: None}
    texts |= {70: "exact copies of one text here", 71: "exact copies of one text here"}
    sets = {d: brute.shingles(t) for d, t in texts.items()}
    similar = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    want = {d: sum(e != d and bool(similar(sets[d], sets[e])) for e in sets) for d in sets}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.n_links for r in jaccard.join(df).collect()}
    assert got == want and [got[d] for d in (0, 1, 2, 60, 62, 70, 71)] == [2, 2, 2, 0, 0, 1, 1]


def tasks_of(spark, run):
    """How many jobs and tasks Spark starts for a call."""
    import uuid

    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {k for j in jobs if (info := tracker.getJobInfo(j)) for k in info.stageIds}
    return len(jobs), sum(s.numCompletedTasks for k in stages if (s := tracker.getStageInfo(k)))


def test_components_of_few_edges_in_one_task(spark, monkeypatch):
    """A chain, a star, a loop and a repeated edge: few jobs for few edges, and the same roots by turns over all tasks."""
    import random

    rng = random.Random(4)
    chain = rng.sample(range(-500, 500), 200)
    star = [(2000, d) for d in rng.sample(range(1000, 2000), 50)]
    edges = [*zip(chain, chain[1:]), *star, (5000, 5000), (5001, 5002), (5002, 5001)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {n: min(chain) for n in chain} | {n: min(b for _, b in star) for n in [2000, *(b for _, b in star)]}
    want |= {5001: 5001, 5002: 5001}
    found = lambda: {r.node: r.root for r in graph.components(frame).collect() if r.node != 5000}
    got = {}
    jobs, _ = tasks_of(spark, lambda: got.update(found()))
    assert got == want and jobs <= 3
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 0)
    assert found() == want


def few_copies(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = {d: " ".join(base[:d] + [word()] + base[d + 1 :]) for d in range(0, 300, 4)}
    texts |= {d: " ".join(word() for _ in range(60)) for d in range(1000, 1050)}
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), texts


def test_jaccard_few_links_take_few_tasks(spark):
    """A table with few links and many shuffle partitions: its small tables do not take a task for each of these."""
    df, texts = few_copies(spark)
    names, got = {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, {}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        _, tasks = tasks_of(spark, lambda: got.update({r.doc_id: r.component_id for r in jaccard.join(df).collect()}))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {d: c for d, (_, c) in brute.components(texts).items()}
    assert tasks < 80 * 50


def test_jaccard_tables_too_large_for_one_task(spark, monkeypatch):
    """The same result where no table counts as small."""
    df, _ = few_copies(spark)
    want = sorted(jaccard.join(df).collect())
    monkeypatch.setattr(jaccard, "FEW_ROWS", 0)
    monkeypatch.setattr(jaccard, "LONG_LIST", 4)
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 0)
    assert sorted(jaccard.join(df).collect()) == want


def test_jaccard_makes_sets_of_likely_pairs_only(spark, monkeypatch):
    """Documents that share a phrase by chance: no whole sets are made of them, and no texts are shuffled to find those of others."""
    import random

    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    phrases = [words(7) for _ in range(10)]
    texts = {d: " ".join(words(150) + phrases[d % 10] + words(100)) for d in range(40)}
    copy = texts[3].split()
    texts |= {100: " ".join(copy[:40] + words(1) + copy[41:]), 101: " ".join(words(3000) + phrases[1])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    plans, write, name = [], jaccard.cut, "spark.sql.autoBroadcastJoinThreshold"

    def cut(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame)

    monkeypatch.setattr(jaccard, "cut", cut)
    monkeypatch.setattr(jaccard, "FEW_ROWS", 0)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        _, sets, labelled = jaccard._components(df)
        got = {r.first: r.component_id for r in labelled.join(sets.nodes.select("node", "first"), "node").collect()}
        made = sets.made.count()
    finally:
        spark.conf.set(name, before)
    assert got == {d: c for d, (_, c) in brute.components(texts).items()}
    assert made == 2
    built = [p for p in plans if "_build" in p]
    assert built and not any("SortMergeJoin" in p for p in built)


def test_signatures_meet(edge_texts):
    """Any two similar sets share a signature, whatever tokens count as frequent."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (4, 5, 9, 40, 300, 3000):
        for share in (0.0, 0.5, 1.0):
            levels = (rng.random(1 << jaccard.BUCKET_BITS) < share).astype(np.uint16)
            one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = size // 9
            two = np.unique(np.concatenate([one[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(one, two))
            if 100 * both >= 80 * (len(one) + len(two) - both):
                a, b = (jaccard.signatures(x, levels, 1)[0] for x in (one, two))
                assert len(np.intersect1d(a, b)), (size, share)


def test_imatch(edge, edge_texts):
    whole = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = by_id(imatch.fingerprinted(whole).collect())
    want = brute.edited(edge_texts)
    for d, r in rows.items():
        assert r.edited_sha256 == want[d], d
        assert r.n_chars == len(edge_texts[d] or "")
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[7].fingerprint == rows[8].fingerprint and rows[0].fingerprint == rows[1].fingerprint
    assert rows[3].fingerprint != rows[4].fingerprint
    assert imatch.fingerprinted(edge).count() == edge.count()


def test_imatch_large_groups_and_small_languages(spark):
    """A third of the rows from one group of near copies, and a text whose words nobody else has."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, stock = [word() for _ in range(200)], [word() for _ in range(3000)]
    texts = {d: " ".join(base[:k] + [word()] + base[k + 1 :]) for d, k in enumerate(range(0, 200, 2))}
    texts |= {d: " ".join(rng.sample(stock, 200)) for d in range(100, 298)}
    own = [word() for _ in range(200)]
    texts |= {298: " ".join(own), 299: " ".join(own[:-1])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in imatch.fingerprinted(df).collect()}
    assert min(got[d].near_next for d in range(1, 100)) > 0.5
    assert min(got[d].near_edited for d in range(1, 100)) > 0.2  # a third of the text is another one's
    assert got[299].near_next > 0.5 and got[100].near_next < 0.1
    copies = spark.createDataFrame([(d, "same text") for d in range(9)] + [(9, "other words")], "doc_id bigint, text string")
    assert imatch.lexicon(copies).count() == 0 and imatch.lexicon(df).count() > 1000


def test_imatch_across_blocks(spark):
    texts = {d: f"text number {d} of {d % 7} " * 3 for d in [*range(0, 400, 3), 9000, -5]}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.edited_sha256 for r in imatch.fingerprinted(df).collect()}
    assert got == brute.edited(texts)


def test_mixing_splits_equal_ids(spark):
    """Fifty rows of one id, of which a part reaches the target."""
    rows = [(1, "w " * 10, "a")] * 50 + [(k, "w " * 15, "b") for k in range(2, 40)] + [(None, "w " * 5, "b")] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    taken = Counter()
    for r in got:
        taken[r.target] += r.taken
    assert len(got) == len(rows) and all(abs(t - n) <= 15 for t, n in taken.items())
    assert mixing.mixed(df).where("doc_id = 1").count() * 10 == sum(r.taken for r in got if r.doc_id == 1)


def test_packing_is_exact_and_tight(edge, edge_texts):
    import numpy as np
    import zlib

    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    encoder = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.packed(edge).collect()
    assert packing.token_ids("x <|endoftext|> y").tolist() == [87, 220, 50256, 331, 0]
    for d, text in edge_texts.items():
        ids = np.array(encoder.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        repeats = 2 if d in (3, 8) else 1
        assert sum(r.length for r in own) == repeats * len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length <= packing.CAPACITY and zlib.crc32(part.tobytes()) == r.ids_crc32
            assert r.piece == 0 or r.length == packing.CAPACITY or len(ids) <= packing.CAPACITY
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= packing.CAPACITY
    assert len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1


def test_successor_steps_equal_best_fit_decreasing():
    import random

    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
        gaps = []
        for n in sorted(lengths, reverse=True):
            fitting = [g for g in gaps if g >= n]
            gaps.remove(min(fitting)) if fitting else None
            gaps.append((min(fitting) if fitting else capacity) - n)
        fill = Counter()
        for length, low, high, each, first, base in packing.successor_steps(Counter(lengths), capacity):
            for k in range(high - low + 1):
                assert fill[first + k // each] == base + (k % each) * length
                fill[first + k // each] += length
        assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= capacity
        assert len(fill) == len(gaps)


def test_mixing(edge, edge_texts):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count()
    size = {}
    for d, r in by_id(rows).items():
        assert r.size == len(brute.words(edge_texts[d])) and r.taken in (0, r.size, 2 * r.size)
    out = mixing.mixed(edge)
    assert out.columns == edge.columns
    often = Counter(r.doc_id for r in out.collect())
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.taken // r.size if r.size else 0
        size[r.doc_id] = r.size
    assert all(often[d] == taken[d] for d in size if size[d])


def test_mixing_targets(spark):
    rows = [(i, "w " * n, s, None) for i, (s, n) in enumerate([("a", 10), ("b", 100), ("c", 100), (None, 50)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, x string")
    got = {r.source_size: r.target for r in mixing.mix(df).where("doc_id in (0, 1, 3)").collect()}
    # 390 words; a stops at 20, the rest share 370 by 1 : 2 : 3, where 3 of null stops at 100
    assert got == pytest.approx({10: 20.0, 100: 90.0, 50: 100.0})


def test_fixity_finds_damage(spark):
    page = lambda k: (k, f"http://x/{k}", f"<p>{k}</p>" * (k % 9))
    pages = spark.createDataFrame([page(k) for k in range(3000)] + [(None, None, None), page(7)], "page_id bigint, url string, html string")
    first = fixity.placed(fixity.digests(pages)).cache()
    lost, changed = 1234, (5, 2999)
    second = first.where(f"page_id <> {lost} or page_id is null").withColumn(
        "sha256", F.when(F.col("page_id").isin(*changed), F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    )
    found = fixity.audit(first, second).join(first, "warc_offset").select("page_id", "status").collect()
    assert {(r.page_id, r.status) for r in found} == {(5, "changed"), (2999, "changed"), (lost, "missing")}
    assert fixity.audit(first, first).count() == 0
    assert [r.status for r in fixity.audit(second, first).where("status <> 'changed'").collect()] == ["added"]
    rows = fixity.audited(pages).collect()
    assert len(rows) == 3002 and sum(r.length for r in rows) == max(r.warc_offset + r.length for r in rows)


def test_extraction(spark):
    article = "<article><header><h1>Head &amp; tail</h1></header><p>One <b>bold</b>\n  text of some length here.<br>Two<p>Short.<p>" + "long words " * 40
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><div class='cookie-notice'>We use cookies<nav><ul><li>Menu</ul></nav></div>"
        + article + "<form>Search <input></form><aside>Side</aside><script>var x='<p>no</p>'</script></article>"
        "<div id=comments><p>I disagree with all of this very much, said a reader.</p></div><footer>&copy; me</footer></body></html>"
    )
    plain = "<div class=menu><a>A</a><a>B</a></div><div><p>" + "Real text. " * 30 + "</p><p>End.</p></div><div class='ad'>Buy</div>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", plain), (5, "u", "<p" * 1000), (6, "u", "text " * 50_000)]
    got = {r.page_id: r for r in extraction.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "Head & tail\nOne bold text of some length here. Two\nShort.\n" + ("long words " * 40).strip()
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text == ("Real text. " * 30).strip() + "\nEnd."
    assert got[6].n_chars == 5 * 50_000 - 1


def test_extraction_by_names():
    """A layout word in a class does not remove a page's text; menus and comments still go."""
    body = "<p>" + "Real text of the page. " * 30 + "</p>"
    want = ("Real text of the page. " * 30).strip()
    for tag in (
        "article class='post has-sidebar'", "article class='side widget'", "div class='content with-sidebar'", "div class='no-comments'",
        "div class='comments-open'", "div class='side-by-side'", "section id='discussion'", "div class='search-history'", "div class='content-sidebar'",
    ):
        name = tag.split()[0]
        page = f"<div class='main-nav'><p>Menu</p></div><{tag}>{body}</{name}><div id='comments'><article class='comment'><p>{'I disagree. ' * 30}</p></article></div>"
        assert extraction.main_text(page) == want, tag
    assert extraction.main_text(f"<div class='sidebar'><p>{'Beside it. ' * 40}</p></div><div>{body}</div>") == want
    assert extraction.main_text(f"<main><div class='sidebar'><p>{'Beside it. ' * 40}</p></div>{body}</main>") == want
    inside = extraction.main_text(f"<main><div class='sidebar'>{body}<article>{body}</article></div></main>")
    assert inside == want + "\n" + want


def test_personal_data(edge, edge_texts):
    rows = personal.digest(edge).collect()
    assert len(rows) == edge.count()
    for d, r in by_id(rows).items():
        assert r.base_sha256 == brute.base_sha256(edge_texts[d]), d
        kinds = Counter(k for *_, k in brute.personal(edge_texts[d]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in ("email", "ip", "card", "phone")]
    spans = by_id(rows)[15].spans
    assert "iban:" in spans and "secret:" in spans
    clean = personal.redact(edge)
    assert clean.columns == edge.columns
    text = by_id(clean.collect())[15].text
    assert "[IBAN]" in text and "[CARD]" in text and "4111 1111" not in text and "a.b@" not in text and "é漢字" in text
    assert by_id(clean.collect())[0].text is None


def test_personal_data_in_lists(spark):
    """A context word speaks for a list as far as its separators leave it in the window."""
    keys = [f"{k:x}7" * 16 for k in range(10, 14)]
    texts = [
        "SSNs: 123-45-6789, 987-65-4321, 555-12-3456", "tokens: " + ", ".join(keys), "123-45-6789, 987-65-4321 ssn",
        "numbers 123-45-6789, 987-65-4321", "ssn " + "x" * 40 + " 123-45-6789, 987-65-4321",
        "ssn " + ",".join(["123-45-6789"] * 60),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kinds = {d: [s.split(":")[0] for s in r.spans.split(",") if s] for d, r in by_id(personal.digest(df).collect()).items()}
    assert [kinds[d].count("ssn") for d in range(6)] == [3, 0, 2, 0, 0, 37] and kinds[1].count("secret") == 4
    clean = by_id(personal.redact(df).collect())
    assert clean[0].text == "SSNs: [SSN], [SSN], [SSN]" and clean[1].text == "tokens: " + ", ".join(["[SECRET]"] * 4)
    assert clean[3].text == texts[3]


def test_long_runs_stay_linear(spark):
    runs = ["x" * 1_000_000, "9" * 1_000_000, "a.b" * 300_000 + "@", "a@b." + "c." * 300_000 + "d", "1." * 500_000, "+1" * 300_000, "A" * 999_999]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id bigint, text string")
    rows = by_id(personal.digest(df).collect())
    assert rows[3].spans == f"email:0:{len(runs[3])}" and rows[0].spans == "" and rows[1].spans == ""
    assert licences.scan(df).count() == len(runs)


def test_license_scan(edge, edge_texts):
    rows = licences.scan(edge).collect()
    assert len(rows) == edge.count()
    for d, r in by_id(rows).items():
        want = brute.phrases(edge_texts[d])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, d
        assert set(filter(None, want[4].split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_id(rows)[16].labels == "cc-by,cc-by-nc-4.0,gpl,gpl-3,reserved"
    assert len(licences.signatures()) > 200


def test_license_priority(spark):
    cases = {
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "Released under the MIT License.": "mit",
        "Redistribution and use in source and binary forms, with or without": "permissive",
        "Distributed under the Boost Software License, Version 1.0": "boost-1.0",
        "a fine license to thrill": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licences.scan(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def _sample(pattern, rng):
    """A random text that a signature's regular expression describes."""
    from re import _parser as parser

    def of(items):
        out = ""
        for op, arg in items:
            match str(op):
                case "LITERAL": out += chr(arg)
                case "IN": out += rng.choice("0123456789") if "9" in str(arg) or "57" in str(arg) else "x"
                case "MAX_REPEAT" | "MIN_REPEAT": out += "".join(of(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 4))))
                case "SUBPATTERN": out += of(arg[3])
                case "BRANCH": out += of(rng.choice(arg[1]))
                case "ASSERT": pass
                case other: raise AssertionError(other)
        return out

    return of(parser.parse(pattern))


def test_license_gates_let_their_own_texts_pass(spark):
    """Every signature finds samples of itself, and every separator is one for base phrases and signatures."""
    import random

    rng, texts, want = random.Random(4), [], []
    for keys, own in licences.groups():
        for label, pattern, keyword, *_ in own:
            for _ in range(12):
                text = _sample(pattern, rng)
                assert re.fullmatch(pattern, f" {text} "[1:-1]) or re.search(pattern, f" {text} "), (pattern, text)
                assert any(k in f" {text} " for k in keys) and keyword in text, (pattern, text)
                texts.append(text)
    gaps = [chr(c) for c in range(128) if not chr(c).isalnum()]
    texts = list(dict.fromkeys(texts))
    texts += [t.replace(" ", rng.choice(gaps) + rng.choice(gaps)).upper() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert not [texts[k] for k in got if not got[k].labels]
    phrases = [f"x{g}{p.replace(' ', g).title()}{g}y" for p in licences.PHRASES for g in gaps]
    df = spark.createDataFrame(list(enumerate(phrases)), "doc_id bigint, text string")
    assert {(r.n_base, r.first_word) for r in licences.scan(df).collect()} == {(1, 1)}


def test_license_names_without_other_gate_words(spark):
    cases = {
        "Released under MIT": "mit", "available under the terms of Apache 2.0": "apache-2.0", "MPL 2.0": "mpl-2.0",
        "Mozilla Public 2.0": "mpl-2.0", "released under the WTFPL": "wtfpl", "EPL 2.0": "epl-2.0", "CC_BY": "cc-by", "mit ihm": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licences.scan(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = factorisation.classified(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_on_odd_texts(spark, edge):
    labels = spark.createDataFrame([(3, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (13, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = factorisation.classified(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)


def test_sum_of_squares_is_all_pairs():
    import numpy as np

    model = factorisation.untrained()
    slots, values = factorisation.features(b"some words here, some more words!", 33)
    z, _, _ = factorisation.margins(model, slots, values, np.array([0, len(slots)]))
    v = model.factors[slots] * values[:, None]
    pairs = sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
    assert z[0] == pytest.approx(pairs)


@pytest.mark.parametrize(
    "apply",
    [rules.judge, rules.accepted, jaccard.join, jaccard.representatives, imatch.fingerprinted, packing.packed, mixing.mix,
     mixing.mixed, personal.digest, personal.redact, licences.scan],
    ids=lambda f: f"{f.__module__.rsplit('.')[-1]}.{f.__name__}",
)
def test_empty_table(none, apply):
    assert apply(none).count() == 0


def test_other_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert factorisation.classified(none, labels).count() == 0
    assert extraction.extracted(pages).count() == 0 and fixity.audited(pages).count() == 0


def corpus():
    """Documents for the pipeline: prose of three sources, near and exact copies, junk, personal data."""
    import random

    rng = random.Random(21)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(stock) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    rows, base = [], prose(140)
    for d in range(60):
        rows.append((d, prose(rng.randint(60, 220)), ("a", "b", None)[d % 3]))
    for d in range(60, 70):
        w = base.split()
        w[3 * (d - 60)] = "changed"
        rows.append((d, " ".join(w), "a"))
    rows += [(70, rows[5][1], "b"), (71, "### $$$ " * 60, "a"), (72, "one two " * 80, "b"), (73, None, "a"), (74, "", None)]
    rows += [(75, prose(90) + " write to john.doe@mail.example.org or 10.1.2.3, card 4111 1111 1111 1111 " + prose(30), "b")]
    rows += [(None, prose(80), "a"), (12, rows[12][1], "a")]
    return rows


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage's rows follow from those of the stage before."""
    import zlib

    import numpy as np

    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    encoder = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, source string")
    kept, before = [], docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, "").write.parquet(f"{tmp_path}/{number}")
        before = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append(before.collect())
    good, single, clean, mix, pieces = kept
    measured = {d: brute.measures(t) for d, t, _ in corpus()}
    failed = {d for d, m in measured.items() if m[0] < 50 or 100 * m[4] > 50 * m[0]}
    assert not failed & {r.doc_id for r in good} and len(good) > 60
    links = brute.components({r.doc_id: r.text for r in good if r.doc_id is not None})
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted({root for _, root in links.values()})
    assert sum(r.doc_id is None for r in single) == sum(r.doc_id is None for r in good)
    own = {r.doc_id: r.text for r in single}
    assert not [r for r in clean if brute.personal(r.text)] and len(clean) == len(single)
    assert all(r.text == own[r.doc_id] for r in clean if not brute.personal(own[r.doc_id]) and r.doc_id != 75)
    sizes, counts = Counter(), Counter()
    for r in clean:
        sizes[r.source] += len(brute.words(r.text))
    for r in mix:
        counts[r.source] += len(brute.words(r.text))
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2)))
    goals, open_, left = {}, dict(weights), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        for s in over or list(open_):
            goals[s] = min(share[s], 2 * sizes[s])
            left -= goals[s]
            del open_[s]
    longest = max(len(brute.words(r.text)) for r in clean)
    assert all(abs(counts[s] - goals[s]) <= longest for s in goals), (counts, goals)
    want = Counter()
    for r in mix:
        ids = np.array(encoder.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for number, (start, length) in enumerate(packing.cut_points(len(ids), packing.CAPACITY)):
            want[r.doc_id, number, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    fill = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1


def test_pipeline_on_odd_and_empty_tables(spark, edge, none, tmp_path):
    docs = edge
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == edge.columns, name
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert docs.count() > 0
    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and all(re.match(r"op\d+_", q) for q in queries.QUERIES)


def test_extraction_is_linear_in_nesting():
    import time

    for page in ("<i>" * 250_000 + "</x>" * 250_000, "<i>" * 150_000 + "<p>a</p>" * 100_000, "<article><div>" * 60_000 + "text"):
        began = time.process_time()
        extraction.main_text(page)
        assert time.process_time() - began < 8, page[:20]


def test_extraction_keeps_whole_articles():
    long = "<p>" + "A sentence of the first article, which goes on for a while. " * 14 + "</p>"
    page = f"<body><nav>Menu</nav><article>{long}</article><article><p>Short.</p></article><footer>Foot</footer></body>"
    assert extraction.main_text(page).split("\n")[1:] == ["Short."]
    wrapped = f"<body><div class='no-sidebar sidebar-menu'><h1>Title</h1>{long}{long}</div></body>"
    assert extraction.main_text(wrapped).startswith("Title\nA sentence")
    menu = f"<body><div class='sidebar-menu'><p>Menu</p></div><h1>Title</h1>{long}<div class='comments'><h2>x</h2>{long}{long}{long}{long}</div></body>"
    assert "Menu" not in extraction.main_text(menu) and extraction.main_text(menu).count("A sentence") == 14


def test_secrets_without_digits(spark):
    text = "secret key: " + "abcdef" * 6
    df = spark.createDataFrame([(1, text), (2, "abcdef" * 6)], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in personal.digest(df).collect()}
    assert got == {1: "secret:12:48", 2: ""}
    assert personal.redact(df).where("doc_id = 1").first().text == "secret key: [SECRET]"


def test_replicas_are_hashed_from_their_own_records(spark, none):
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", "h" * i, i, "s", "o") for i in range(300)] + [(7, None, None, 1, "s", "o")] * 2 + [(None, "u", "x" * 300_000, 1, "s", "o")],
        "page_id bigint, url string, html string, length int, sha256 string, warc_offset string",
    )
    rows = fixity.audited(pages).collect()
    assert len(rows) == 303
    at = 0
    for r in sorted(rows, key=lambda r: r.warc_offset):
        assert r.warc_offset == at
        at += r.length
    import hashlib

    fault = lambda i: {"07": "changed", "7e": "changed", "2a": "missing"}.get(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:2], "same")
    assert Counter((r.page_id, r.status) for r in rows) == Counter((r.page_id, fault(r.page_id)) for r in rows)


def test_sketches_never_overstate_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for m, n in ((3, 3), (100, 130), (900, 1100), (30_000, 29_000)):
        pool = rng.integers(0, 1 << 63, 2 * max(m, n), dtype=np.uint64)
        one, two = np.unique(rng.choice(pool, m)), np.unique(rng.choice(pool, n))
        bound = jaccard.difference(jaccard.sketch(one).tobytes(), jaccard.sketch(two).tobytes())
        assert bound <= len(np.setxor1d(one, two))
        assert jaccard.difference(jaccard.sketch(one).tobytes(), jaccard.sketch(one).tobytes()) == 0
