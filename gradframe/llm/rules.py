"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains. Votes are counted by pattern, so
that the estimation works on at most ``3 ** len(RULES)`` rows whatever the number of
documents that pass the base test is. Expectation-maximisation then estimates, without labels, how often
each rule votes good on good and on bad documents, and the posterior probability
of a document's votes decides. All of it is DataFrame functions; one round of the
estimation is one aggregate over the pattern table.

Defined cases: a null text counts as empty and fails the base test (so it is
never kept); repeated rows vote as often as they occur; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import SPACE, positions, private, quoted, text_of, words
from gradframe.plans.lineage import cut

PLACE_BITS = 30  # of a packed window: its place; the rest is hash, compared exactly afterwards
PLACE = (1 << PLACE_BITS) - 1
SYMBOLS = "#*$%&|<>"  # fixed values
LEAST_WORDS = 50
REPEATED_PERCENT = 50

#: Rules as (name, left side, right side of "bad if left > right", left, right of "good if left < right"),
#: all integer expressions both Spark and SQL understand alike.
RULES = (
    ("symbols", "10 * n_symbols", "n_words", "50 * n_symbols", "n_words"),
    ("density", "25 * n_symbols", "word_chars", "200 * n_symbols", "word_chars"),
    ("tainted", "10 * n_tainted", "n_words", "50 * n_tainted", "n_words"),
    ("lines", "5 * n_dup_lines", "n_lines", "n_dup_lines", "case when n_lines > 2 then 1 else 0 end"),
    ("repeats", "100 * n_repeat_words", "35 * n_words", "100 * n_repeat_words", "15 * n_words"),
    ("capitals", "10 * n_upper", "3 * word_chars", "20 * n_upper", "3 * word_chars"),
    ("marks", "5 * n_marks", "n_words", "50 * n_marks", "n_words + 1"),
)
ROUNDS = 15
START_PRIOR = 0.85
START_GOOD, START_BAD = 0.9, 0.3  # chance of a vote for good on good and on bad documents
SMOOTH = 1.0
THRESHOLD = 0.5


@dataclass
class Fitted:
    """Share of good documents, and per rule the chance of a vote for good on good and on bad ones."""

    prior: float
    good: list[float]
    bad: list[float]


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and what the rules need besides.

    Words in repeated windows are found in two steps: the windows' hashes, packed with
    their places, are sorted and neighbours with equal hashes taken; only those are
    compared as words. Both steps are sorts, so long texts stay near-linear.
    """
    p = private(df)
    keep = quoted(df.columns)
    col = lambda name: F.col(p + name)
    out = df.withColumn(f"{p}text", text_of(df, text))
    out = out.withColumn(f"{p}w", words(col("text")))
    n = F.size(col("w"))
    hashed = lambda i: F.xxhash64(F.get(col("w"), i), F.get(col("w"), i + 1), F.get(col("w"), i + 2))
    packed = F.sort_array(
        F.transform(positions(n - 2), lambda i: F.shiftleft(hashed(i), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    )
    lines = F.filter(
        F.split(col("text"), "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")
    )
    without = lambda signs: F.length(col("text")) - F.length(F.regexp_replace(col("text"), signs, ""))
    out = out.select(
        *keep,
        col("w"),
        n.cast("bigint").alias(f"{p}n_words"),
        F.length(F.array_join(col("w"), "")).cast("bigint").alias(f"{p}word_chars"),
        without(f"[{SYMBOLS}]+").cast("bigint").alias(f"{p}n_symbols"),
        without("[A-Z]+").cast("bigint").alias(f"{p}n_upper"),
        without("[!?]{2,}").cast("bigint").alias(f"{p}n_marks"),
        F.size(F.filter(col("w"), lambda w: w.rlike(f"[{SYMBOLS}]"))).cast("bigint").alias(f"{p}n_tainted"),
        lines.alias(f"{p}lines"),
        packed.alias(f"{p}packed"),
    )
    head = lambda x: F.shiftright(x, PLACE_BITS)
    twin = lambda j: head(F.get(col("packed"), j))
    candidates = F.filter(
        col("packed"), lambda x, j: (head(x) == twin(j - 1)) | (head(x) == twin(j + 1))
    )
    out = out.select(
        *keep,
        col("w"),
        *[col(c) for c in ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_tainted")],
        F.size(col("lines")).cast("bigint").alias(f"{p}n_lines"),
        (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("bigint").alias(f"{p}n_dup_lines"),
        candidates.alias(f"{p}cand"),
    )
    window = lambda i: F.concat_ws(" ", F.get(col("w"), i), F.get(col("w"), i + 1), F.get(col("w"), i + 2))
    place = lambda x: x.bitwiseAND(F.lit(PLACE).cast("bigint")).cast("int")
    spelled = F.sort_array(
        F.transform(col("cand"), lambda x: F.struct(window(place(x)).alias("k"), place(x).alias("i")))
    )
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks", "n_tainted")
    out = out.select(*keep, *[col(c) for c in measures], spelled.alias(f"{p}spelled"))
    key = lambda j: F.get(col("spelled"), j)["k"]
    same = F.filter(col("spelled"), lambda s, j: (s["k"] == key(j - 1)) | (s["k"] == key(j + 1)))
    repeated = F.sort_array(F.transform(same, lambda s: s["i"]))
    begin = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("end"))
    cover = lambda acc, i: F.struct(
        (acc["total"] + (i + 3 - F.greatest(i, acc["end"])).cast("bigint")).alias("total"), (i + 3).alias("end")
    )
    clash = {c.lower() for c in df.columns}
    name = lambda c: c if c.lower() not in clash else f"{p}{c}"
    return out.select(
        *keep,
        *[col(c).alias(name(c)) for c in measures],
        F.aggregate(repeated, begin, cover, lambda acc: acc["total"]).alias(name("n_repeat_words")),
    )


def _vote(rule: tuple) -> Column:
    """1 for good, -1 for bad, 0 for an abstention."""
    _, bad_left, bad_right, good_left, good_right = rule
    return F.expr(
        f"case when {bad_left} > {bad_right} then -1 when {good_left} < {good_right} then 1 else 0 end"
    )


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    )


def _voted(measures: DataFrame) -> DataFrame:
    return measures.select("*", _failed().alias("failed"), *[_vote(r).alias(f"v_{r[0]}") for r in RULES])


def _posterior(fitted: Fitted) -> Column:
    """Chance that a document with these votes is good, abstentions left out."""
    good, bad = F.lit(fitted.prior), F.lit(1 - fitted.prior)
    for (name, *_), g, b in zip(RULES, fitted.good, fitted.bad):
        vote = F.col(f"v_{name}")
        of = lambda chance: F.when(vote == 1, chance).when(vote == -1, 1 - chance).otherwise(1.0)
        good, bad = good * of(g), bad * of(b)
    return good / (good + bad)


def fit(votes: DataFrame, rounds: int = ROUNDS) -> Fitted:
    """Expectation-maximisation on the vote patterns of all documents not ``failed``."""
    names = [f"v_{rule[0]}" for rule in RULES]
    passed = F.count_if(~F.col("failed")).alias("n")
    patterns = cut(votes.groupBy(*names).agg(passed).where("n > 0").coalesce(1))
    fitted = Fitted(START_PRIOR, [START_GOOD] * len(RULES), [START_BAD] * len(RULES))
    for _ in range(rounds):
        weighed = patterns.withColumn("g", F.col("n") * _posterior(fitted)).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum("n").alias("n"), F.sum("g").alias("g")]
        for name in names:
            for side in "gb":
                sums.append(F.sum(F.when(F.col(name) == 1, F.col(side)).otherwise(0.0)).alias(f"{name}_{side}1"))
                sums.append(F.sum(F.when(F.col(name) != 0, F.col(side)).otherwise(0.0)).alias(f"{name}_{side}"))
        row = weighed.agg(*sums).first()
        if not row["n"]:
            return fitted
        share = lambda name, side: (row[f"{name}_{side}1"] + SMOOTH) / (row[f"{name}_{side}"] + 2 * SMOOTH)
        fitted = Fitted(
            (row["g"] + SMOOTH) / (row["n"] + 2 * SMOOTH),
            [share(name, "g") for name in names],
            [share(name, "b") for name in names],
        )
    return fitted


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: measures, ``base_failed``, ``kept`` and ``posterior``."""
    plain = df.select(df[key].alias("doc_id"), df[text].alias("_text"))
    votes = cut(_voted(measured(plain, "_text").drop("_text")))
    quality = _posterior(fit(votes))
    return votes.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("base_failed"),
        (~F.col("failed") & (quality >= THRESHOLD)).alias("kept"),
        F.round(quality, 6).alias("posterior"),
    )


def accepted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns and no join.

    The votes are counted in a first pass; the second one measures the texts again
    and applies the fitted model, so that no text is shuffled.
    """
    p = private(df)
    inner = df.select(F.struct(*quoted(df.columns)).alias(f"{p}row"), quoted([text])[0].alias(f"{p}text"))
    own = _voted(measured(inner, f"{p}text"))
    quality = _posterior(fit(own.select("failed", *[f"v_{r[0]}" for r in RULES])))
    # a filter on a row number stays above the measures; otherwise the optimizer moves it below
    # them and writes them out once for each time that the condition names them
    numbered = own.withColumn(f"{p}n", F.monotonically_increasing_id())
    kept = numbered.where((~F.col("failed") & (quality >= THRESHOLD)) == (F.col(f"{p}n") >= 0))
    return kept.select(*[F.col(f"{p}row")[c].alias(c) for c in df.columns])


def oracle(rounds: int = ROUNDS) -> str:
    """The same for DuckDB, every round of the estimation as a common table."""
    names = [f"v_{rule[0]}" for rule in RULES]
    vote = lambda r: (
        f"case when {r[1]} > {r[2]} then -1 when {r[3]} < {r[4]} then 1 else 0 end as v_{r[0]}"
    )
    chance = lambda side: " * ".join(
        f"(case when {n} = 1 then {n}_{side} when {n} = -1 then 1 - {n}_{side} else 1.0 end)" for n in names
    )
    posterior = f"(prior * {chance('g')}) / (prior * {chance('g')} + (1 - prior) * {chance('b')})"
    starts = ", ".join(f"{START_GOOD}::double as {n}_g, {START_BAD}::double as {n}_b" for n in names)
    share = lambda n, s: (
        f"(sum(case when {n} = 1 then {s} else 0 end) + {SMOOTH}) / "
        f"(sum(case when {n} <> 0 then {s} else 0 end) + {2 * SMOOTH}) as {n}_{s}"
    )
    steps = [f"fit0 as (select {START_PRIOR}::double as prior, {starts})"]
    for k in range(rounds):
        steps.append(
            f"w{k} as materialized (select p.*, n * {posterior} as g, n - n * {posterior} as b from patterns p, fit{k})"
        )
        shares = ", ".join(share(n, s) for n in names for s in "gb")
        steps.append(
            f"fit{k + 1} as materialized (select (sum(g) + {SMOOTH}) / (sum(n) + {2 * SMOOTH}) as prior, {shares} from w{k})"
        )
    return f"""
with texts as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
split as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from texts),
windows as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k
  from (select r, w, unnest(range(1, len(w) - 1)) as i from split)),
twice as (select r, i from windows qualify count(*) over (partition by r, k) > 1),
covered as (select r, count(distinct i + d) as n_repeat_words from twice, range(3) as s(d) group by r),
measures as (select doc_id, r, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[{SYMBOLS}]+', '', 'g')))::bigint as n_symbols,
  (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')))::bigint as n_upper,
  (length(t) - length(regexp_replace(t, '[!?]{{2,}}', '', 'g')))::bigint as n_marks,
  len(list_filter(w, lambda x: regexp_matches(x, '[{SYMBOLS}]')))::bigint as n_tainted,
  len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from split left join covered using (r)),
votes as materialized (select *, {", ".join(vote(r) for r in RULES)},
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words as base_failed from measures),
patterns as materialized (select {", ".join(names)}, count(*)::double as n from votes where not base_failed group by all),
{", ".join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {posterior} >= {THRESHOLD} as kept, round({posterior}, 6) as posterior
from votes, fit{rounds}"""
