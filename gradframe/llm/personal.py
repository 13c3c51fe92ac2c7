"""Personal data: patterns propose spans, checksums confirm, context words adjust.

All of it is DataFrame functions. Long texts stay linear: every pattern starts
at the beginning of a run (or where the last match ended) and uses possessive
loops, so neither a long run of letters nor of digits is tried from each of its
characters.

Defined cases: a null text counts as empty and gives zero spans; spans of
different kinds may overlap and are all reported; repeated rows give repeated results;
texts of any length are read whole; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradframe.llm.columns import located, positions, private, quoted, starts, text_of

# fixed values: patterns by kind, in the order in which spans at one place are listed
MAIL_CHARS = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{MAIL_CHARS}]))[{MAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
# fixed values: cheap test a text must pass before a pattern is tried
GATES = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "secret": r"[0-9A-Fa-f]{32}",
}
# fixed values: words near a span that speak for its kind, before checksums are counted
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|pay|number",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto", "ssn": "ssn|social|security",
    "secret": "token|secret|key|password|passwd|auth",
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.35, "secret": 0.3}
BOOST = 0.3
NEAR = 40  # characters looked at on either side, matches of the same kind skipped
LEAST = 0.5  # spans of the added kinds need this score


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Remainder of an account number, its first four signs moved to the end."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        sign = F.ascii(F.substr(turned, i + 1, F.lit(1)))
        digit = sign < 58
        return (acc * F.when(digit, 10).otherwise(100) + sign - F.when(digit, 48).otherwise(55)) % 97

    return F.aggregate(positions(F.length(turned)), F.lit(0), step)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(match) <= 42, _mod97(match) == 1).otherwise(False)
    return F.lit(True)


def _windows(pieces: Column) -> Column:
    """The last and the first ``NEAR`` characters of every piece, as ``last`` and ``first``."""
    return F.struct(
        F.transform(pieces, lambda piece: F.right(piece, F.lit(NEAR))).alias("last"),
        F.transform(pieces, lambda piece: F.left(piece, F.lit(NEAR))).alias("first"),
    )


def _with_windows(pieces: Column, use) -> Column:
    """``use(windows)``, with the windows made once for a text and not again for each of its matches."""
    return F.get(F.transform(F.array(_windows(pieces)), use), 0)


def _score(kind: str, windows: Column, k: Column) -> Column:
    """Score of match ``k``: its kind's, raised if a context word stands near.

    Near are the ``NEAR`` characters before and after it that are in no match of the kind, so a
    word speaks for a list whose separators do not fill them. No more than ``NEAR`` pieces are needed for them.
    """
    first = F.greatest(k - (NEAR - 1), F.lit(0))
    before = F.array_join(F.slice(windows["last"], first + 1, k - first + 1), "")
    after = F.array_join(F.slice(windows["first"], k + 2, NEAR), "")
    words = lambda side: F.lower(side).rlike(CONTEXT[kind])
    near = words(F.right(before, F.lit(NEAR))) | words(F.left(after, F.lit(NEAR)))
    return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, BOOST).otherwise(0.0))


def _accepted(kind: str, match: Column, score: Column) -> Column:
    """Base kinds only need their checksum or limits, the others a high enough score too."""
    return _valid(kind, match) if kind in BASE else _valid(kind, match) & (score >= LEAST)


def _spans(kind: str, p: str) -> Column:
    """Accepted spans of one kind as ``(start, rank, end, kind, score)``."""
    matches, pieces, at = F.col(f"{p}m_{kind}"), F.col(f"{p}p_{kind}"), F.col(f"{p}s_{kind}")
    rank = list(PATTERNS).index(kind)

    def span(k: Column, windows: Column) -> Column:
        match, score = F.get(matches, k), _score(kind, windows, k)
        return F.struct(
            F.get(at, k).alias("start"),
            F.lit(rank).alias("rank"),
            (F.get(at, k) + F.length(match)).alias("end"),
            F.lit(kind).alias("kind"),
            score.alias("score"),
            _accepted(kind, match, score).alias("ok"),
        )

    every = _with_windows(pieces, lambda w: F.transform(positions(F.size(matches)), lambda k: span(k, w)))
    return F.filter(every, lambda s: s["ok"])


def _searched(df: DataFrame, whole: Column, p: str, kinds: dict[str, str]) -> DataFrame:
    """Add the matches ``m_`` of some kinds and the pieces ``p_`` around them."""
    none = F.array().cast("array<string>")
    gate = lambda kind: whole.rlike(GATES[kind])
    out = df.withColumns(
        {f"{p}m_{k}": F.when(gate(k), located(whole, x)[0]).otherwise(none) for k, x in kinds.items()}
    )
    found = lambda kind: F.size(F.col(f"{p}m_{kind}")) > 0
    return out.withColumns(
        {f"{p}p_{k}": F.when(found(k), located(whole, x)[1]).otherwise(none) for k, x in kinds.items()}
    )


def with_spans(df: DataFrame, text: str = "text", name: str = "_spans") -> DataFrame:
    """Add the sorted spans of every row's text as an array of structs.

    A span is ``(start, rank, end, kind, score, ok)`` in code points, end exclusive,
    sorted by start, then by kind.
    """
    p = private(df)
    whole = F.col(f"{p}text")
    out = df.withColumn(f"{p}text", text_of(df, text))
    out = _searched(out, whole, p, PATTERNS)
    out = out.withColumns(
        {f"{p}s_{k}": starts(F.col(f"{p}m_{k}"), F.col(f"{p}p_{k}")) for k in PATTERNS}
    )
    every = F.concat(*[_spans(kind, p) for kind in PATTERNS])
    return out.select(*quoted(df.columns), F.sort_array(every).alias(name))


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(df: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = with_spans(df.select("doc_id", "text")).select("doc_id", "_spans")
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
    )


def _hidden(kind: str, matches: Column, pieces: Column, whole: Column) -> Column:
    """The text with the accepted matches of one kind replaced."""

    def part(k: Column, windows: Column) -> Column:
        match = F.get(matches, k)
        accepted = _accepted(kind, match, _score(kind, windows, k))
        return F.concat(F.get(pieces, k), F.when(accepted, f"[{kind.upper()}]").otherwise(match))

    parts = _with_windows(pieces, lambda w: F.transform(positions(F.size(matches)), lambda k: part(k, w)))
    joined = F.concat(F.array_join(parts, ""), F.get(pieces, F.size(matches)))
    return F.when(F.size(matches) > 0, joined).otherwise(whole)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every accepted match replaced by its kind in brackets.

    Kinds are replaced one after the other in their order, so where two overlap the
    first one gives the name. A null text stays null, one without matches as it is.
    """
    p = private(df)
    whole = F.col(f"{p}text")
    own = quoted([text])[0]
    out = df.withColumn(f"{p}text", own)
    for kind, pattern in PATTERNS.items():
        out = _searched(out, whole, p, {kind: pattern})
        hidden = _hidden(kind, F.col(f"{p}m_{kind}"), F.col(f"{p}p_{kind}"), whole)
        out = out.withColumn(f"{p}text", hidden).drop(f"{p}m_{kind}", f"{p}p_{kind}")
    others = [whole.alias(c) if c == text else q for c, q in zip(df.columns, quoted(df.columns))]
    return out.select(*others)
