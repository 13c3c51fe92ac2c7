import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators use themselves
    "kept boolean, size bigint, h bigint, rank int, block bigint, _text string, _tmp_text string, n_words string, "
    "sequence_id string, component_id string, node string, score string, failed string, v_symbols int"
)
EXTRA = (True, 1, 2, 3, 4, "x", "y", "z", "s", "c", "n", "q", "f", 5)


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    near = lambda k: " ".join(base[:k] + [word()] + base[k + 1 :])
    long = " ".join(word() for _ in range(30_000))
    personal = (
        "Mail a.b@c.example.com. x@y z@w.q.r_t@u.v now 10.0.0.255 or 1.2.3.256 and 1.2.3.4.5.6.7.8, pay 4111 1111 1111 1111 "
        "or 4111-1111-1111-1112, call +1 (017) 555-7713 or +12; IBAN GB82 WEST 1234 5698 7654 32, password = "
        "0123456789abcdef0123456789abcdef é漢字 ++1 555 555 5555 5"
    )
    license = "Licensed under CC BY-NC 4.0. ALL rights -- reserved! This is under the GNU General Public License, version 3. cc by cc by"
    return {
        0: None, 1: "", 2: " \n\t ", 3: "tiny", 4: "one two three four", 5: "one two three four", 6: "a b c d e",
        7: " ".join(base), 8: " ".join(base), 9: near(3), 10: near(60).upper(), 11: near(118), 12: " ".join(base[60:] + base[:60]),
        13: long, 14: long + " tail", 15: personal, 16: license, 17: "x" * 4_000, 18: "9" * 5_000, 19: "a.b" * 1_500 + "@",
        20: "same line\n" * 40, 21: "the cat sat on the cat sat on the cat " * 3, 22: "word### next$$$ " * 60,
        23: "a@b." + "c." * 2_000 + "d", 24: "line one two\n\nline one two\nother line\n", 25: "éÉ漢 " * 30, 26: "  two  spaces \n ",
    }


@pytest.fixture(scope="session")
def edge_texts():
    return texts()


@pytest.fixture(scope="session")
def edge(spark, edge_texts):
    """Odd texts with clashing columns; the documents 3 and 8 are there twice, one row has no id."""
    row = lambda d, t: (d, t, "en", ("a", "b", None)[(d or 0) % 3], None if t is None else len(t), *EXTRA)
    rows = [row(d, t) for d, t in edge_texts.items()]
    rows += [row(3, edge_texts[3]), row(8, edge_texts[8]), row(None, edge_texts[7]), row(None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
