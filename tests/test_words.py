"""Words of documents: nothing per document is moved for the dictionary, and counts take little room."""

from pyspark.sql import functions as F

from gradframe.operators import text


def documents(spark):
    rows = [(3, "b a b"), (-2, "c, c d"), (None, "e a"), (7, None), (9, " "), ((1 << 63) - 1, "z b"), (-(1 << 63), "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_dictionary_moves_one_row_per_word_and_task(spark):
    found = text.tokens(documents(spark))
    first = found.groupBy("word").agg(F.min(text._place(found)).alias("first"))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    got = text.dictionary(documents(spark)).orderBy("word_id").collect()
    assert [(r["word_id"], r["word"]) for r in got] == list(enumerate(["e", "a", "y", "c", "d", "b", "z"]))


def test_dictionary_writes_no_counts_of_documents(spark, monkeypatch):
    written = []
    cut = text.cut
    monkeypatch.setattr(text, "cut", lambda df: written.append(df.columns) or cut(df))
    monkeypatch.setattr(text, "word_counts", None)
    assert text.dictionary(documents(spark)).count() == 7 and not written


def test_large_bag_of_words_checkpoints_no_counts(spark, monkeypatch):
    """Rows in a checkpoint take ten times the room of columns."""
    want = sorted(map(tuple, text.bag_of_words(documents(spark)).where("doc_id is not null").collect()))
    assert (3, 5, 2) in want and (-2, 3, 2) in want
    written = []
    cut = text.cut
    monkeypatch.setattr(text, "cut", lambda df: written.append(df.columns) or cut(df))
    monkeypatch.setattr(text, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(text, "HEAVY_PLACES", 1)
    got = sorted(map(tuple, text.bag_of_words(documents(spark)).where("doc_id is not null").collect()))
    assert got == want and not any("doc_id" in c for c in written)
