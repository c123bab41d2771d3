import pytest

LONG = "the of " * 9000 + "end"
DOCS = [
    (1, "To be or not to be, that is the question of the day."), (2, "to be OR not to be, that is the question of the day."), (3, None), (4, ""), (5, " \t\n"), (6, "one two"),
    (7, "one two"), (8, LONG), (9, LONG + " x"), (10, "Größe ÀÉ 漢字 🙂 <s>[INST] \\ </s>"), (None, "no id here at all"), (1, "To be or not to be, that is the question of the day."),
    (11, "12345 !!! ..."),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="session")
def wide(docs):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(7) for c in ("n", "node", "pair", "score", "chunk", "word", "media", "hits", "h", "labels", "train", "held_out", "predicted", "rejected", "kept")}
    return docs.withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
