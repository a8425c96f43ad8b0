import pytest

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Build a table of documents from (doc_id, text, source) rows, with columns of clashing names."""

    def build(rows):
        rows = [(i, t, "en", s, None if t is None else len(t), "x", 7, "y") for i, t, s in rows]
        return spark.createDataFrame(rows, EMPTY + ", row string, key int, ids string")

    return build


@pytest.fixture
def awkward(documents):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    same = "one two three four five six seven eight nine ten " * 6
    return documents([
        (None, None, None), (None, "no id here at all", "a"), (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, long, "c"),
        (5, same, "a"), (5, same, "a"), (6, same, "b"), (7, same + "eleven", "b"), (5, "another text under the same id", "a"),
        (8, "short", "c"), (9, "short", "c"),
    ])
