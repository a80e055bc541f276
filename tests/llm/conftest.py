import pytest

DOCS = "doc_id long, text string, source string"


@pytest.fixture
def documents(spark):
    """A small table with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    rows = [
        (1, base, "a"), (2, base.upper(), "a"), (3, near, "b"), (4, None, "b"), (5, "", None), (6, " \n\t ", "c"),
        (7, "two words", "c"), (8, "TWO words", "a"), (9, "x " * 3000, "d"), (10, "one two three four five", None),
        (11, "ünï códe " * 400, "e"), (12, base + "\n" + base, "e"), (None, "no id here", "a"), (13, base, "a"), (13, base, "a"),
    ]
    table = spark.createDataFrame(rows, DOCS)
    clashes = ("rid", "row", "kept", "score", "t", "key", "n", "size", "copies", "stats", "name", "blob", "_key", "root")
    for name in clashes:
        table = table.selectExpr("*", f"'mine' AS {name}")
    return table


@pytest.fixture
def stable(spark, documents, tmp_path):
    """The same rows as a table on disk, whose scan is stable."""
    path = str(tmp_path / "documents.parquet")
    documents.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def nothing(documents):
    return documents.limit(0)
