import pytest

from orderlens.llm.store import ship_package

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"

#: Columns that the operators use inside, of other types: they must neither clash nor matter.
CLASHING = ("row", "sig", "size", "score", "hash", "block", "n", "root", "held", "key", "y", "order", "unit", "own", "source_size")


@pytest.fixture(scope="session")
def spark(spark):  # noqa: F811  the library's session, with the package on its workers
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, source="s"):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        rows = [(r[0], r[1], r[2] if len(r) > 2 else source, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)
    return make


LONG = " ".join(f"w{i % 3000}x{i}" for i in range(30_000))

#: Nulls, empty texts, repeated rows, ties, odd spaces, a very long text and a very long word.
ODD_ROWS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (6, "One two"), (7, "one two three"), (8, "a b c d e f g h i j k l"),
            (8, "a b c d e f g h i j k l"), (9, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (None, None), (10, "   é É ñ"),
            (11, LONG), (12, "z" * 700_000), (13, "du " * 300), (14, LONG + " end")]
