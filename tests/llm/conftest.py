import pytest
from pyspark.sql import types as T

#: Names that the operators use inside; a table may have columns of these names.
CLASHING = ["n", "sig", "bucket", "b", "tokens", "key", "rep", "values", "copies", "id", "component", "place", "end", "epochs", "domain", "meta_0", "chunk", "words", "own", "a", "doc"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
PROSE = "the old house on the hill was empty and nobody in the village knew who had lived there before the long war came to an end"


def prose(seed, n=60):
    """n words that differ with the seed."""
    base = PROSE.split()
    return " ".join(base[(i * 7 + seed) % len(base)] + (str((i * seed) % 97) if i % 3 == 0 else "") for i in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from texts, or from (doc_id, text) rows, with columns of clashing names."""

    def table(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else f"src{(i or 0) % 5}", None if i == 2 else len(t or "")) + ("x",) * len(CLASHING) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return table


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(prose(s, 400) for s in range(60))
    rows = [(0, prose(1)), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, prose(1)), (6, prose(1)), (7, long_text), (8, long_text + " end"), (None, prose(5)), (None, None), (9, "é漢字 \x00 İ 😀"), (10, prose(9) * 12)]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([(0, "x")]).where("doc_id > 5")
