import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables from ``(doc_id, text)`` rows, with a source by turns and columns whose names clash."""

    def make(rows):
        full = [(i, t, "en", f"s{k % 3}", len(t or ""), 7, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, quality_score string")

    return make


EDGES = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f g h i j k l m n o p"), (4, "a b c d e f g h i j k l m n o p"), (5, "word " * 30_000), (None, "no id here"), (6, " \t\n ")]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(EDGES)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
