import pytest

DOC = "doc_id bigint, text string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as ``documents`` with nulls, empty texts, ties, repeated rows and clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", "src", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size int")

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
