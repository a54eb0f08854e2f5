import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) with columns whose names clash with what operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, b"d") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, block binary")

    return make
