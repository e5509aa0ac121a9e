import tempfile

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of (doc_id, text) rows with extra columns of clashing names."""
    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows]
        kind = "doc_id long, text string, lang string, source string, n_chars long, node string, `a.b` string"
        return spark.createDataFrame(full, kind).repartition(parts)
    return make
