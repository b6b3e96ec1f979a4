import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with an extra column of a clashing name, from (doc_id, text[, source[, lang]])."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
