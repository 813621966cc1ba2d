import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, taken long, kept string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]); further columns clash with names the operators use."""

    def make(rows, parts=3):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], None, "s", "r", 7, "k") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make
