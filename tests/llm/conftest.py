import pytest

SCHEMA = "text string, doc_id bigint, source string, lang string, extra int, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, source) rows, with an extra column and another order of columns."""

    def build(rows):
        full = [(r[1], r[0], r[2] if len(r) > 2 else "s", "en", 1, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
