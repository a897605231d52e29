import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    def make(rows):
        """Rows are (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


def prose(k, n=60):
    """``n`` words that hardly repeat, others for each ``k``."""
    return " ".join(f"w{(i * 7919 + k * 104729) % 999983}" for i in range(n)) + "."
