import pytest


@pytest.fixture
def docs(spark):
    """docs(text, ...) or docs((id, text), ...) as documents with columns whose names clash."""
    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            [(i, t, None, "ids", 7, "spans", "score") for i, t in rows],
            "doc_id long, text string, lang string, ids string, n_chars long, spans string, label string")

    return make

