import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) with clashing extra columns."""
    def make(rows):
        full = [(*r, *(None, "s")[len(r) - 2:], len(r[1] or "")) if len(r) < 4 else (*r, len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        extra = ("class", "n", "text_key", "row", "part", "component", "id", "score", "taken")
        return df.withColumns({c: F.lit("x") for c in extra})
    return make
