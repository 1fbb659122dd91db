import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows: (doc_id, text)."""
        return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """Documents with columns that operators might use for themselves."""

    def make(rows):
        df = docs(rows)
        for name in ("_id", "_digest", "n", "d1", "gram", "doc", "label", "_label", "words", "_places", "score", "length", "piece", "media", "kept", "_row", "_key", "block", "row", "id", "hits", "component_id", "_text", "terms"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
