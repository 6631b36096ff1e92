import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from texts (doc_id: position) or (doc_id, text) pairs; one clashing extra column."""

    def make(texts, parts=3):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(rows, DOC_SCHEMA)
        from pyspark.sql import functions as F

        for clash in ("text_hash", "key", "bucket", "size", "count", "start", "root", "score", "f0", "node", "id", "_id", "_repeats", "_row", "row", "anchor", "place", "fingerprint", "d", "clear"):
            df = df.withColumn(clash, F.lit("x"))
        return df.repartition(parts)

    return make
