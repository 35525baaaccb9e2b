import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """make(rows) -> documents; a row is (doc_id, text[, lang[, source]])."""

    def build(rows, parts=3):
        full = [tuple(r) + (None,) * (4 - len(r)) + (len(r[1] or ""),) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return build
