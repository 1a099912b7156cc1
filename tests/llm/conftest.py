import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make(spark):
    """documents of (doc_id, text) pairs, as they come."""

    def run(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None) for i, t in rows], DOCUMENTS)

    return run


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
