import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """(id, text[, source]) rows as a documents table; ``extra`` adds columns
    whose names the operators use inside."""
    def make(rows, extra=False):
        full = [(i, t, "en", (r[0] if r else "s"), None if t is None else len(t)) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("score", "node", "row", "n", "spans", "items", "n_words", "host", "size", "hash", "part"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make
