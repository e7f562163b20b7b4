import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Rows of (id, text, lang, source) as a documents table; more columns with clashing names by ``extra``."""

    def make(rows, extra=False):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows], DOCUMENTS)
        if extra:
            for name in ("score", "row", "n", "key", "offset", "word", "block", "comp", "position", "host", "size", "doc", "lines"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t\n ", "en", "s"), (4, "word", "en", None), (5, "a b c d e f g h i j", "en", "t"), (5, "a b c d e f g h i j", "en", "t"),
    (None, "no id here at all my friend", "en", "s"), (7, "long text of words " * 20000, "en", "s"), (8, "日本語 の テキスト 😀 é", None, "s"), (9, "x" * 50000, "en", "s"), (10, "nul \x00 byte", "en", "s"),
]
