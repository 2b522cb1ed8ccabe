import pytest
from pyspark.sql import types as T


@pytest.fixture()
def docs(spark):
    """Builds a documents table; a further column clashes with names used inside."""

    def build(rows):
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField("text", T.StringType()),
                T.StructField("lang", T.StringType()),
                T.StructField("source", T.StringType()),
                T.StructField("n_chars", T.LongType()),
                T.StructField("start", T.StringType()),
                T.StructField("tokens", T.StringType()),
                T.StructField("component_id", T.StringType()),
            ]
        )
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, schema)

    return build


#: Nulls in any column, empty and odd texts, repeated rows, ties.
ODD = [
    (1, "the cat sat on the mat"),
    (2, None),
    (None, "the cat sat on the mat"),
    (3, ""),
    (4, "  a  b \n\n c\t"),
    (5, "日本語 テスト  😀 don't  we'll"),
    (5, "日本語 テスト  😀 don't  we'll"),
    (6, "x " * 5000),
    (7, "y" * 3000),
    (8, "the cat sat on the mat", None),
]
