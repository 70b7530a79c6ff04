import pytest

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.StringType()),  # clashes with names the operators use
        T.StructField("n", T.IntegerType()),
    ]
)


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of documents from (doc_id, text), with extra columns."""
    return lambda rows: spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd(frame):
    """Null ids and texts, empty and long texts, copies, repeated rows."""
    long = " ".join(f"word{i % 997} tail{i % 13}." for i in range(20_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, " \n\t"), (None, "a b c d"), (None, None), (5, long),
            (6, long), (7, "é 漢字 🙂 x"), (-3, "A B C D")]
    return rows, frame(rows)
