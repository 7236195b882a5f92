import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, special strings, and columns whose names clash with operators' own."""
    long = " ".join(f"word{i % 977} and, then" for i in range(20_000))
    rows = [(1, "Plain text, of seven short words here."), (2, None), (3, ""), (None, "no id at all"), (5, long), (6, "twice"), (6, "twice"), (7, "a <|endoftext|> b  c\n\n d "), (8, "\n"), (9, "日本語 テキスト 😀 naïve café"), (10, "x" * 30_000)]
    base = spark.createDataFrame(rows, DOCS).coalesce(2)
    return base.selectExpr("doc_id", "text", "7 as score", "'z' as frame", "1 as n_tokens", "doc_id as part", "'k' as key", "2 as class", "3 as root", "'e' as ids")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
