import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i}" for i in range(30_000))

# Null and empty texts, blanks only, one word, ties, repeated rows, a very long text, null ids.
EDGES = [(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, " \t\n "),
         (5, "word"), (6, "Word"), (7, "one two three four five six seven eight"),
         (7, "one two three four five six seven eight"), (7, "quite another text under one id"),
         (8, LONG), (9, LONG + " end"), (None, "no id at all here"), (None, None),
         (10, "é ß 日本 𠮷 ▁ <0x41>   ½"), (11, "a b c d"), (12, "a b c d e")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("row", "label", "key", "values", "range", "score", "component_id", "items", "n",
                 "leader", "node", "source", "quality", "kept_id", "own_id", "cuts", "before", "lang"):
        df = df.withColumn(name, F.lit(None).cast("string") if name == "lang" else F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
