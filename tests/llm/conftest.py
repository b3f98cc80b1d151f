import pytest

LONG = " ".join(f"word{i % 97} token{i % 89}" for i in range(20_000))

#: Ids and texts with nulls, empty, very long, repeated and tied rows, and columns with names that operators use.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa\nThe same line here"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa\nthe SAME line here  "),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, LONG + " tail"),
    (7, "short"),
    (7, "short"),
    (None, "The same line here"),
    (None, None),
    (8, "line one is long enough\n\n  line one is long enough \nother"),
    (9, "ünïcode é 日本 line is long enough\nline one is long enough"),
    (10, "   \t\r\n \x0b "),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in ("row", "k", "g", "h1", "n_lines", "score", "edits", "lost", "id", "_t"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
