import pytest

# id, text, lang, source plus columns whose names clash with operators' own
EDGE = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \t\n", "en", "b"), (4, "12 34", "de", "b"),
    (5, "the cat sat on the mat", "en", "a"), (6, "the cat sat on the mat", "en", "a"),
    (6, "the cat sat on the mat", "en", "a"), (7, "the cat sat on the hat", "en", None),
    (8, "漢字 🙂 é" * 3, "de", "ü"), (9, "word " * 60_000, "en", "a"), (None, "no id here", "en", "c"),
    (10, "x" * 20_000, "de", "b"), (11, "<|endoftext|> <s> it's  ", "de", "b"),
]
CLASH = ["ids", "score", "_id", "_h", "n", "size", "shard", "language", "_code", "a", "b"]


def frame(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).where("false")


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
