import pytest
DATA = "/root/testdata"

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Nulls in every column, empty, blank and long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None), (None, "a null id with some words in it", "en", "s1", 31), (3, "", "en", "s1", 0), (4, " \t\n\x0b\x0c\r ", None, "s2", 7), (5, "one", "en", None, 3),
    (6, "The same text twice over, here it is in full length.", "en", "s1", 52), (7, "The same text twice over, here it is in full length.", "en", "s2", 52), (7, "The same text twice over, here it is in full length.", "en", "s2", 52),
    (8, "word " * 40_000, "en", "s1", 200_000), (9, "".join(chr(97 + i * i % 26) for i in range(60_000)), "en", "s1", 60_000), (10, "ÄÖÜ ß € 😀 \x00 end of", "de", "s3", 20),
    (11, "\n".join(f"line {i % 7} of many lines that come again" for i in range(900)), "en", "s3", 9), (12, "MIT License mit license MIT-license, cc BY; Apache  License", "en", "s3", 1), (-5, "x" * 199, "en", "s3", 199), (2**40, "x" * 201, "en", "s3", 201),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["id", "key", "size", "n", "target", "failed", "block", "bin", "class_id", "vec", "_gone", "w", "l", "score", "n_words", "piece", "shard", "cluster", "y", "r", "_doc", "s1", "root", "_copy", "_n", "_id"]
    return df.select("*", *[F.lit(7).alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("doc_id = 12345")


def rows(df):
    return [tuple(r) for r in df.collect()]
