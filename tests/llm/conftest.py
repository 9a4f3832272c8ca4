import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def words(seed, n, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long text, copies, repeated rows and ids."""
    rows = [(i, words(i, 60), "en", f"s{i % 3}", 300) for i in range(12)]
    rows += [
        (20, None, "en", "s0", None), (21, "", None, None, 0), (22, " \t\n ", "de", "s1", 4), (None, "text without an id", "en", "s0", 18),
        (23, words(1, 60), None, "s1", 300), (23, words(1, 60), None, "s1", 300), (24, words(99, 40_000), "en", "s2", 200_000),
        (25, "one two three", "fr", "\U0001f600", 13), (26, "ONE two three", "fr", None, 13), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_dir(spark, edge_rows, tmp_path_factory):
    """A folder of tables with all edge cases, and further columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("edges"))
    clash = {c: F.lit("x") for c in ("id", "n", "size", "shard", "copies", "secrets", "words", "p", "a", "b", "rank", "label", "__text", "__id", "__no", "__s", "__secrets", "__toxicity", "host", "rule")}
    spark.createDataFrame(edge_rows, DOCUMENTS).withColumns(clash).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 1), (99, 0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "http://a.example.de/x", f'<html lang="en"><p>{words(5, 50)}</p></html>'), (2, None, None), (None, "no address", ""), (3, "ftp://[::1", words(6, 20_000)),
             (1, "http://a.example.de/x", "<p>text"), (4, "https://user@B.example.DE./y", "<html lang=xx-YY><body>one</body>")]
    spark.createDataFrame(pages, PAGES).withColumns({"host": F.lit(1), "text": F.lit("x"), "p": F.lit(0)}).write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [0.01 * ((i * 7) % 11), -0.5, 0.25], 0) for i in range(40)]
    vectors += [(50, [0.1, 0.2, 0.3], 1), (50, [0.1, 0.2, 0.3], 1), (100, None, 1), (150, [1.0, None, 0.0], 1), (200, [float("nan"), 0.0, 0.0], 1),
                (250, [float("inf"), 0.0, 0.0], 1), (300, [], 1), (350, [2.0], 1), (None, [1.0, 1.0, 1.0], 1), (61, [0.1, 0.2, 0.3], 1)]
    spark.createDataFrame(vectors, VECTORS).withColumns({"id": F.lit(1), "v": F.lit(2), "cell": F.lit(3)}).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCUMENTS), ("labels", LABELS), ("pages", PAGES), ("embeddings", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder
