import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names clash with those that operators make themselves.
CLASHING = ("score", "key", "block", "row", "length", "task", "nth", "shard", "lane", "bucket", "own", "names", "text_key", "hash", "y", "k", "at")


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}{'abcdefgh'[rng.randrange(8)] * rng.randrange(1, 5)}" for _ in range(n))


def rows():
    """Hard rows: nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared passages, odd characters."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (1, 3, 5, 60, 120, 300)]
    long = words(rng, 9000, 5000)
    passage = "this very passage stands in several documents and is longer than fifty bytes by far"
    near = base[5].split()
    near[40], near[200] = "changed", "words"
    out = [(None, base[3], "en", 1), (1, None, "en", 0), (2, "", "de", 0), (3, " \n\t ", None, 3), (4, base[0], "en", 1), (5, base[1], "en", 1), (6, base[2], "en", 1)]
    out += [(7, base[3], "en", 1), (8, base[3], "fr", 1), (8, base[3], "fr", 1), (9, base[4], "en", 1), (10, base[5], "en", 1), (11, " ".join(near), "en", 1), (12, long, "en", 1)]
    out += [(13, f"{base[4]} {passage} end", "en", 1), (14, f"start {passage} {base[3]}", "en", 1), (-5, f"{passage}\né ß 日本語 👍🏽 <|endoftext|> don't\x00 {words(rng, 60)}", "en", 1), (15, "same " * 400, "en", 1), (16, words(rng, 3000, 4000) + " " + long[:20000], "en", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
