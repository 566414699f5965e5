"""Small tables with the cases every operator must handle."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_docs(spark, extra: bool = True):
    """Nulls in every column, empty, blank, tiny and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    rows = [
        (1, words(rng, 80), "en", "a", 1), (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, " \n\t", None, "b", 3), (5, "x", "fr", None, 1), (6, long, "en", "a", len(long)),
        (None, words(rng, 30), "en", "a", 5), (None, None, None, None, None), (7, words(rng, 40), "de", "b", 7), (8, "ü" * 300, "de", "b", 300), (9, "w" * 50_000, "en", "c", 9),
    ]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("node", "sig", "n", "p", "w", "k", "a", "b", "m", "group_id", "topic", "n_tokens", "length", "rank", "digest", "_clean", "toxic", "count", "members", "start", "part", "salt", "_gone", "_again", "_topic", "_s", "_l", "_t", "_p", "_n"):
            df = df.withColumn(name, F.lit("extra"))
    return df


def none(spark):
    return spark.createDataFrame([], DOCS)
