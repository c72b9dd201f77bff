"""Small tables for the corpus tests."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{int(r.random() ** 2 * vocabulary)}" for _ in range(n))


def documents(spark, data):
    """A documents table with columns whose names the operators use inside."""
    clash = {c: F.lit(i) for i, c in enumerate(["key", "_key", "size", "rank", "n", "class", "bands", "component", "n_lines", "_runs", "_m", "kept"])}
    return spark.createDataFrame(data, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumns(clash)


def empty(spark):
    return documents(spark, [])


def edge_rows():
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", "a"), (5, "two words", "de", "b"),
        (None, "no id here", "en", None), (None, None, None, None), (6, "É ß ñ   x", "fr", "b"),
        (7, prose(300, 1), "en", "a"), (7, prose(300, 1), "en", "a"), (8, prose(30_000, 2, 20_000), "en", "b"), (9, "x" * 100_000, "en", "b"),
    ]


def rows(df, *columns):
    """The rows in order of the first column, as tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[0] is not None, r[0]))
