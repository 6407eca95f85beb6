"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHING = ("size", "shard", "slot", "node", "tile", "n", "label", "part", "k", "r", "after", "words", "before", "target", "host", "_h")


def edge_rows() -> list[tuple]:
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(draw.choice(words) for _ in range(40_000))
    base = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n ", "en", None, 3), (3, long, "de", "a", len(long)),
            (4, "one", None, "b", 3), (5, "one", "en", "b", 3), (6, "One  two", "en", "b", 8), (7, "é ñ ß", "fr", None, 5)]
    for i, text in enumerate(base):
        rows.append((10 + i, text, "en", "abc"[i % 3], len(text)))
    for i in range(40):
        text = base[i % 4].split()
        text[draw.randrange(60)] = draw.choice(words)
        rows.append((100 + i, " ".join(text), "es", "a", 1))
    rows += [(200 + i, base[0], "en", "a", 1) for i in range(15)]
    rows += [(300, "same row", "en", "c", 8)] * 3 + [(None, "no id at all", "en", "c", 12), (None, None, None, None, None)]
    rows += [(301, "one id", "en", "c", 6), (301, "two texts", "en", "c", 9)]
    return rows


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)


def clashing(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows_of(df: DataFrame) -> list[tuple]:
    """Rows in an order of their own, nulls apart from texts."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
