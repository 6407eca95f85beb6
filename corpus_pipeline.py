"""From raw documents to shards of a training mix, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame, works on all rows that the one before it kept, and is written and reread before
the next. All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go; labels join by id and only train it.
2. jaccard: of each group of documents linked by shingles of five words (Jaccard of at least 0.8), the one of the least id stays.
3. decontaminate: documents that hold a passage of a benchmark item go (``drop_over=0``: no share of hit words is tolerated).
4. mix: rows are repeated or left out until each source has its budget of words, in whole documents.
5. shard: equal texts together, shards of near equal bytes; adds shard and slot.

Empty input gives empty output with the same columns. SQL cannot express the trained classifier, so there is no SQL for the whole;
the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dipwatch.llm.decontamination import decontaminated
from dipwatch.llm.frames import table
from dipwatch.llm.jaccard import one_of_each
from dipwatch.llm.mixing import mixed
from dipwatch.llm.sharding import shards
from dipwatch.llm.toxicity import without_toxic
from dipwatch.session import prepare, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), drop_over=0.0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards(docs, keep=("text", "lang", "source", "n_chars"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("jaccard", jaccard), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
