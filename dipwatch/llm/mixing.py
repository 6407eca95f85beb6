"""Mixing sources to target weights by exact budgets over hash-random order (DataFrame functions only).

Sources by code point (null last) weigh 5, 2, 1, repeating. All budgets together are ``SHARE`` times all sizes; a source's budget
stops at ``EPOCHS`` times its size and the excess goes to the others by weight. Within a source, documents stand in the order of
a hash of their id; whole epochs are taken first, then the head of that order up to the exact rest of the budget, where the
document that crosses the cut is taken in part.

Defined results: null text has size 0; a source without words has budget 0; ties of the hash key (repeated ids) are broken by id
and size, so repeated rows get the same set of results on every run; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dipwatch.llm.frames import range_summed
from dipwatch.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def budgets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target; the windows run over one row a source.

    With caps c = 2s and weights w, budgets are min(c, level * w). Sources in the order of c / w reach their cap first; the level is
    the first one at which the sources that are left stay under theirs.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (number % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(EPOCHS)))
    ordered = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "full": F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(SHARE),
    })
    level = (F.col("all") - F.col("full")) / F.col("left")
    rows = rows.withColumn("at", F.when(level * F.col("w") <= F.col("cap"), level))
    final = F.min_by("at", F.when(F.col("at").isNotNull(), F.col("full"))).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(final * F.col("w"), F.col("cap")))).select(
        "source", "source_size", "target")


def drawn(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, before (words of the source that come earlier in the order), source_size, target; extra columns of
    ``docs`` beyond the id, the source and ``size`` are not carried."""
    # Hex digits order alike everywhere; a hot source is spread over ranges of this key.
    rows = stage(docs.select("doc_id", "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key")), "mix")
    sizes = budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sizes = sizes.withColumnRenamed("source", "_source")
    ranged = range_summed(rows, "source", ["_key", "doc_id", "size"], "size", "before")
    return ranged.join(sizes, ranged["source"].eqNullSafe(sizes["_source"])).drop("_source", "_key")


def taken_words() -> Column:
    """Whole epochs of the document, then its part of the last one."""
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (epochs * F.col("size") + part).cast("long")


def op2_mix_sources(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return drawn(sized).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken_words().alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix has them: a row once for each epoch in which its first word is inside the budget.

    Rows that agree in every column are one entry whose size is theirs together, and share its result. A document without words
    carries no weight and stays, once, if its source has a budget.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("*").alias("of"), word_count(F.col("text")).alias("size"))
    entries = rows.groupBy(F.struct("doc_id", "of").alias("doc_id"), "source").agg(F.sum("size").alias("size"))
    ordered = drawn(entries)
    budget, size = F.floor(F.col("target")), F.col("source_size")
    epochs = F.when(size > 0, F.floor(budget / size)).otherwise(F.lit(0))
    begins = F.col("before") < budget - epochs * size
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(epochs + F.when(begins, F.lit(1)).otherwise(F.lit(0))).cast("int")
    picks = ordered.filter(F.col("target") > 0).select(F.col("doc_id").alias("id"), copies.alias("copies")).filter("copies > 0")
    joined = rows.join(picks, (rows["of"] == picks["id.of"]) & rows["doc_id"].eqNullSafe(picks["id.doc_id"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
