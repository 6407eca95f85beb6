"""Queries of the operators, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dipwatch.llm import (
    centroids, decontamination, extraction, fingerprints, jaccard, language, lm, mixing, periodic, sharding, token_files, toxicity, urls,
)
from dipwatch.llm.frames import table
from dipwatch.llm.oracle import ORACLE  # noqa: F401
from dipwatch.session import prepare


def _over(*names: str):
    def bind(apply: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: apply(*[table(prepare(spark), sf_dir, n) for n in names])

    return bind


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minimax_shards": _over("documents")(sharding.op1_minimax_shards),
    "op2_mix_sources": _over("documents")(mixing.op2_mix_sources),
    "op3_main_text": _over("pages")(extraction.op3_main_text),
    "op4_toxicity": _over("documents", "labels")(toxicity.op4_toxicity),
    "op5_jaccard_join": _over("documents")(jaccard.op5_jaccard_join),
    "op6_fingerprints": _over("documents")(fingerprints.op6_fingerprints),
    "op7_url_filter": _over("pages", "labels")(urls.op7_url_filter),
    "op8_lm_scores": _over("documents")(lm.op8_lm_scores),
    "op9_language": _over("documents")(language.op9_language),
    "op10_contamination": _over("documents", "benchmark")(decontamination.op10_contamination),
    "op11_centroids": _over("embeddings")(centroids.op11_centroids),
    "op12_periodic_runs": _over("documents")(periodic.op12_periodic_runs),
    "op13_token_planes": _over("documents")(token_files.op13_token_planes),
}
