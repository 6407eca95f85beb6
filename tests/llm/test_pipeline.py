from __future__ import annotations

import importlib

import pytest

import corpus_pipeline as P
from dipwatch.llm import toxicity
from dipwatch.llm.oracle import ORACLE
from dipwatch.llm.queries import QUERIES
from tests.compare import connect, spark_rows, sql_rows
from tests.llm import data, test_decontamination as C, test_jaccard as J, test_mixing as M

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{data.SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data.SF}/{n}.parquet") for n in ("labels", "benchmark"))
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    toxic = {r["doc_id"] for r in toxicity.op4_toxicity(docs, labels).filter("predicted = 1").collect()}
    one = P.stage(P.toxicity(spark, docs, data.SF), "one")
    assert sorted(pairs(one)) == sorted(r for r in pairs(docs) if r[0] not in toxic)
    two = P.stage(P.jaccard(spark, one, data.SF), "two")
    keep = {d for d, _, c in J._brute(pairs(one), words=5, percent=80) if d == c}
    assert {d for d, _ in pairs(two)} == keep
    three = P.stage(P.decontaminate(spark, two, data.SF), "three")
    bad = {r[0] for r in C._brute(pairs(two), [tuple(r) for r in bench.select("item_id", "text").collect()]) if r[5]}
    assert sorted(pairs(three)) == sorted(r for r in pairs(two) if r[0] not in bad)
    four = P.stage(P.mix(spark, three, data.SF), "four")
    target = M._mix([tuple(r) for r in three.select("doc_id", "text", "source").collect()])[1]
    words = {}
    for r in four.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(M.WORD.findall(r["text"] or ""))
    most = max(len(M.WORD.findall(t or "")) for _, t in pairs(three))
    assert all(t - 1 <= words.get(s, 0) <= t + most for s, t in target.items())
    five = P.shard(spark, four, data.SF)
    assert sorted(pairs(five)) == sorted(pairs(four)) and five.select("shard", "slot").distinct().count() == four.count()
    for df in (one, two, three, four):
        assert df.columns == COLUMNS
    assert sorted(pairs(P.run(spark, data.SF))) == sorted(pairs(five))


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "jaccard", "decontaminate", "mix", "shard"]


def test_edges_through_every_stage(spark):
    for docs in (data.edge_docs(spark), data.no_docs(spark)):
        for name, apply in P.STAGES:
            docs = P.stage(apply(spark, docs, data.SF), name)
        assert {"doc_id", "text", "shard", "slot"} <= set(docs.columns)
    assert docs.count() == 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in entry.queries() if q.startswith("op")} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, "/root/testdata/sf0.01")) == sql_rows(connect("/root/testdata/sf0.01"), ORACLE[name])
