from __future__ import annotations

import zlib
from collections import defaultdict

import pytest
import xxhash

from dipwatch.llm.sharding import SLOT_BITS, op1_minimax_shards, shards
from tests.llm.data import SF, clashing, edge_docs, no_docs, rows_of


def _least_capacity(sizes, count):
    def fits(cap):
        used, load = 1, 0
        for s in sizes:
            if load + s > cap:
                used, load = used + 1, 0
            load += s
        return used <= count

    low, high = max(max(sizes), -(-sum(sizes) // count)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def _check(docs, out, count):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    atoms = defaultdict(int)
    for _, text in texts:
        h = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
        atoms[h >> (64 - SLOT_BITS)] += 8 + len((text or "").encode())
    loads, slots = defaultdict(int), defaultdict(list)
    for r in out:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(out) == len(texts) and set(loads) <= set(range(count))
    assert max(loads.values()) == _least_capacity([atoms[a] for a in sorted(atoms)], count)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    crc = [(i, 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t in texts]
    assert sorted(map(repr, crc)) == sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in out)
    by_text = defaultdict(set)
    for r in out:
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("count", [1, 3, 24])
def test_minimax_over_edge_rows(spark, count):
    docs = clashing(edge_docs(spark))
    _check(docs, shards(docs, count).collect(), count)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op1_minimax_shards(docs).collect()
    _check(docs, out, 24)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    assert len({r["shard"] for r in out}) == 24


def test_hot_group_leaves_no_shard_idle(spark):
    rows = [(i, "copy " * 100, "en", "a", 1) for i in range(300)] + [(1000 + i, f"text {i} " * 40, "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = shards(docs, 8).collect()
    _check(docs, out, 8)
    assert len({r["shard"] for r in out}) == 8


def test_empty_and_repeatable(spark):
    assert op1_minimax_shards(no_docs(spark)).count() == 0
    docs = edge_docs(spark)
    assert rows_of(shards(docs, 5).select("doc_id", "shard", "slot")) == rows_of(shards(docs.repartition(2), 5).select("doc_id", "shard", "slot"))
