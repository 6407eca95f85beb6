from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from dipwatch.llm.mixing import mixed, op2_mix_sources
from tests.llm.data import SF, clashing, edge_docs, no_docs, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else level * weight[s] for s in order}
        stopped |= over


def _mix(rows):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    target, out = _targets(sizes), []
    groups = defaultdict(list)
    for i, s, n in sized:
        groups[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, n, i))
    for s, members in groups.items():
        budget, before = math.floor(target[s]), 0
        epochs = budget // sizes[s] if sizes[s] else 0
        for _, _, _, n, i in sorted(members):
            out.append((i, n, sizes[s], round(target[s], 6), epochs * n + max(0, min(n, budget - epochs * sizes[s] - before))))
            before += n
    return sorted(out, key=repr), target


@pytest.mark.parametrize("name", ["edge", "given"])
def test_against_brute_force(spark, name):
    docs = clashing(edge_docs(spark)) if name == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    want, target = _mix(rows)
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in op2_mix_sources(docs).collect()]
    assert sorted(got, key=repr) == want
    assert all(r[4] <= 2 * r[1] for r in got)
    assert abs(sum(r[4] for r in got) - sum(map(math.floor, target.values()))) == 0


def test_copies_follow_the_budget(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    target, size = _mix(rows)[1], {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    out = mixed(docs)
    assert out.columns == docs.columns
    taken, copies = Counter(), Counter()
    for r in out.collect():
        copies[r["doc_id"]] += 1
        taken[r["source"]] += size[r["doc_id"]]
    assert max(copies.values()) <= 2
    for s, t in target.items():
        assert t - 1 <= taken[s] <= t + max(n for i, n in size.items() if source[i] == s)


def test_edges_of_copies(spark):
    docs = clashing(edge_docs(spark))
    assert mixed(docs).columns == docs.columns
    assert mixed(docs).filter("doc_id = 3").count() <= 2
    assert op2_mix_sources(no_docs(spark)).count() == 0 and mixed(no_docs(spark)).count() == 0
    assert rows_of(mixed(docs)) == rows_of(mixed(docs.repartition(2)))
