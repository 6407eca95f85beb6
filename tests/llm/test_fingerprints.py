from __future__ import annotations

import hashlib
import re

import numpy as np

from dipwatch.llm import fingerprints as P
from tests.llm.data import SF, clashing, edge_docs, no_docs


def _set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _likeness(a, b):
    return len(a & b) / len(a | b) if a and b else float(len(a) == len(b))


def _brute(rows):
    order = sorted(((d is not None, d or 0, (t or "").encode(), d, t or "") for d, t in rows))
    out = []
    for i, (_, _, _, doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][4]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), _likeness(_set(text), _set(edited)), _likeness(_set(text), _set(after)), text))
    return out


def _compare(docs):
    rows = P.op6_fingerprints(docs).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr)
    want = _brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got == sorted((w[:3] for w in want), key=repr)
    return rows, {w[:3]: w for w in want}


def test_given_documents(spark):
    rows, want = _compare(spark.read.parquet(f"{SF}/documents.parquet"))
    far = [abs(r["near_edited"] - want[r["doc_id"], r["n_chars"], r["edited_sha256"]][3]) for r in rows]
    assert np.mean(far) < 0.03 and max(far) < 0.2
    assert max(abs(r["near_next"] - want[r["doc_id"], r["n_chars"], r["edited_sha256"]][4]) for r in rows) < 0.2
    prints = {}
    for r in rows:
        assert prints.setdefault(want[r["doc_id"], r["n_chars"], r["edited_sha256"]][5], r["fingerprint"]) == r["fingerprint"]


def test_edges(spark):
    docs = clashing(edge_docs(spark))
    rows, _ = _compare(docs)
    assert all(0 <= r["near_edited"] <= 1 for r in rows)
    assert P.op6_fingerprints(no_docs(spark)).count() == 0
    one = docs.filter("doc_id = 7")
    assert P.op6_fingerprints(one).first()["near_next"] == 1.0


def test_many_ranges(spark):
    rows = [(i * 7919 % 1009, f"text of number {i} " * (i % 9)) for i in range(1009)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        _compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(11))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sketches_merge_and_estimate():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]).encode(), " ".join(words[1000:]).encode()
    x, y = P.sketches([a, b])
    whole = P.sketches([" ".join(words).encode()])[0]
    assert (P.merge(x, y) == whole).mean() > 0.98
    assert abs(P.resemblance(x, y) - 1 / 3) < 0.12 and abs(P.containment(x, y) - 0.5) < 0.17 and abs(P.distinct(whole) - 2996) < 700
    assert (P.decode(P.encode(x)) == x).all() and P.distinct(P.sketches([b"a b c d e f"])[0]) == 2
