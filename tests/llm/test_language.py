from __future__ import annotations

import zlib

import numpy as np
import pytest

from dipwatch.llm import language as L
from tests.llm.data import SCHEMA, clashing, edge_docs, no_docs, rows_of


def test_gradient_by_finite_differences():
    net = L.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, of = L.windows([b"hello world", "é test".encode()], 12)
    y = np.array([0, 1])
    grads = net.gradient(x, y)

    def loss():
        z = net.logits(x).astype(float)
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        weight = L._LETTER[x]
        return -(z[:, np.arange(2), y] * weight).sum() / weight.sum()

    for k, value in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(grads[k])), value.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = loss()
        value[at] = old - 1e-2
        down = loss()
        value[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[k][at], rel=0.02, abs=1e-5)


def test_windows_cover_whole_texts():
    texts = [b"abc", b"", None, b"x" * 200, "é".encode() * 40]
    x, of = L.windows(texts)
    back = {i: x.T[of == i].tobytes().rstrip(b"\0") for i in range(len(texts))}
    assert [back.get(i, b"") for i in range(len(texts))] == [t or b"" for t in texts]


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op9_language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    test = got[got["held_out"]]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.95
    assert set(got["lang_pred"]) <= set(got["lang"])


def test_edges(spark):
    docs = clashing(edge_docs(spark))
    got = {(r["doc_id"], r["lang_pred"]) for r in L.op9_language(docs).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (None, "und")} <= got and ((7, "und") not in got)
    digits = spark.createDataFrame([(1, "12 34 !?", "en", "a", 1), (2, "abc", None, "a", 1), (3, "ÄÖ", "de", "a", 1)], SCHEMA)
    found = {r["doc_id"]: r["lang_pred"] for r in L.op9_language(digits).collect()}
    assert found[1] == "und" and found[2] in ("de", "en") and found[3] in ("de", "en")
    unlabelled = spark.createDataFrame([(1, "abc", None, "a", 1)], SCHEMA)
    assert [tuple(r) for r in L.op9_language(unlabelled).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    assert L.op9_language(no_docs(spark)).count() == 0
    assert rows_of(L.op9_language(digits)) == rows_of(L.op9_language(digits))
