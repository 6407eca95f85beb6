from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dipwatch.llm import lm, maxent as M
from dipwatch.llm.lm import op8_lm_scores
from tests.llm.data import SF, clashing, edge_docs, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows):
    tokens = [(i, WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n,
                    round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in tokens), key=repr)


def _got(rows):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), key=repr)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 1e-3, 2.0])
def test_counts_and_base_score(spark, monkeypatch, frequent):
    """Whether words are known to all tasks or looked up by part makes no difference."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op8_lm_scores(docs).collect()
    assert _got(rows) == _brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 500)
    docs = clashing(edge_docs(spark))
    assert _got(op8_lm_scores(docs).collect()) == _brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert op8_lm_scores(no_docs(spark)).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None, None)], docs.schema.jsonValue() and "doc_id long, text string, lang string, source string, n_chars long")
    assert op8_lm_scores(nothing).first()["n_tokens"] == 1


def test_held_out_texts_score_better_than_by_counts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    got = op8_lm_scores(docs).filter("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() * 0.98


def test_shares_of_words_and_classes_add_up_to_one():
    texts = [(" ".join(f"{'ab'[i % 2]}{j % 7}x" for j in range(i, i + 30))).encode() for i in range(50)]
    t = M.tokens_of(texts)
    classes = M.cluster(M.contexts(t))
    weights = np.zeros((1 << M.TABLE_BITS, M.CLASSES), np.float32)
    before = M.class_scores(weights, t, classes).sum()
    for _ in range(10):
        M.update(weights, np.zeros_like(weights), np.zeros(len(weights), bool), t, classes)
    assert np.allclose(np.exp(M.log_shares(weights, M.history(t, classes))).sum(1), 1, atol=1e-4)
    assert M.class_scores(weights, t, classes).sum() > before
    words, counts = np.unique(t.hashes, return_counts=True)
    own = classes[t.kinds[np.unique(t.hashes, return_index=True)[1]]]
    for k in range(M.CLASSES):
        n, v = counts[own == k].sum(), (own == k).sum()
        assert sum((c + 0.1) / (n + 0.1 * (v + 1)) for c in [*counts[own == k], 0]) == pytest.approx(1)


def test_history_stays_inside_a_text():
    t = M.tokens_of([b"a b c", b"", b"c b a"])
    assert t.first.tolist() == [0, 4, 5, 9] and t.place.tolist() == [0, 1, 2, 3, 0, 0, 1, 2, 3]
    rows = M.history(t, np.zeros(M.KINDS, np.int64))
    assert (rows[:, 0] == rows[:, 4]).all() and (rows[:, 0] == rows[:, 5]).all()


def test_the_table_grows_with_the_training_tokens(spark, monkeypatch):
    assert [M.table_bits(n) for n in (0, 1 << 20, 1 << 28, 1 << 30, 1 << 32)] == [16, 16, 16, 18, 20]
    t = M.tokens_of([" ".join(f"w{i}" for i in range(30_000)).encode()])
    classes = np.zeros(M.KINDS, np.int64)
    rows = [len(np.unique(M.history(t, classes, bits)[0])) for bits in (15, 16, 18)]
    assert rows[0] < rows[1] < rows[2]
    docs = spark.createDataFrame([(i, f"a{i % 50} b{i % 7} c") for i in range(400)], "doc_id long, text string")
    weights = lm.trained_weights(docs.repartition(3), classes, 3, 18)
    assert weights.shape == (1 << 18, M.CLASSES) and np.isfinite(weights).all() and weights.any()
