from __future__ import annotations

import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipwatch.llm import toxicity as T
from dipwatch.llm.words import ALPHANUMERIC, words_of
from tests.llm.data import clashing, edge_docs, no_docs, rows_of

LABELS = "doc_id long, quality int, toxic int"


def _made(n=600):
    draw = np.random.Generator(np.random.PCG64(1))
    texts, toxic = [], []
    for i in range(n):
        lines = [" ".join(f"w{int(x)}" for x in draw.integers(0, 300, 8)) for _ in range(int(draw.integers(1, 12)))]
        if i % 3 == 0:
            at = int(draw.integers(len(lines)))
            lines[at] = lines[at] + f" vile{'abc'[i % 3]}"
        texts.append(". ".join(lines).encode())
        toxic.append(float(i % 3 == 0))
    return texts, np.array(toxic)


def test_gradient_is_that_of_the_noisy_or():
    texts, toxic = _made(90)
    model = T.fit(texts, toxic)
    w = words_of(texts, ALPHANUMERIC)
    first, of, z = model.logits(w)
    brute = [1 - np.prod([1 - 1 / (1 + np.exp(-v)) for v in z[of == i]]) for i in range(len(texts))]
    assert np.allclose(model.scores(w), brute)


def test_sentence_that_offends_is_found(spark):
    texts, toxic = _made()
    model = T.fit(texts, toxic)
    text = "A quiet start. Then something vilea was said! And w1 w2 w3 after. "
    docs = spark.createDataFrame([(1, text), (2, "w1 w2. w3 w4.")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in T.scored(docs, model).collect()}
    assert found[1]["score"] > 0.9 > 0.1 > found[2]["score"] and not found[2]["sentences"]
    (s,) = found[1]["sentences"]
    assert text.encode()[s["a"]:s["b"]] == b"Then something vilea was said"


def test_repeats_of_a_sentence_word_count_once():
    model = T.fit(*_made())
    one, many = (model.scores(words_of([t], ALPHANUMERIC))[0] for t in (b"w1 w2", b"w1 w1 w1 w2 w2 w1"))
    assert one == pytest.approx(many)


def test_held_out_accuracy_and_contract(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = T.op4_toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    test = got[got["held_out"]].merge(labels.select("doc_id", "toxic").toPandas(), on="doc_id")
    hit = ((test["predicted"] == 1) & (test["toxic"] == 1)).sum()
    assert hit / test["toxic"].sum() > 0.85 and hit / test["predicted"].sum() > 0.9


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(T.op4_toxicity(docs, labels)) == rows_of(T.op4_toxicity(docs, flipped))


def test_edges(spark):
    docs, none = clashing(edge_docs(spark)), spark.createDataFrame([], LABELS)
    got = T.op4_toxicity(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.0}
    odd = spark.createDataFrame([(10, 1, None), (None, 1, 1), (11, 1, 1), (11, 0, 0), (12, 1, 0), (100, 1, 0), (101, 0, 0)], LABELS)
    got = T.op4_toxicity(docs, odd).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2))
    assert T.op4_toxicity(no_docs(spark), odd).count() == 0
    assert rows_of(T.without_toxic(docs, none)) == rows_of(docs)
    assert T.without_toxic(no_docs(spark), odd).columns == no_docs(spark).columns


def test_rejected_documents_go(spark):
    texts, toxic = _made(400)
    docs = spark.createDataFrame([(i, t.decode(), "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], LABELS)
    bad = {r["doc_id"] for r in T.op4_toxicity(docs, labels).filter("predicted = 1").collect()}
    kept = {r["doc_id"] for r in T.without_toxic(docs, labels).collect()}
    assert kept == set(range(400)) - bad and len(bad) > 100


def test_each_row_goes_by_its_own_text(spark):
    texts, toxic = _made(400)
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], LABELS)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t.decode(), "en", "a", 1) for i, t in enumerate(texts)]
    bad = {r["doc_id"] for r in T.op4_toxicity(spark.createDataFrame(rows, schema), labels).filter("predicted = 1").collect()}
    ill, well = next(rows[i][1] for i in sorted(bad)), next(rows[i][1] for i in range(400) if i not in bad)
    odd = [(5000, ill, "en", "a", 1), (5000, well, "en", "a", 1), (None, ill, "en", "a", 1), (None, well, "en", "a", 1), (None, None, None, None, None)]
    kept = T.without_toxic(clashing(spark.createDataFrame(rows + odd, schema)), labels)
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert got == {r[:2] for r in rows + odd if r[1] not in {rows[i][1] for i in bad}}


def _held() -> float:
    """MB of this process's own memory."""
    found = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    return sum(map(int, found)) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's account of memory")
def test_the_driver_keeps_nothing_of_the_fit(spark):
    draw = F.sequence(F.lit(1), F.lit(400))
    text = F.concat_ws(" ", F.transform(draw, lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(5000)).cast("string"))))
    toxic = F.when(F.col("doc_id") % 5 == 0, F.lit(" vile.")).otherwise(F.lit(" mild."))
    docs = spark.range(9000).select(F.col("id").alias("doc_id")).select("doc_id", F.concat(text, toxic).alias("text"))
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    assert T.op4_toxicity(docs.filter("doc_id < 200"), labels.filter("doc_id < 200")).count() == 200
    before = _held()
    assert T.op4_toxicity(docs, labels).count() == 9000
    assert _held() - before < 25
