"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence is a bag of hashed features (its words, and their first four and six bytes, which hold for inflected forms). Its score is
a logistic function of their weights; a document's score is the noisy-or of its sentences'. The weights are trained from document
labels alone, by the gradient of the noisy-or likelihood; each toxic document's gradient flows to the sentences that best explain its
label, and the sentence scores then locate what offends. Features whose presence in a document says nothing significant about its
label are left out before.

Labels are read for rows outside the held-out quarter; of those, a hash of the id picks ``FIT_ROWS`` rows at most (bounded,
documented); texts of these rows only come to the driver. Every document is scored over its whole text, without a shuffle.

Defined results: null, empty and wordless texts score 0; documents with several labels count as toxic if any is; null labels are
ignored; without toxic or without clean labels all scores are 0; a null id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipwatch.llm.frames import release
from dipwatch.llm.words import ALPHANUMERIC, SLICE_ROWS, Words, chunks, scan, words_of

FIT_ROWS = 10_000
BUCKETS = 1 << 20
PREFIXES = (4, 6)
THRESHOLD = 0.3
#: Likelihood-ratio statistic a feature must reach, and documents it must be in.
LEAST_G2, LEAST_DOCS = 16.0, 4
STEPS, RATE, DECAY = 300, 0.05, 2e-4
_ENDS = np.zeros(256, np.int32)
_ENDS[[0x21, 0x2E, 0x3F, 0x0A]] = 1


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def word_features(w: Words) -> np.ndarray:
    """Buckets of each word's features, one row a word; a prefix that is the whole word has the word's own bucket."""
    cols = [w.hashes()]
    for n in PREFIXES:
        cols.append(w.hashes(ends=np.minimum(w.starts + n, w.ends)) + np.uint64(n))
        cols[-1] = np.where(w.ends - w.starts > n, cols[-1], cols[0])
    return (np.stack(cols, 1) & np.uint64(BUCKETS - 1)).astype(np.int64)


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and the text it is in."""
    mark = np.cumsum(_ENDS[w.data])[w.starts]
    first = np.flatnonzero(np.diff(mark, prepend=-1))
    return first, np.searchsorted(w.first, first, side="right") - 1


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def logits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, text = sentences(w)
        if not len(first):
            return first, text, np.zeros(0)
        word, _ = np.nonzero(weight := self.weights[f := word_features(w)])
        sentence = np.searchsorted(first, word, side="right") - 1
        # A sentence is a set: a feature counts once, however often it is repeated.
        _, once = np.unique(sentence * BUCKETS + f[weight != 0], return_index=True)
        return first, text, np.bincount(sentence[once], weight[weight != 0][once], len(first)) + self.bias

    def scores(self, w: Words) -> np.ndarray:
        _, text, z = self.logits(w)
        none = np.zeros(len(w.first) - 1)
        np.add.at(none, text, -np.logaddexp(0, z))
        return -np.expm1(none)


def fit(texts: list[bytes], toxic: np.ndarray) -> Model | None:
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    # Two passes over the chunks, so that only counts and the entries of kept features are held.
    n, rate = len(texts), y.mean()
    pos, all_ = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for a in range(0, n, 128):
        w = words_of(texts[a:a + 128], ALPHANUMERIC)
        f = word_features(w)
        own = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        seen = np.unique(np.repeat(own, f.shape[1]) * BUCKETS + f.ravel())
        np.add.at(all_, seen % BUCKETS, 1)
        np.add.at(pos, seen % BUCKETS, y[a + seen // BUCKETS])

    def term(k, m):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(k / m / rate)) + np.nan_to_num((m - k) * np.log((m - k) / m / (1 - rate)))

    g2 = 2 * (term(pos, all_) + term(y.sum() - pos, n - all_))
    kept = (g2 >= LEAST_G2) & (all_ >= LEAST_DOCS) & (pos > rate * all_)
    number = np.cumsum(kept) - 1
    feature, sentence, owner, held = [], [], [], 0
    plain = np.zeros(n)  # sentences without any kept feature
    for a in range(0, n, 128):
        w = words_of(texts[a:a + 128], ALPHANUMERIC)
        first, text = sentences(w)
        plain[a:a + 128] += np.bincount(text, minlength=len(w.first) - 1)
        word, column = np.nonzero(kept[f := word_features(w)])
        in_sentence = np.searchsorted(first, word, side="right") - 1
        pairs = np.unique(in_sentence * BUCKETS + f[word, column])
        some, place = np.unique(pairs // BUCKETS, return_inverse=True)
        feature.append(number[pairs % BUCKETS])
        sentence.append(place + held)
        owner.append(text[some] + a)
        held += len(some)
    feature, place, owner = map(np.concatenate, (feature, sentence, owner))
    plain -= np.bincount(owner, minlength=n)
    size = int(kept.sum())
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = -6.0
    for step in range(1, STEPS + 1):
        z = np.bincount(place, theta[feature], held) + theta[-1]
        none = np.bincount(owner, -np.logaddexp(0, z), n) - plain * np.logaddexp(0, theta[-1])
        p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        pull = np.where(y > 0, (1 - p) / p, -1.0)
        own = pull[owner] / (1 + np.exp(-z))
        base = 1 / (1 + np.exp(-theta[-1]))
        grad = np.empty(size + 1)
        grad[:-1] = np.bincount(feature, own[place], size)
        grad[-1] = own.sum() + (pull * plain * base).sum()
        grad = -grad / n + DECAY * np.append(theta[:-1], 0) * 0.1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[kept] = theta[:-1]
    return Model(weights, float(theta[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most about ``rows`` documents outside the held-out quarter."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(remainder(F.col("doc_id"), 4) != 2)
    share = min(1.0, rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    got = sample.select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    return [t or b"" for t in got.column("text").to_pylist()], np.array(got.column("toxic").to_pylist(), float)


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model; what the sample and the fit took of the driver's memory goes back to the system."""
    model = fit(*labelled_sample(docs, labels))
    release()
    return model


def scored(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """doc_id, score, and the sentences that are toxic by themselves (byte span and score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(rows: dict) -> pa.Table:
            n, known = len(rows["doc_id"]), sent.value
            score, found = np.zeros(n), [[] for _ in range(n)]
            if known is not None:
                w = words_of(rows["text"], ALPHANUMERIC)
                first, text, z = known.logits(w)
                none = np.zeros(n)
                np.add.at(none, text, -np.logaddexp(0, z))
                score = -np.expm1(none)
                begins = np.cumsum([0] + [len(t or b"") + 1 for t in rows["text"]])
                last = np.append(first[1:], len(w.starts)) - 1
                for s in np.flatnonzero(z > 0):
                    found[text[s]].append({"a": int(w.starts[first[s]] - begins[text[s]]), "b": int(w.ends[last[s]] - begins[text[s]]),
                                           "score": float(1 / (1 + np.exp(-z[s])))})
            return pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "score": pa.array(np.clip(score, 0, 1)),
                             "sentences": pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])))})

        return step

    return scan(docs, ["doc_id", "text"], make, "doc_id long, score double, sentences array<struct<a:long,b:long,score:double>>")


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fitted(docs, labels)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text scores below the threshold, in one pass, whatever their id."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        model = sent.value
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for at in range(0, batch.num_rows, SLICE_ROWS):
                texts = batch.column("text").slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()
                for a, b in chunks(texts):
                    none = np.zeros(b - a)
                    if model is not None:
                        _, text, z = model.logits(words_of(texts[a:b], ALPHANUMERIC))
                        np.add.at(none, text, -np.logaddexp(0, z))
                    keep.append(-np.expm1(none) < threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
