"""Periodic runs of words: seeds on diagonals of equal lag, extended to maximal stretches.

A run is a maximal stretch of words whose smallest period q occurs ``times`` times in it at least, and that has ``least`` words. Words q
apart are identical over length - q of its places, thus over an overlap of max(least - q, (times - 1) * q) words at least.

Seeds. Lags are taken scale by scale; within a scale the index holds k-grams of the least overlap that any of its lags guarantees. With
times >= 3 that is more than the lag itself, so inside a run the next place of a k-gram is exactly one period on (a nearer one would make
a shorter period, by the periodicity lemma). Consecutive places of a k-gram in one document are thus all the pairs that are needed, never
all pairs of a k-gram, and words that repeat ever so often cost no more than others.

Extension. Pairs are taken by (document, lag, place). A table keeps how far each lag is covered: a pair that lies where its lag is
covered already is part of the stretch at hand, the first one beyond starts a new stretch. For a run that gives all of the stretch, since
each of its places has its pair; what is shorter than a run is dropped. The table is an array scan: equal (document, lag) and the place
after the one before. Work is O(n log n) in the words of a document, whatever they are.

A document is one row and its words are in one task; documents are spread by Spark, without a shuffle. Words and k-grams are known by
64-bit hashes.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; runs may overlap; repeated rows are
treated alike, a null id stays null; very long texts are processed whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.llm.words import BASE, mix, scan, words_of

#: Fixed values of op12's contract: words of a run, and its periods, at least.
LEAST = 24
TIMES = 3
_ODD = np.uint64(BASE | 1)

Edit = Callable[[object, list[bytes]], list[bytes]]


def scales(longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(first lag, last lag, k) that cover the lags which runs of a text of ``longest`` words can have."""
    if times < 3:
        raise ValueError("periods must occur three times at least")
    out, low, top = [], 1, longest // times
    overlap = lambda q: max(least - q, (times - 1) * q)
    while low <= top:
        # The least overlap is where least - q falls below (times - 1) * q.
        high = low
        k = overlap(low)
        while high < 2 * low + 7 and min(k, overlap(high + 1)) >= high + 1:
            high += 1
            k = min(k, overlap(high))
        out.append((low, min(high, top), k))
        low = high + 1
    return out


class _Grams:
    """Hashes of the k-grams at every place of a line of words, from those of half the length."""

    def __init__(self, words: np.ndarray):
        self.doubled = [words]

    def __call__(self, k: int) -> np.ndarray:
        while 2 << (len(self.doubled) - 1) <= k:
            last = self.doubled[-1]
            step = 1 << (len(self.doubled) - 1)
            self.doubled.append(mix(last[:-step] * _ODD + last[step:]) if len(last) > step else last[:0])
        top = k.bit_length() - 1
        if k == 1 << top:
            return self.doubled[top]
        # Two overlapping grams of the power of two below k hold all of its words.
        part, rest = self.doubled[top], k - (1 << top)
        return mix(part[:-rest] * _ODD + part[rest:]) if len(part) > rest else part[:0]


def _next_places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, next place with the same gram)."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    return order[:-1][same], order[1:][same]


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one document's word hashes, by start and period."""
    found, grams = [], _Grams(words)
    for low, high, k in scales(len(words), least, times):
        g = grams(k)
        if len(g) < 2:
            break
        place, after = _next_places(g)
        lag = after - place
        kept = (lag >= low) & (lag <= high)
        place, lag = place[kept], lag[kept]
        if not len(place):
            continue
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # Where a pair's lag is covered up to its place already, the pair belongs to the stretch before.
        starts = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)]))
        ends = np.concatenate([starts[1:], [len(place)]]) - 1
        length = place[ends] - place[starts] + k + lag[starts]
        run = length >= np.maximum(least, times * lag[starts])
        found += zip(place[starts][run].tolist(), length[run].tolist(), lag[starts][run].tolist())
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def _repeating(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Texts of a chunk in which some k-gram occurs twice; only those can have runs."""
    grams = _Grams(words)(k)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(grams)]
    # A gram across two texts is told apart by its place.
    inside = np.arange(len(grams)) + k <= first[1:][text]
    keyed = mix(grams[inside] ^ mix(text[inside].astype(np.uint64) + np.uint64(1)))
    text = text[inside]
    order = np.argsort(keyed)
    keyed = keyed[order]
    return np.unique(text[order[1:]][keyed[1:] == keyed[:-1]])


def _described(edit: Edit | None, least: int, times: int):
    # The least overlap that a run of any period has.
    seed = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))

    def step(rows: dict) -> pa.RecordBatch:
        lists = [(t or b"").split() for t in rows["text"]]
        if edit is not None:
            lists = [edit(d, line) for d, line in zip(rows["doc_id"], lists)]
        texts = [b" ".join(line) for line in lists]
        w = words_of(texts, lower=False)
        hashes = w.hashes()
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i in _repeating(hashes, w.first, seed).tolist() if len(hashes) else []:
            runs[i] = runs_of(hashes[w.first[i]:w.first[i + 1]], least, times)
            if runs[i]:
                line = lists[i]
                texts[i] = b" ".join([line[j] for j in np.flatnonzero(kept_words(len(line), runs[i]))])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        made = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64()), pa.array([len(line) for line in lists], pa.int64()), pa.array(made, kind),
             pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return step


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text (UTF-8 bytes) of every row.

    ``edit`` changes a document's words before the search: (doc_id, words) -> words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan(rows, ["doc_id", "text"], lambda: _described(edit, least, times),
                "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The edit of op12's contract: in one document of ten, by the checksum of its id, a stretch is made to repeat."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    """n_runs, the run of the greatest exponent and the digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, edit=planted)
    # length / period as an exact fraction: x goes before y where x.length * y.period is greater.
    best = F.expr(
        "aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (x, y) ->"
        " if(y.length * x.period > x.length * y.period, y, x))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
