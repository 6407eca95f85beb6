"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``K`` smallest of the 32-bit hashes of a text's distinct five-word shingles. Sketches of parts merge into that of
the whole; they estimate resemblance, containment and the number of distinct shingles.

The query compares each document with an edited form that borrows from its successor by id. Rows are dealt to ranges of ids, so that
a text is moved once; the first documents of each range are also sent to the range before it, as the successor of its last one. The
ranges' bounds and first ids, one number each a range, are all that passes through the driver.

Defined results: null text counts as empty; empty texts have an empty sketch, alike to each other (1) and unlike all else (0); a null
id sorts first; rows of one id follow each other in the order of their texts; a single row is its own successor; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.llm.frames import partitions
from dipwatch.llm.words import CHUNK_BYTES, chunks, shingles, words_of

K = 128
WORDS = 5
_LEAST = -(1 << 63)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        w = words_of(texts[a:b])
        values, at = shingles(w.hashes(), w.first, WORDS)
        values = (values >> np.uint64(32)).astype(np.uint32)
        out += [np.unique(values[at[i]:at[i + 1]])[:K] for i in range(b - a)]
    return out


def merge(*parts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:K]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u4").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u4").astype(np.uint32)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a] if len(a) and len(b) else a[:0]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = _common(a, b)
    last = merge(a, b)
    return int((both <= last[-1]).sum()) / len(last)


def distinct(sketch: np.ndarray) -> float:
    """Number of distinct shingles: exact below K."""
    return float(len(sketch)) if len(sketch) < K else (K - 1) / ((float(sketch[-1]) + 1) / 2.0 ** 32)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the shingles of ``a`` that ``b`` has."""
    r, size = resemblance(a, b), distinct(a)
    return 0.0 if not size else min(1.0, r / (1 + r) * (size + distinct(b)) / size)


def _firsts(ids: DataFrame, bounds: np.ndarray) -> dict[int, int]:
    """Least id of each range that has any."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, k, side="right")
            low = np.full(len(bounds) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, at, k)
            full = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(low[full])], ["r", "k"])

    rows = ids.mapInArrow(least, "r int, k long").groupBy("r").agg(F.min("k").alias("k")).collect()
    return {row["r"]: row["k"] for row in rows}


def _dealt(keyed: DataFrame, bounds: np.ndarray, first: dict[int, int]) -> DataFrame:
    """(r, after, k, doc_id, text): every row in its range, and the first rows of each range once more at the end of the one before."""
    order = sorted(first)
    before = {first[r]: order[i - 1] for i, r in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.array(sorted(before), np.int64)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, k, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(k), bool)), *batch.columns], ["r", "after", "k", "doc_id", "text"])
            again = np.flatnonzero(np.isin(k, heads))
            if len(again):
                to = np.array([before[int(x)] for x in k[again]], np.int32)
                part = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), bool)), *part.columns], ["r", "after", "k", "doc_id", "text"])

    return keyed.mapInArrow(deal, "r int, after boolean, k long, doc_id long, text binary")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: each with its successor, which is the next row; the rows marked ``after`` end a range."""
    held: tuple | None = None
    for batch in batches:
        rows = list(zip(batch.column("r").to_pylist(), batch.column("after").to_pylist(), batch.column("doc_id").to_pylist(),
                        [t or b"" for t in batch.column("text").to_pylist()]))
        for a, b in chunks([r[3] for r in rows], CHUNK_BYTES):
            part = rows[a:b]
            prints = sketches([r[3] for r in part])
            line = ([held] if held else []) + [(*r, s) for r, s in zip(part, prints)]
            held = line[-1]
            pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[1]]
            if not pairs:
                continue
            texts, edited = [], []
            for x, y in pairs:
                text = x[3].decode("utf-8")
                cut = len(text) // 4
                # Four bytes hold any code point, so a short head of the successor is enough.
                edited.append((text[:len(text) - cut] + y[3][:4 * cut + 4].decode("utf-8", "ignore")[:cut]).encode("utf-8"))
                texts.append(len(text))
            after = sketches(edited)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array(texts, pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array([encode(x[4]) for x, _ in pairs]),
                pa.array([encode(s) for s in after]), pa.array([resemblance(x[4], s) for (x, _), s in zip(pairs, after)], pa.float64()),
                pa.array([resemblance(x[4], y[4]) for x, y in pairs], pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op6_fingerprints(docs: DataFrame) -> DataFrame:
    count = partitions(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("binary").alias("text"))
    ids = keyed.select("k")
    found = ids.filter(F.col("k") > _LEAST).approxQuantile("k", [i / count for i in range(1, count)], 0.2 / count)
    bounds = np.unique(np.array(found, np.float64).astype(np.int64))
    dealt = _dealt(keyed, bounds, _firsts(ids, bounds))
    return dealt.repartition(count, "r").sortWithinPartitions("r", "after", "k", "text").mapInArrow(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
                   " near_edited double, near_next double")
