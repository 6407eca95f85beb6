from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dipwatch.llm import periodic as P
from tests.llm import data


def _brute(words: list, least: int = P.LEAST, times: int = P.TIMES) -> list[tuple[int, int, int]]:
    """Every lag compared word by word; a stretch counts for its least period only."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                stretch = words[i:j + q]
                if not any(all(x == y for x, y in zip(stretch, stretch[p:])) for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _hashed(words: list) -> np.ndarray:
    known: dict = {}
    return np.array([P.mix(np.array([known.setdefault(w, len(known) + 1)], np.uint64))[0] for w in words], np.uint64)


def _answer(doc_id, text):
    """The contract's row, by brute force."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_scales_cover_every_lag_with_grams_longer_than_the_lag():
    for least, times in [(24, 3), (1, 3), (100, 4), (24, 7)]:
        at = 1
        for low, high, k in P.scales(5000, least, times):
            assert low == at and high >= low
            for q in range(low, high + 1):
                assert q <= k <= max(least - q, (times - 1) * q)
            at = high + 1
        assert at == 5000 // times + 1
        assert len(P.scales(1 << 20, least, times)) < 40
    with pytest.raises(ValueError):
        P.scales(10, 24, 2)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 9), st.integers(0, 2 ** 30)), max_size=6), st.integers(1, 3),
       st.sampled_from([(24, 3), (1, 3), (10, 4)]))
def test_runs_against_brute_force(pieces, letters, rule):
    words = []
    for period, count, seed in pieces:
        draw = random.Random(seed)
        words += [draw.randrange(letters) for _ in range(period)] * count
        words += [draw.randrange(letters) for _ in range(seed % 4)]
    assert P.runs_of(_hashed(words), *rule) == _brute(words, *rule)


def test_long_periods_and_nested_runs():
    draw = random.Random(8)
    inner = [draw.randrange(900) for _ in range(60)]
    block = inner * 3 + [draw.randrange(900) for _ in range(40)] + [7] * 30
    words = [1, 2] + block * 4 + block[:33] + [5] + [draw.randrange(3) for _ in range(400)]
    assert P.runs_of(_hashed(words)) == _brute(words)
    # One word through: one run, whatever the length, in time that the length does not square.
    assert P.runs_of(_hashed([3] * 30_000)) == [(0, 30_000, 1)]
    two = [draw.randrange(2) for _ in range(3000)]
    assert P.runs_of(_hashed(two * 4)) == _brute(two * 4)


def test_kept_words():
    assert P.kept_words(6, []).all()
    assert P.kept_words(10, [(1, 6, 2), (4, 6, 3)]).tolist() == [True] * 3 + [False] * 7


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{data.SF}/documents.parquet")
    short = docs.filter(F.length("text") < 12_000)
    got = {r["doc_id"]: tuple(r) for r in P.op12_periodic_runs(docs).collect()}
    assert len(got) == docs.count() and sum(r[1] > 0 for r in got.values()) > 10
    for doc_id, text in short.select("doc_id", "text").collect():
        assert got[doc_id] == _answer(doc_id, text)


def test_edges(spark):
    draw = random.Random(4)
    rows = [(1000 + i, " ".join(["a", "b", "c"][:1 + i % 3] * 30) + " end" * (i % 30), "en", "a", 1) for i in range(40)]
    words = [f"w{draw.randrange(50)}" for _ in range(70)]
    rows += [(i, "  ".join(words * 4) + "\tEnd\n" + " ".join(["x"] * 24), "en", "a", 1) for i in range(2000, 2030)]
    rows += [(None, "y " * 24, "en", "a", 1), (None, None, None, None, None), (3000, "Ä ä " * 12, None, None, 1)]
    rows += [r for r in data.edge_rows() if len(r[1] or "") < 20_000]
    docs = data.clashing(spark.createDataFrame(rows, data.SCHEMA).repartition(5)).withColumn("runs", F.lit("x"))
    assert data.rows_of(P.op12_periodic_runs(docs)) == sorted((_answer(r[0], r[1]) for r in rows), key=repr)


def test_very_long_text_in_pieces_of_a_chunk(spark):
    text = ("q r s t " * 50_000).strip()
    got = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 200_000, 4)] and bytes(got["collapsed"]) == b"q r s t"


def test_empty_table(spark):
    got = P.op12_periodic_runs(data.no_docs(spark))
    assert got.count() == 0 and got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
