from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dipwatch.llm import centroids as C
from tests.llm import data

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, k=8, rounds=10, dimensions=64):
    """Plain rounds over Python integers; rows are (vec_id, components)."""
    kept = []
    for name, x in rows:
        if x is not None and len(x) == dimensions and all(c is not None and math.isfinite(c) for c in x):
            kept.append((name, [math.floor(1024 * max(-C.LIMIT / 1024, min(C.LIMIT / 1024, float(np.float32(c))))) for c in x]))
    digest = lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()
    seeds = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r), r[0] or 0, r[1]))[:k]
    cents = [p for _, p in seeds]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    nearest = lambda p: min(range(len(cents)), key=lambda j: (far(p, cents[j]), j))
    for _ in range(rounds):
        own = [nearest(p) for _, p in kept]
        for j in range(len(cents)):
            mine = [p for (_, p), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = [nearest(p) for _, p in kept]
    d = [far(p, cents[j]) for (_, p), j in zip(kept, own)]
    by = {j: sum(x for x, o in zip(d, own) if o == j) for j in own}
    return [(name, j, x, by[j], sum(d), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
            for (name, _), j, x in zip(kept, own, d)]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{data.SF}/embeddings.parquet")
    want = _brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    assert data.rows_of(C.op11_centroids(rows)) == sorted(want, key=repr)


def _blobs(draw, n, groups, dimensions=64, spread=0.3):
    middles = [[draw.gauss(0, 2) for _ in range(dimensions)] for _ in range(groups)]
    return [(i, [float(np.float32(m + draw.gauss(0, spread))) for m in middles[i % groups]]) for i in range(n)]


def test_edges(spark):
    draw = random.Random(6)
    rows = _blobs(draw, 90, 5)
    rows += [(7, rows[3][1])] * 20 + [(i, rows[4][1]) for i in range(500, 520)]
    rows += [(None, rows[5][1]), (None, rows[6][1]), (600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [None] + [0.0] * 63),
             (605, [float("nan")] + [0.0] * 63), (606, [float("-inf")] + [0.0] * 63), (607, [3e38] * 32 + [-3e38] * 32), (608, [0.0] * 64)]
    table = spark.createDataFrame([(i, x, 1) for i, x in rows], SCHEMA).repartition(7)
    table = table.withColumns({c: F.lit("x") for c in ("row", "cluster", "upper", "lower", "moved", "point", "distance", "inertia", "hash")})
    assert data.rows_of(C.op11_centroids(table)) == sorted(_brute(rows), key=repr)


def test_few_and_equal_vectors(spark):
    for rows in ([(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(30)], [(1, [0.5] * 64), (2, [0.1] * 64), (2, [0.2] * 64)]):
        table = spark.createDataFrame([(i, x, None) for i, x in rows], SCHEMA)
        assert data.rows_of(C.op11_centroids(table)) == sorted(_brute(rows), key=repr)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        got = C.op11_centroids(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_separate_groups_are_rarely_scanned(spark):
    rows = _blobs(random.Random(2), 600, 8, spread=0.05)
    table = spark.createDataFrame([(i, x, None) for i, x in rows], SCHEMA)
    found, _, scanned = C.clustered(table)
    assert scanned[0] == 600 and sum(scanned[3:]) < 600 and found.count() == 600


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(2, 5), st.sampled_from([1, 30, 3000]))
def test_loosening_holds_over_the_sphere_and_beats_the_drift(seed, dimensions, size):
    draw = np.random.default_rng(seed)
    old, new = draw.integers(-size, size + 1, (2, 4, dimensions))
    radius = draw.random(4) * size
    loss = C.loosened(radius, old, new)
    away = draw.normal(size=(4, 400, dimensions))
    away *= (radius[:, None] * draw.random((4, 400)) ** 0.2 / np.maximum(1e-9, np.sqrt((away ** 2).sum(2))))[..., None]
    x = old[:, None] + away
    gap = lambda c: np.sqrt(((x[:, :, None] - c[None, None]) ** 2).sum(3))
    assert ((gap(old) - gap(new)).max(1) <= loss + 1e-6).all()
    assert (loss <= np.sqrt(((new - old) ** 2).sum(1))[None] * (1 + 1e-9) + 1e-9).all()


def test_loosening_by_hand():
    # A centroid that moves across the line of sight, or away, costs a small sphere nearly nothing; towards it, the drift.
    old, new = np.array([[0, 0], [100, -5], [100, 0], [100, 0]]), np.array([[0, 0], [100, 5], [120, 0], [80, 0]])
    loss = C.loosened(np.array([1.0, 0, 0, 0]), old, new)[0]
    assert loss[1] < 0.2 and loss[2] < 1e-3 and abs(loss[3] - 20) < 1e-3
