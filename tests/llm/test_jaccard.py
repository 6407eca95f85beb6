from __future__ import annotations

import random
import re

import numpy as np
import pytest

from dipwatch.llm import jaccard as J
from dipwatch.llm.components import components
from dipwatch.llm.words import mix
from tests.llm.data import SCHEMA, SF, clashing, edge_docs, no_docs, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text, words=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def _brute(rows, words=3, percent=90):
    sets = [_set(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("name", ["edge", "given", "borderline"])
def test_against_all_pairs(spark, name):
    if name == "edge":
        docs = clashing(edge_docs(spark))
    elif name == "given":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    else:
        # Texts of many lengths with just so many edits that links lie on both sides of the limit; chains of edits.
        draw, rows = random.Random(8), []
        for size in (3, 9, 11, 12, 13, 30, 60, 200):
            base = [f"v{draw.randrange(10**6)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4):
                text = list(base)
                for _ in range(edits):
                    text[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
                rows.append((len(rows), " ".join(text), "en", "a", 1))
                if draw.random() < 0.3:
                    base = text
        docs = spark.createDataFrame(rows, SCHEMA)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    # A node is an id: rows of one id with two texts are told apart.
    assert rows_of(J.op5_jaccard_join(docs)) == _brute(rows)


def test_linked_sets_share_a_tile():
    draw = np.random.Generator(np.random.PCG64(1))

    def names(values):
        s = np.unique(values)
        return set(J.tiles(s, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])).tolist())

    for _ in range(400):
        n = int(draw.integers(9, 900))
        a = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        gone = int(draw.integers(0, n // 9 + 1))
        b = np.concatenate([a[gone:], draw.integers(0, 1 << 63, int(draw.integers(0, n // 9 + 1)), dtype=np.uint64) * np.uint64(2)])
        common = n - gone
        if 100 * common >= 90 * (n + len(b) - common) and len(b) >= 9 and max(n, len(b)) >= 10:
            assert names(a) & names(b)


def test_bitmap_bound_never_loses_a_link():
    assert J.differences(9, 10) == 1 and J.differences(9, 9) == 0
    for a in range(1, 200):
        for b in range(a, 200):
            for common in range(a + 1):
                if 100 * common >= 90 * (a + b - common):
                    assert a + b - 2 * common <= J.differences(a, b)


def test_wide_bitmaps_never_lose_a_link_and_tell_long_sets_apart():
    draw = np.random.default_rng(5)
    said = 0
    for n in (513, 900, 1023, 1025, 4000, 30000):
        for percent in (80, 90):
            x = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
            for change in (0.02, 0.05, 0.1, 0.11, 0.2, 0.22, 0.25, 1.0):
                kept = x[draw.random(len(x)) >= change]
                for y in (kept, np.unique(np.concatenate([kept, draw.integers(0, 1 << 64, n - len(kept), dtype=np.uint64)]))):
                    common = len(np.intersect1d(x, y))
                    linked = 100 * common >= percent * (len(x) + len(y) - common)
                    found = J._may_link(J._wide(x), J._wide(y), len(x) + len(y), percent)
                    assert found or not linked
                    assert found == J._may_link(J._wide(y), J._wide(x), len(x) + len(y), percent)
                    said += change == 1.0 and len(y) > 512 and not found
    assert said == 12
    assert J._wide(np.arange(512, dtype=np.uint64)) == b""
    assert J._may_link(b"", J._wide(np.arange(600, dtype=np.uint64)), 1112, 90)


def test_long_texts_that_share_most_of_their_tiles(spark):
    # Long texts: copies with few and with many edits, and others that have a long passage in common only.
    draw, rows = random.Random(21), []
    passage = [f"p{i}" for i in range(700)]
    for family in range(4):
        base = [f"f{family}x{i}" for i in range(900)] + passage
        for edits in (0, 5, 12, 40, 60, 90):
            text = list(base)
            for at in draw.sample(range(900), edits):
                text[at] = f"e{draw.randrange(10**9)}"
            rows.append((len(rows), " ".join(text), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    for words, percent in ((3, 90), (5, 80)):
        got = J.jaccard_components(docs, words, percent).collect()
        assert sorted((tuple(r) for r in got), key=repr) == _brute([r[:2] for r in rows], words, percent)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)}


def test_many_near_copies_that_do_not_all_link(spark):
    draw, base = random.Random(2), [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for p in draw.sample(range(2, 118), 3):
            text[p] = f"x{i}_{p}"
        rows.append((i + 1, " ".join(text), "en", "a", 1))
    rows.append((500, " ".join(base), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(J.op5_jaccard_join(docs)) == _brute([(r[0], r[1]) for r in rows])


def test_empty_table(spark):
    assert J.op5_jaccard_join(no_docs(spark)).count() == 0
    assert J.one_of_each(no_docs(spark)).count() == 0


def _check_kept(rows, kept, words=3, percent=90):
    """Of each component one row, with its least id; of rows without words each different one."""
    least, groups, wordless = _linked_rows(rows, words, percent), {}, set()
    for i, row in enumerate(rows):
        if _set(row[1], words):
            groups.setdefault(least[i], []).append(row)
        else:
            wordless.add(row)
    left = sorted(kept, key=repr)
    for group in groups.values():
        first = min((d for d, _ in group if d is not None), default=None)
        found = [r for r in left if r in group and r[0] == first]
        assert len(found) == 1, (group, found)
        left.remove(found[0])
    assert left == sorted(wordless, key=repr)


def test_one_document_of_each_group_stays(spark):
    docs = clashing(edge_docs(spark))
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    _check_kept([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in kept.select("doc_id", "text").collect()])


def test_rows_that_share_an_id_or_have_none_are_decided_on_one_by_one(spark):
    draw = random.Random(7)
    base = [[f"z{draw.randrange(10**6)}" for _ in range(80)] for _ in range(6)]

    def near(i):
        return " ".join(base[i][:-1] + [f"e{draw.randrange(10**6)}"])

    rows = [(1, near(0)), (2, near(0)), (2, near(1)), (None, near(0)), (None, near(2)), (None, near(2)), (None, near(3)), (9, near(4)), (9, near(4)),
            (9, near(4)), (8, near(5)), (7, near(5)), (7, near(4)), (None, None), (None, ""), (3, None), (3, None), (3, " ")]
    rows += [(2, rows[2][1]), (None, rows[6][1])]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA).repartition(4)
    kept = [tuple(r) for r in J.one_of_each(docs, words=5, percent=80).select("doc_id", "text").collect()]
    _check_kept(rows, kept, 5, 80)
    again = J.one_of_each(docs.repartition(3), words=5, percent=80).select("doc_id", "text")
    assert (2, rows[2][1]) in kept and rows_of(again) == sorted(kept, key=repr)


def _linked_rows(rows, words, percent):
    """Components of (doc_id, text) by all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").lower())
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    return least


def test_the_pipelines_stage_links_by_five_words_and_four_fifths(spark):
    import corpus_pipeline

    draw, rows = random.Random(9), []
    for size in (5, 8, 9, 10, 14, 30, 60, 150, 400):
        base = [f"v{draw.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 2, 3, 5, 8, 12):
            text = list(base)
            for _ in range(edits):
                text[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(text), "en", "a", 1))
    # One run of ten words of 150 replaced: 132 of 160 shingles of five words are common, 136 of 160 of three.
    base = [f"w{i}" for i in range(150)]
    rows += [(1000, " ".join(base), "en", "a", 1), (1001, " ".join(base[:70] + [f"x{i}" for i in range(10)] + base[80:]), "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.jaccard(spark, docs, SF).collect()}
    least = _linked_rows([(r[0], r[1]) for r in rows], 5, 80)
    assert kept == {rows[i][0] for i in set(least)} and 1000 in kept and 1001 not in kept


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_linked_sets_share_a_tile_at_other_percentages(percent):
    draw = np.random.Generator(np.random.PCG64(2))

    def names(s):
        return set(J.tiles(s, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))]), percent).tolist())

    tried = 0
    for _ in range(600):
        n = int(draw.integers(5, 900))
        values = np.unique(draw.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        most = n * (100 - percent) // 100 + 1
        a, b = np.sort(values[draw.permutation(len(values))[:n]]), None
        rest = np.setdiff1d(values, a)
        b = np.sort(np.concatenate([draw.permutation(a)[int(draw.integers(0, most)):], rest[:int(draw.integers(0, most))]]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (n + len(b) - common) and len(a) + len(b) > common * 2:
            tried += 1
            assert names(a) & names(b)
    assert tried > 50


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_as_many_tiles_as_they_need(percent):
    draw, tried, more = np.random.default_rng(8), 0, 0

    def banded(s):
        return J.banded_tiles(s, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))]), percent)

    for _ in range(600):
        n = int(draw.integers(5, 2000))
        # Hashes of a part of the range only leave many segments empty.
        top = 1 << (64 if draw.random() < 0.7 else 62)
        values = np.unique(draw.integers(0, top, 2 * n, dtype=np.uint64))
        most = n * (100 - percent) // 100 + 1
        a = np.sort(values[draw.permutation(len(values))[:n]])
        rest = np.setdiff1d(values, a)
        b = np.sort(np.concatenate([draw.permutation(a)[int(draw.integers(0, most)):], rest[:int(draw.integers(0, most))]]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (n + len(b) - common) and len(a) + len(b) > common * 2:
            tried += 1
            shared = [(len(np.intersect1d(x, y)), max(p, q)) for p, x in banded(a) for q, y in banded(b)]
            assert any(have >= need for have, need in shared)
            more += any(have >= need > 1 for have, need in shared)
    assert tried > 50 and more > 20


def test_common_phrases_make_no_large_tiles(spark):
    # Other texts with a few phrases in common: no link, and no tile in which all of them would meet.
    draw, rows = random.Random(4), []
    phrases = [" ".join(f"p{i}q{j}" for j in range(7)) for i in range(40)]
    for i in range(150):
        text = [f"t{i}x{j}" for j in range(300)]
        for phrase in draw.sample(phrases, 4):
            text.insert(draw.randrange(len(text)), phrase)
        rows.append((i, " ".join(text), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = J.scan(docs, ["doc_id", "text"], J.partial(J._describe, 5, 80),
                  "doc_id long, n long, node long, bitmap array<long>, wide binary, tiles array<struct<need:int,names:array<long>>>")
    named = [r["tile"] for r in sets.selectExpr("inline(tiles)").selectExpr("explode(names) AS tile").collect()]
    assert len(named) - len(set(named)) > 200
    members, hubs = J._tiles_and_hubs(J.stage(sets, "sets"))
    assert members.join(hubs, "tile").count() < 10
    assert rows_of(J.jaccard_components(docs, 5, 80)) == _brute([r[:2] for r in rows], 5, 80)


def test_a_pair_with_many_tiles_in_common_leaves_the_join_once(spark):
    rows = [(node, t * 7919 % 1009) for node in (1, 2, 3) for t in range(60) if node < 3 or t % 20 == 0]
    members = J._with_earlier(spark.createDataFrame(rows, "node long, tile long"))
    x, y = (members.selectExpr("tile", f"node AS {n}", f"earlier AS e{n}") for n in "ab")
    met = x.join(y, "tile").filter("a < b AND NOT arrays_overlap(ea, eb)").select("a", "b").collect()
    assert sorted(set(met)) == [(1, 2), (1, 3), (2, 3)]
    assert met.count((1, 2)) == 1
