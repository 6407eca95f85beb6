from __future__ import annotations

import hashlib
import random
import re

import pytest

from dipwatch.llm import decontamination as D
from tests.llm.data import SCHEMA, SF, clashing, edge_docs, no_docs, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = _words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = _words(text)
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[tuple(w[i:i + size])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def _case(spark):
    draw = random.Random(4)
    vocabulary = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 3, 1, 40, 15])]
    items += [(20, None), (21, ""), (22, items[0][1]), (23, "ÉTÉ Straße, 12-34!"), (24, "-- ..")]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(80)))) for i in range(40)]
    for i in range(30):
        text = draw.choice(items[:8])[1].split()
        a = draw.randrange(len(text))
        b = draw.randrange(a, len(text)) + 1
        rows.append((100 + i, "Before, " + "  ".join(text[a:b]).upper() + "; after " + " ".join(draw.choice(vocabulary) for _ in range(9))))
    rows += [(200, "Été straße 12 34 encore"), (201, "ÉTÉ STRAßE 12/34"), (202, None), (203, ""), (None, items[1][1]), (100, "t1"), (100, "t1")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    return docs, spark.createDataFrame(items, "item_id long, text string"), rows, items


@pytest.mark.parametrize("slice_words", [200_000, 30])
def test_against_brute_force(spark, slice_words):
    docs, bench, rows, items = _case(spark)
    found = D.hits(clashing(docs), bench, slice_words=slice_words)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], D.items_digest(r["items"]), r["n_hit"] > 0) for r in found.collect()), key=repr)
    assert got == _brute(rows, items)
    if slice_words > 1000:
        assert rows_of(D.op10_contamination(docs, bench)) == got


def test_given_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = _brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert rows_of(D.op10_contamination(docs, bench)) == want


def test_automaton_on_small_alphabets():
    draw = random.Random(1)
    for _ in range(800):
        window = draw.choice([2, 3, 4])
        items = [(i, [draw.randrange(3) for _ in range(draw.randrange(1, 9))]) for i in range(draw.randrange(1, 6))]
        doc = [draw.randrange(3) for _ in range(draw.randrange(25))]
        hit, found = set(), set()
        for item, w in items:
            size = min(window, len(w))
            for j in range(len(w) - size + 1):
                for i in range(len(doc) - size + 1):
                    if doc[i:i + size] == w[j:j + size]:
                        hit.update(range(i, i + size))
                        found.add(item)
        spans, items_found = D.Automaton(items, window).walk(doc)
        assert {i for a, b in spans for i in range(a, b)} == hit and items_found == found


def test_removal(spark):
    docs, bench, rows, items = _case(spark)
    hit = {(d, n): h for d, n, h, *_ in _brute(rows, items)}
    gone = D.decontaminated(docs, bench)
    assert gone.columns == docs.columns
    assert rows_of(gone.select("doc_id", "text")) == sorted(((i, t) for i, t in rows if not hit[(i, len(_words(t)))]), key=repr)
    cut = D.decontaminated(docs, bench, drop_over=0.5)
    sizes = {i: max(len(_words(t)) for j, t in rows if j == i) for i, _ in rows}
    for r in cut.collect():
        assert r["text"] is None or len(_words(r["text"])) <= sizes[r["doc_id"]]
    # A long span inside a longer text is cut out, and what stands around it stays.
    passage = " ".join(f"q{i}" for i in range(12))
    one = spark.createDataFrame([(1, f"Start of it. {passage}! The end of the text that is much longer than what was cut out, with more words.", "en", "a", 99)], SCHEMA)
    only = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = D.decontaminated(one, only, drop_over=0.5).first()
    assert row["text"] == "Start of it. ! The end of the text that is much longer than what was cut out, with more words."
    assert row["n_chars"] == len(row["text"])


def test_removal_does_not_depend_on_slices(spark):
    docs, bench, rows, items = _case(spark)
    docs = clashing(docs)
    for share in (0.0, 0.3, 0.5, 0.9):
        whole = rows_of(D.decontaminated(docs, bench, drop_over=share))
        assert rows_of(D.decontaminated(docs, bench, drop_over=share, slice_words=30)) == whole
        hit = {(d, n): h for d, n, h, *_ in _brute(rows, items)}
        assert len(whole) == sum(h <= share * n for h, n in ((hit[(i, len(_words(t)))], len(_words(t))) for i, t in rows))
    # 24 of 44 words are hit, 12 by an item of each of two slices: more than half of the untouched text.
    one, two = (" ".join(f"{c}{i}" for i in range(12)) for c in "pq")
    text = one + " " + " ".join(f"r{i}" for i in range(20)) + " " + two
    docs = spark.createDataFrame([(1, text, "en", "a", len(text))], SCHEMA)
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    assert [D.decontaminated(docs, bench, drop_over=0.5, slice_words=n).count() for n in (200_000, 12)] == [0, 0]
    assert D.decontaminated(docs, bench, drop_over=0.6, slice_words=12).first()["text"].split() == [f"r{i}" for i in range(20)]


def test_items_longer_than_a_slice_are_cut_with_an_overlap(spark):
    draw = random.Random(6)
    long = [f"t{draw.randrange(50)}" for _ in range(500)]
    items = [(1, " ".join(long)), (2, "t1 t2 t3")]
    rows = [(i, "x " + " ".join(long[a:a + n]) + " y") for i, (a, n) in enumerate((draw.randrange(480), draw.randrange(8, 60)) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    slices = D.item_slices(bench, 30)
    assert len(slices) > 10 and all(sum(len(h) for _, h in s) <= 30 for s in slices)
    found = D.hits(docs, bench, slice_words=30)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], D.items_digest(r["items"]), r["n_hit"] > 0) for r in found.collect()), key=repr)
    assert got == _brute(rows, items)


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = clashing(edge_docs(spark))
    assert D.op10_contamination(docs, none).filter("contaminated").count() == 0
    assert rows_of(D.decontaminated(docs, none)) == rows_of(docs)
    assert D.op10_contamination(no_docs(spark), none).count() == 0
