"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The words of all items are put into one suffix automaton (states know the items that pass through them). The words of a document
are streamed through it; at each word it knows the longest run ending there that occurs in some item. Runs of at least ``WINDOW``
words, and whole items that are shorter, mark words as hit. Stretches in which some pair of neighbouring words occurs in no item
are skipped beforehand, as no match crosses such a pair; in them the automaton would stand at its root.

The automaton is sent to the tasks, so its size is checked: items are dealt into slices of at most ``SLICE_WORDS`` words (longer
items are cut with an overlap), each slice has an automaton and a pass of its own, and the hits of the passes are merged by document.

Defined results: null text has no words; an item without words has no window and matches nothing; repeated documents are judged
each by itself; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.llm.words import ALPHANUMERIC, scan, words_of

WINDOW = 10
SLICE_WORDS = 200_000


class Automaton:
    """Suffix automaton of word-id sequences. Sequences share one initial state and never run into each other."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ends: list[tuple[int, int]] = []
        for item, words in items:
            at = 0
            for word in words:
                at = self._add(at, word)
                ends.append((at, item))
        self._settle(ends, items)

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.length) - 1

    def _redirect(self, at: int, word: int, old: int) -> int:
        """Split off from ``old`` the strings that are not longer than those reached through ``at``."""
        clone = self._copy(old, self.length[at] + 1)
        self.link[old] = clone
        while at != -1 and self.next[at].get(word) == old:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _add(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._redirect(last, word, known)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, at = len(self.length) - 1, last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._redirect(at, word, known)
        return new

    def _settle(self, ends: list[tuple[int, int]], items: list[tuple[int, list[int]]]) -> None:
        """Items of each window state (the one that holds the run of exactly ``window`` words) and of short whole items."""
        self.items: dict[int, set[int]] = {}
        for state, item in ends:
            while state > 0 and self.length[self.link[state]] >= self.window:
                state = self.link[state]
            if self.length[state] >= self.window:
                self.items.setdefault(state, set()).add(item)
        # A state may have been split after an item ended in it, so short items are walked again.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            if 0 < len(words) < self.window:
                at = 0
                for word in words:
                    at = self.next[at][word]
                self.short.setdefault(at, []).append((len(words), item))
        self.window_of = [0] * len(self.length)
        self.short_of: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            self.window_of[state] = (state if self.length[up] < self.window else self.window_of[up]) if self.length[state] >= self.window else 0
            self.short_of[state] = self.short_of[up] + self.short.get(state, []) if up > 0 else self.short.get(state, [])

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [a, b) of the sequence, and the items whose windows occur in it."""
        state = held = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        step, link, length, window = self.next, self.link, self.length, self.window
        for i, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                held = length[state]
            if word in step[state]:
                state = step[state][word]
                held += 1
            if held >= window:
                spans.append((i - window + 1, i + 1))
                # Of the matched run only its last ``window`` words count here: the state that holds them.
                found |= self.items.get(self.window_of[state], set())
            for size, item in self.short_of[state]:
                if size <= held:
                    spans.append((i - size + 1, i + 1))
                    found.add(item)
        return spans, found


def item_slices(bench: DataFrame, limit: int = SLICE_WORDS, window: int = WINDOW) -> list[list[tuple[int, np.ndarray]]]:
    """Word hashes of the items, in slices of at most ``limit`` words; read item by item, one slice is one broadcast.

    A longer item is cut into pieces that overlap by ``window`` - 1 words, so that each of its windows lies in one piece.
    """
    out: list[list[tuple[int, np.ndarray]]] = [[]]
    held = 0
    for row in bench.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        if row["text"]:
            h = words_of([bytes(row["text"])], ALPHANUMERIC).hashes()
            starts = range(0, len(h) - window + 1, max(1, limit - window + 1)) if len(h) > limit else range(min(1, len(h)))
            for piece in (h[a:a + max(limit, window)] for a in starts):
                if held and held + len(piece) > limit:
                    out.append([])
                    held = 0
                held += len(piece)
                out[-1].append((row["item_id"], piece))
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))


def _matcher(items: list[tuple[int, np.ndarray]], window: int, emit):
    """A step for :func:`scan`: hits of each text of the chunk, given to ``emit``."""
    known = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
    pairs = np.unique(np.concatenate([_pairs(h[:-1], h[1:]) for _, h in items])) if items else known
    shortest = min([window, *(len(h) for _, h in items)])
    machine = Automaton([(i, np.searchsorted(known, h).tolist()) for i, h in items], window)

    def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.zeros(len(x), bool)
        at = np.searchsorted(sorted_values, x)
        return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x

    # Most pairs of neighbours are told apart by a bitmap; the sorted array decides on the rest.
    bits = np.zeros(1 << 22, bool)
    bits[(pairs & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def step(rows: dict):
        w = words_of(rows["text"], ALPHANUMERIC)
        h, first = w.hashes(), w.first
        if not len(h):
            return emit(rows, w, {})
        joined = np.zeros(len(h) + 1, bool)
        p = _pairs(h[:-1], h[1:])
        likely = np.flatnonzero(bits[(p & np.uint64((1 << 22) - 1)).astype(np.int64)])
        joined[1 + likely[member(pairs, p[likely])]] = True
        joined[first[:-1]] = False
        joined[first[first < len(joined)]] = False
        # Stretches of words in which every neighbouring pair is known.
        begins = np.flatnonzero(~joined[:len(h)])
        ends = np.append(begins[1:], len(h))
        if shortest < 2:
            ok = (ends - begins > 1) | member(known, h[begins])
        else:
            ok = ends - begins >= shortest
        hits: dict[int, tuple[list, set]] = {}
        for a, b in zip(begins[ok].tolist(), ends[ok].tolist()):
            ids = np.searchsorted(known, h[a:b])
            spans, found = machine.walk(ids.tolist())
            if found:
                text = int(np.searchsorted(first, a, side="right")) - 1
                old = hits.setdefault(text, ([], set()))
                old[0].extend((a - int(first[text]) + x, a - int(first[text]) + y) for x, y in spans)
                old[1].update(found)
        return emit(rows, w, hits)

    return step


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


HITS = "doc_id long, n_words long, n_hit long, n_items long, items array<long>, spans array<struct<a:long,b:long>>"


def _arrow_hits(rows, n_words, hits) -> pa.Table:
    n = len(rows["doc_id"])
    spans = [merge_spans(hits[i][0]) if i in hits else [] for i in range(n)]
    items = [sorted(hits[i][1]) if i in hits else [] for i in range(n)]
    return pa.table({
        "doc_id": pa.array(rows["doc_id"], pa.int64()),
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items": pa.array(items, pa.list_(pa.int64())),
        "spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
    })


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Words, hit words, items and hit spans (in words) of every document."""
    slices = item_slices(bench, slice_words, window)
    spark = docs.sparkSession

    def one(items) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)
        return scan(docs, ["doc_id", "text"], lambda: _matcher(
            sent.value, window, lambda rows, w, found: _arrow_hits(rows, np.diff(w.first), found)), HITS)

    if len(slices) == 1:
        return one(slices[0])
    # Every pass sees every document; repeated rows of an id are told apart by their text.
    parts = None
    for items in slices:
        sent = spark.sparkContext.broadcast(items)
        tagged = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
        flat = tagged.select(F.to_json("doc_id").alias("doc_id"), "text")
        part = scan(flat, ["doc_id", "text"], lambda sent=sent: _matcher(
            sent.value, window, lambda rows, w, found: _arrow_hits(rows | {"doc_id": [None] * len(rows["doc_id"])}, np.diff(w.first), found)
            .append_column("key", pa.array(rows["doc_id"], pa.string()))), HITS + ", key string")
        parts = part if parts is None else parts.unionAll(part)
    merged = parts.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"), F.count("*").alias("rows"))

    def join_up(state, s):
        last = F.element_at(state, -1)
        return F.when((F.size(state) > 0) & (s["a"] <= last["b"]), F.concat(
            F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))),
            F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))).otherwise(F.concat(state, F.array(s)))

    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    merged = merged.withColumn("spans", F.aggregate("raw", empty, join_up))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    copies = F.sequence(F.lit(1), (F.col("rows") / len(slices)).cast("int"))
    return merged.select(
        F.get_json_object("key", "$.doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "spans", F.explode(copies).alias("_c")).drop("_c")


def op10_contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The query's columns; an item set is given by its digest."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def cut_text(data: bytes, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    out, at = [], 0
    for a, b in merge_spans(spans):
        out.append(data[at:int(starts[a])])
        at = int(ends[b - 1])
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")


def decontaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, drop_over: float = 0.0, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Documents after removal: one whose share of hit words exceeds ``drop_over`` goes, others lose the hit spans.

    All columns stay; ``n_chars``, if there is one, follows the text. With several slices, each pass hands the spans that it found on
    with the row, and the last one judges and cuts the untouched text by all of them.
    """
    slices = item_slices(bench, slice_words, window)
    names, kinds = docs.columns, dict(docs.dtypes)
    held = "_spans"
    while held in names:
        held += "_"
    spark = docs.sparkSession

    def hand_on(rows, w, found):
        spans = [merge_spans([(x["a"], x["b"]) for x in old] + (found[i][0] if i in found else [])) for i, old in enumerate(rows[held])]
        cols = rows | {held: [[{"a": a, "b": b} for a, b in s] for s in spans],
                       "text": [None if t is None else t.decode("utf-8", "replace") for t in rows["text"]]}
        return pa.table({c: pa.array(cols[c], types[c]) for c in [*names, held]})

    def cut(rows, w, found):
        keep, text, begins = [], [], np.cumsum([0] + [len(t or b"") + 1 for t in rows["text"]])
        changed = set()
        for i, t in enumerate(rows["text"]):
            spans = found[i][0] if i in found else []
            spans = merge_spans(spans + [(x["a"], x["b"]) for x in rows[held][i]] if held in rows else spans)
            n = int(w.first[i + 1] - w.first[i])
            hit = sum(b - a for a, b in spans)
            if hit and hit > drop_over * n:
                continue
            keep.append(i)
            if spans:
                changed.add(i)
            own = slice(int(w.first[i]), int(w.first[i + 1]))
            text.append(None if t is None else t.decode("utf-8", "replace") if not spans
                        else cut_text(t, w.starts[own] - begins[i], w.ends[own] - begins[i], spans))
        cols = {c: [rows[c][i] for i in keep] for c in names} | {"text": text}
        if "n_chars" in cols:
            cols["n_chars"] = [len(t) if i in changed and t is not None else rows["n_chars"][i] for i, t in zip(keep, text)]
        return pa.table({c: pa.array(cols[c], types[c]) for c in names})

    from pyspark.sql.pandas.types import to_arrow_schema
    if len(slices) > 1:
        docs = docs.withColumn(held, F.array().cast("array<struct<a:bigint,b:bigint>>"))
        kinds |= {held: "array<struct<a:bigint,b:bigint>>"}
    arrow = to_arrow_schema(docs.schema)
    types = {c: arrow.field(c).type for c in docs.columns}
    for at, items in enumerate(slices):
        last = at == len(slices) - 1
        sent = spark.sparkContext.broadcast(items)
        columns = docs.columns
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in (names if last else columns))
        docs = scan(docs, columns, lambda sent=sent, emit=cut if last else hand_on: _matcher(sent.value, window, emit), schema)
    return docs
