"""Language-model scores of documents by a hashed maximum-entropy model trained on the corpus (numpy side: ``maxent``).

1. Counts. Every task counts the words of its training documents; counts meet by hash part, a slice of the hash range. The number of
   parts follows the bytes of the corpus, so that a part fits in one task. What is gathered grows with the corpus.
2. Classes of word kinds are clustered from counts of fixed size.
3. Weights. ``ROUNDS`` distributed updates, each over another part of all training documents: tasks take gradient steps from the same
   weights, and the mean of their changes (over the tasks that touched a row) is added. Every training document is used once.
4. Scores. Class scores are made where the text is. Words with at least ``FREQUENT`` of all tokens, of which there can be no more than
   ``1 / FREQUENT``, are known to every task; the others meet their counts by hash part. No such word can make a part large.

Blocks of numbers from many tasks are summed in two steps, so that no task receives something from all.

Defined results: null and empty texts are the end token alone; a null id is not held out; with nothing to learn from, the base score
is 0 a token; repeated rows have rows of their own with equal scores; extra columns are ignored. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.llm import maxent as M
from dipwatch.llm.toxicity import remainder
from dipwatch.llm.words import scan
from dipwatch.session import stage

#: Bytes of text a hash part, and a task that hands on a whole table of numbers; parts at least.
PART_BYTES, LEAST_PARTS = 32 << 20, 32
FREQUENT = 2e-6
ROUNDS = 3
#: Entries a task holds before it hands them on.
HELD = 2_000_000
FAN_IN = 256
BLOCK_ROWS = 1024
SMOOTH = 0.1


def _cut(words: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts in sorted hashes."""
    edge = [(i << 64) // parts for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(words, np.array(edge, np.uint64)), [len(words)]]).astype(int)


def _salt() -> int:
    context = TaskContext.get()
    return context.partitionId() % FAN_IN if context else 0


def _blocks_summed(rows: DataFrame, kind: str) -> DataFrame:
    """(block, salt, data) -> (block, data): element-wise sums."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(d, kind) for d in group["data"][1:]), np.frombuffer(group["data"].iloc[0], kind).copy())
        return pd.DataFrame({"block": [group["block"].iloc[0]], "data": [total.tobytes()]})

    once = rows.groupBy("block", "salt").applyInPandas(add, "block int, data binary")
    return once.groupBy("block").applyInPandas(add, "block int, data binary")


def _merge(words: list[np.ndarray], counts: list[np.ndarray], kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, c, k = np.concatenate(words), np.concatenate(counts), np.concatenate(kinds)
    order = np.argsort(w, kind="stable")
    w = w[order]
    begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    return w[begin], np.add.reduceat(c[order], begin), k[order][begin]


def _counter(parts: int) -> Callable:
    """Counts of words and of contexts; contexts are in rows of negative parts."""
    def make():
        held: list[list[np.ndarray]] = [[], [], []]
        total = np.zeros((M.KINDS, 2 * M.CONTEXT), np.int64)

        def flush(everything: bool) -> pa.Table | None:
            rows = []
            if held[0]:
                w, c, k = _merge(*held)
                for x in held:
                    x.clear()
                if not everything and len(w) < HELD:
                    held[0].append(w), held[1].append(c), held[2].append(k)
                    return None
                at = _cut(w, parts)
                rows += [(i, 0, w[a:b].tobytes(), c[a:b].tobytes(), k[a:b].tobytes()) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
            if everything and total.any():
                size = M.KINDS // 64
                rows += [(-1 - i, _salt(), total[i * size:(i + 1) * size].tobytes(), None, None) for i in range(64)]
            names = [("part", pa.int32()), ("salt", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary())]
            return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(names)}) if rows else None

        def step(rows: dict) -> pa.Table | None:
            t = M.tokens_of(rows["text"])
            total[:] += M.contexts(t)
            w, i, c = np.unique(t.hashes, return_index=True, return_counts=True)
            held[0].append(w), held[1].append(c.astype(np.int64)), held[2].append(t.kinds[i].astype(np.int16))
            return flush(False) if sum(map(len, held[0])) > 2 * HELD else None

        step.rest = lambda: flush(True)
        return step

    return make


def _vocabulary(counted: DataFrame) -> DataFrame:
    """One row a part: its words by hash, their counts and kinds."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        w, c, k = _merge(*([np.frombuffer(x, t) for x in group[n]] for n, t in (("words", np.uint64), ("counts", np.int64), ("kinds", np.int16))))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "n": [int(c.sum())], "v": [len(w)], "words": [w.tobytes()],
                             "counts": [c.tobytes()], "kinds": [k.tobytes()]})

    return counted.filter("part >= 0").drop("salt").groupBy("part").applyInPandas(
        merge, "part int, n long, v long, words binary, counts binary, kinds binary")


def _frequent(vocabulary: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least so many tokens: at most 1 / FREQUENT of them."""
    def pick(batches):
        for batch in batches:
            out = []
            for words, counts in zip(batch["words"], batch["counts"]):
                w, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
                out.append((w[c >= least].tobytes(), c[c >= least].tobytes()))
            yield pd.DataFrame(out, columns=["words", "counts"])

    rows = vocabulary.select("words", "counts").mapInPandas(pick, "words binary, counts binary").collect()
    w = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows] + [np.zeros(0, np.uint64)])
    c = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows] + [np.zeros(0, np.int64)])
    order = np.argsort(w)
    return w[order], c[order]


def _class_totals(vocabulary: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def total(batches):
        for batch in batches:
            n, v = np.zeros(M.CLASSES), np.zeros(M.CLASSES)
            for counts, kinds in zip(batch["counts"], batch["kinds"]):
                own = classes[np.frombuffer(kinds, np.int16)]
                n += np.bincount(own, np.frombuffer(counts, np.int64), M.CLASSES)
                v += np.bincount(own, minlength=M.CLASSES)
            yield pd.DataFrame({"k": np.arange(M.CLASSES), "n": n, "v": v})

    rows = vocabulary.select("counts", "kinds").mapInPandas(total, "k int, n double, v double").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(M.CLASSES), np.zeros(M.CLASSES)
    for r in rows:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


#: A touched row of the table: its place, the change and the number of tasks that touched it.
_CHANGE = np.dtype([("row", "i4"), ("delta", "f4", (M.CLASSES,)), ("tasks", "f4")])


def _changes_summed(rows: DataFrame) -> DataFrame:
    """(block, salt, data) -> (block, data): changes of touched rows, summed by row."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        all_rows = np.concatenate([np.frombuffer(d, _CHANGE) for d in group["data"]])
        all_rows = all_rows[np.argsort(all_rows["row"], kind="stable")]
        begin = np.flatnonzero(np.diff(all_rows["row"], prepend=-1))
        total = all_rows[begin]
        total["delta"], total["tasks"] = np.add.reduceat(all_rows["delta"], begin), np.add.reduceat(all_rows["tasks"], begin)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "data": [total.tobytes()]})

    once = rows.groupBy("block", "salt").applyInPandas(add, "block int, data binary")
    return once.groupBy("block").applyInPandas(add, "block int, data binary")


def trained_weights(train: DataFrame, classes: np.ndarray, tasks: int, bits: int) -> np.ndarray:
    """Weights after one distributed update for each part of the training documents."""
    weights = np.zeros((1 << bits, M.CLASSES), np.float32)
    context = train.sparkSession.sparkContext
    for turn in range(ROUNDS):
        sent = context.broadcast((weights, classes))

        def make():
            start, kinds = sent.value
            own, squares, touched = start.copy(), np.zeros_like(start), np.zeros(len(start), bool)

            def step(rows: dict) -> None:
                M.update(own, squares, touched, M.tokens_of(rows["text"]), kinds)

            def rest() -> pa.Table | None:
                if not touched.any():
                    return None
                changed = np.zeros(int(touched.sum()), _CHANGE)
                changed["row"] = np.flatnonzero(touched)
                changed["delta"], changed["tasks"] = (own - start)[touched], 1
                blocks, at = np.unique(changed["row"] // BLOCK_ROWS, return_index=True)
                return pa.table({"block": pa.array(blocks, pa.int32()), "salt": pa.array([_salt()] * len(blocks), pa.int32()),
                                 "data": pa.array([x.tobytes() for x in np.split(changed, at[1:])], pa.binary())})

            step.rest = rest
            return step

        part = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).coalesce(tasks)
        changes = _changes_summed(scan(part, ["text"], make, "block int, salt int, data binary")).collect()
        weights = weights.copy()
        for row in changes:
            d = np.frombuffer(row["data"], _CHANGE)
            weights[d["row"]] += d["delta"] / d["tasks"][:, None]
    return weights


SCORED = ("rid long, doc_id long, held_out boolean, n_tokens long, known long, counted double, classed double, part int, base long,"
          " words binary, places binary")


def _scorer(sent, parts: int) -> Callable:
    """Rows of documents, with what is known of them here, and rows of the words to be looked up (part, base, words, places)."""
    def make():
        weights, classes, frequent, counts, norm = sent.value
        context = TaskContext.get()
        top = (context.partitionId() if context else 0) << 40
        state = {"next": top, "base": top, "held": 0}
        words: list[np.ndarray] = []
        places: list[np.ndarray] = []

        def table(**cols) -> pa.Table:
            n = max(len(v) for v in cols.values())
            kinds = {"rid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(),
                     "counted": pa.float64(), "classed": pa.float64(), "part": pa.int32(), "base": pa.int64(), "words": pa.binary(),
                     "places": pa.binary()}
            return pa.table({k: pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()})

        def flush() -> pa.Table | None:
            if not words:
                return None
            w, p = np.concatenate(words), np.concatenate(places)
            order = np.argsort(w, kind="stable")
            w, p, at = w[order], p[order], _cut(w[order], parts)
            full = [i for i in range(parts) if at[i] < at[i + 1]]
            out = table(part=full, base=[state["base"]] * len(full), words=[w[at[i]:at[i + 1]].tobytes() for i in full],
                        places=[p[at[i]:at[i + 1]].tobytes() for i in full])
            words.clear(), places.clear()
            state["base"], state["held"] = state["next"], 0
            return out

        def step(rows: dict) -> pa.Table:
            t = M.tokens_of(rows["text"])
            n, size = len(rows["text"]), np.diff(t.first)
            of = np.repeat(np.arange(n), size)
            at = np.minimum(np.searchsorted(frequent, t.hashes), max(0, len(frequent) - 1))
            here = frequent[at] == t.hashes if len(frequent) else np.zeros(len(of), bool)
            value = np.zeros(len(of))
            value[here] = np.log10(counts[at[here]] + SMOOTH)
            classed = M.class_scores(weights, t, classes) - norm[classes[t.kinds]]
            rid = state["next"] + np.arange(n)
            state["next"] += n
            words.append(t.hashes[~here])
            places.append((rid - state["base"])[of[~here]].astype(np.uint32))
            state["held"] += len(words[-1])
            out = table(rid=rid, doc_id=rows["doc_id"], held_out=rows["held_out"], n_tokens=size, known=np.bincount(of, here, n).astype(int),
                        counted=np.bincount(of, value, n), classed=np.bincount(of, classed, n))
            more = flush() if state["held"] > HELD else None
            return pa.concat_tables([out, more]) if more is not None else out

        step.rest = flush
        return step

    return make


def _looked_up(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over the words of one part, for each run of documents (base) and document of it."""
    known = group["counts"].notna()
    vocabulary = group[known]
    w = np.frombuffer(vocabulary["words"].iloc[0], np.uint64) if len(vocabulary) else np.zeros(0, np.uint64)
    c = np.frombuffer(vocabulary["counts"].iloc[0], np.int64) if len(vocabulary) else np.zeros(0, np.int64)
    out = []
    for base, words, places in group[~known][["base", "words", "places"]].itertuples(index=False):
        x, p = np.frombuffer(words, np.uint64), np.frombuffer(places, np.uint32)
        at = np.minimum(np.searchsorted(w, x), max(0, len(w) - 1))
        n = np.where(w[at] == x, c[at], 0) if len(w) else np.zeros(len(x), np.int64)
        some, of = np.unique(p, return_inverse=True)
        out.append((base, some.tobytes(), np.bincount(of, np.log10(n + SMOOTH), len(some)).tobytes(),
                    np.bincount(of, n > 0, len(some)).astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["base", "places", "sums", "known"])


def _gathered(group: pd.DataFrame) -> pd.DataFrame:
    p, s, k = (np.concatenate([np.frombuffer(x, t) for x in group[n]]) for n, t in (("places", np.uint32), ("sums", np.float64), ("known", np.uint32)))
    some, of = np.unique(p, return_inverse=True)
    return pd.DataFrame({"rid": group["base"].iloc[0] + some.astype(np.int64), "more": np.bincount(of, s, len(some)),
                         "more_known": np.bincount(of, k, len(some)).astype(np.int64)})


def op8_lm_scores(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    held = F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    train = docs.filter("NOT held_out")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, size // PART_BYTES)
    # A task hands on tables of fixed size, so it should have read far more than that.
    tasks = max(spark.sparkContext.defaultParallelism, size // PART_BYTES)
    counted = stage(scan(train.coalesce(tasks), ["text"], _counter(parts), "part int, salt int, words binary, counts binary, kinds binary"), "counted")
    vocabulary = stage(_vocabulary(counted), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    met = np.zeros((64, M.KINDS // 64, 2 * M.CONTEXT), np.int64)
    for row in _blocks_summed(counted.filter("part < 0").select(F.col("part").alias("block"), "salt", F.col("words").alias("data")), "i8").collect():
        met[-1 - row["block"]] = np.frombuffer(row["data"], np.int64).reshape(met.shape[1:])
    classes = M.cluster(met.reshape(M.KINDS, -1))
    weights = trained_weights(train, classes, tasks, M.table_bits(total))
    in_class, kinds = _class_totals(vocabulary, classes)
    frequent, counts = _frequent(vocabulary, max(1.0, FREQUENT * total))
    sent = spark.sparkContext.broadcast((weights, classes, frequent, counts, np.log10(in_class + SMOOTH * (kinds + 1))))
    scored = stage(scan(docs, ["doc_id", "held_out", "text"], _scorer(sent, parts), SCORED), "scored")
    rare = scored.filter("part IS NOT NULL").select("part", "base", "words", "places", F.lit(None).cast("binary").alias("counts"))
    known = vocabulary.select("part", F.lit(None).cast("long").alias("base"), "words", F.lit(None).cast("binary").alias("places"), "counts")
    sums = rare.unionAll(known).groupBy("part").applyInPandas(_looked_up, "base long, places binary, sums binary, known binary")
    more = sums.groupBy("base").applyInPandas(_gathered, "rid long, more double, more_known long")
    rows = scored.filter("part IS NULL").join(more, "rid", "left")
    in_all = float(np.log10(total + SMOOTH * (distinct + 1)))
    counted_in = F.col("counted") + F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (counted_in - F.col("n_tokens") * in_all).alias("base_score"),
        (counted_in + F.col("classed")).alias("score"))
