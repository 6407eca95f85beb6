"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

A document's set holds the hashes of its distinct shingles of ``words`` words. Documents link when
``100 * intersection >= percent * union``, thus when they differ in at most (a + b) * (100 - percent) / (100 + percent) shingles. Sizes
are cut into overlapping bands in which any linked pair meets; a band has a fixed number of segments of the hash range, more than such
a pair can differ in, so a linked pair agrees in all of some segment.
The contents of a segment name a tile: (band, segment, contents). Linked pairs agree in more than one segment, so each document leaves
its fullest tiles, one less than it has to share: phrases that many texts hold make no large tiles of unrelated documents. Only documents of one tile are compared: first by a bitmap of their
hashes, whose differing bits bound the overlap from above, then by intersecting the sorted arrays. A bitmap of fixed size is full for
long documents, so those have a second one of two to four bits a shingle, which is moved for pairs that passed the first.

A tile is not expanded into pairs. One member (hub) is compared with the others, but for those that are in its component already; tiles whose other members are then in one component
are done. In the rest, members of different components are joined under the bitmap's bound as a condition, so only pairs that may
link leave the join, and nearly all from one of their tiles only. Every pair of a tile is then either compared or inside one component, so no link that joins components is lost.
Equal sets are one node throughout, so exact copies make no pairs.

Segments that are empty would make large tiles of unrelated documents. Each band has further segments (``spare``); a document with no
more empty segments than that leaves them out, and still shares a segment that is not empty with each of its links. The lower the
percentage, the more segments there are for a size and the fewer shingles in each, so ``spare`` grows with them.

Defined results: null and empty texts have the empty set and link with nothing; a null id forms no component name, so its component
is that of its links or null; repeated rows have equal sets and so one component; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from dipwatch.llm.components import components
from dipwatch.llm.frames import split_by_ids
from dipwatch.llm.words import SLICE_ROWS, chunks, mix, scan, shingles, words_of
from dipwatch.session import stage

#: Fixed values of op5's contract: words a shingle, and of 100 parts of the union those that links have in common at least.
WORDS = 3
PERCENT = 90
#: Spare segments from ``PERCENT`` up.
SPARE = 2
GROWTH = 1.5
BITMAP = 1024
#: Tiles of a node before one that tell whether a pair has met: most pairs of near copies share nearly all.
EARLIER = 8


def differences(a: int, b: int, percent: int = PERCENT) -> int:
    """Most shingles in which two linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache
def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(least size, most, segments, spare); sizes below the first can only link with equal sets or with those in it."""
    low = next(n for n in range(1, 1000) if differences(n, n + 1, percent)) + 1
    out = []
    while low <= largest or not out:
        high = max(low, int(low * GROWTH) - 1)
        differ = differences(high, high, percent)
        spare = SPARE + differ * max(0, PERCENT - percent) // 80
        out.append((low, high, differ + 1 + spare, spare))
        low = high + 1
    return out


def banded_tiles(array: np.ndarray, sums: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """(need, names of tiles) of a sorted set for each band it is in; ``sums`` are running sums of the mixed hashes, from 0.

    A set that links with this one and meets it in the band shares ``need`` of the names at least: the segments less the shingles in
    which the two can differ, less those that are empty in both and left out.
    """
    n, out = len(array), []
    for index, (low, high, count, spare) in enumerate(bands(1 << 40, percent)):
        # The smaller of a linked pair may lie below the band of the larger.
        if n * 100 < low * percent:
            break
        if n > high:
            continue
        edge = (np.arange(count + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(count)
        at = np.searchsorted(array >> np.uint64(32), edge)
        at[-1] = n
        content = sums[at[1:]] - sums[at[:-1]]
        full = at[1:] > at[:-1]
        names = mix(content + mix(np.arange(count, dtype=np.uint64) + np.uint64((index + 1) << 40)))
        empty = count - int(full.sum())
        need = count - differences(n, min(high, n * 100 // percent), percent) - min(empty, spare)
        out.append((need, names[full] if empty <= spare else names))
    return out


def tiles(array: np.ndarray, sums: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Names of the tiles of a sorted set, of all bands."""
    found = banded_tiles(array, sums, percent)
    return np.concatenate([names for _, names in found]) if found else np.zeros(0, np.uint64)


def _sets(texts: list, words: int) -> list[np.ndarray]:
    w = words_of(texts)
    values, offsets = shingles(w.hashes(), w.first, words)
    return [np.unique(values[offsets[i]:offsets[i + 1]]) for i in range(len(texts))]


def _name(array: np.ndarray, total: int) -> int:
    """Node of a set: a hash of all of it."""
    return int(mix(np.array([total], np.uint64) + np.uint64(len(array)))[0])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _banded(rows: list[list[tuple[int, np.ndarray]]]) -> pa.ListArray:
    """Lists of (need, names)."""
    flat = [band for row in rows for band in row]
    each = pa.StructArray.from_arrays([pa.array([need for need, _ in flat], pa.int32()), _lists([names for _, names in flat])], ["need", "names"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(row) for row in rows]).astype(np.int32)), each)


def _wide(array: np.ndarray) -> bytes:
    """Bitmap of two to four bits a shingle; empty where that of fixed size does."""
    if len(array) <= BITMAP // 2:
        return b""
    bits = np.zeros(1 << (2 * len(array) - 1).bit_length(), bool)
    bits[(array & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _describe(words: int, percent: int):
    def step(rows: dict) -> pa.Table:
        n, nodes, bitmaps, wide, names = [], [], [], [], []
        for array in _sets(rows["text"], words):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(array))])
            n.append(len(array))
            nodes.append(_name(array, int(sums[-1])) if len(array) else 0)
            bits = np.zeros(BITMAP, bool)
            bits[(array & np.uint64(BITMAP - 1)).astype(np.int64)] = True
            found = banded_tiles(array, sums, percent)
            bitmaps.append(np.packbits(bits).view(np.uint64) if len(found) else np.zeros(0, np.uint64))
            wide.append(_wide(array) if len(found) else b"")
            names.append(found)
        return pa.table({
            "doc_id": pa.array(rows["doc_id"], pa.int64()), "n": pa.array(n, pa.int64()),
            "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "bitmap": _lists(bitmaps), "wide": pa.array(wide, pa.binary()),
            "tiles": _banded(names)})

    return step


def _arrays(words: int):
    def step(rows: dict) -> pa.Table:
        sets = _sets(rows["text"], words)
        nodes = [_name(s, int(mix(s).sum(dtype=np.uint64))) if len(s) else 0 for s in sets]
        return pa.table({"node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "items": pa.array([s.tobytes() for s in sets], pa.binary())})

    return step


def _exact(batches, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x_items"), batch.column("y_items")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            at = np.searchsorted(x, y)
            common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(x: str, y: str):
    """Bits in which two bitmaps differ; the bitmaps are arrays of longs."""
    out = F.lit(0)
    for i in range(BITMAP // 64):
        out = out + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return out


def _near(percent: int):
    """Bitmaps and sizes (nx, bx; ny, by) allow the overlap that a link needs."""
    bound = F.shiftright(F.col("nx") + F.col("ny") - _apart("bx", "by"), 1)
    return F.lit(100) * bound >= F.lit(percent) * (F.col("nx") + F.col("ny") - bound)


def _may_link(x: bytes | None, y: bytes | None, total: int, percent: int) -> bool:
    """Wide bitmaps of sets of ``total`` shingles together allow the overlap that a link needs; without two of them nothing is said."""
    if not x or not y:
        return True
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) != len(y):
        # Halves of the larger fall together, as the smaller has one low bit of the hash less.
        if len(x) > len(y):
            x = x[:len(x) // 2] | x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] | y[len(y) // 2:]
    bound = (total - int(np.bitwise_count(x ^ y).sum())) // 2
    return 100 * bound >= percent * (total - bound)


def _closer(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` that the wide bitmaps of their nodes do not rule out."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("wx", "wy", "total")]
            keep = [_may_link(x, y, total, percent) for x, y, total in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = nodes.filter("length(wide) > 0")
    x = wide.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("wide").alias("wx"))
    y = wide.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("wide").alias("wy"))
    both = pairs.join(y, "b", "left").join(x, "a", "left").select("a", "b", "wx", "wy", (F.col("nx") + F.col("ny")).alias("total"))
    return both.mapInArrow(run, "a long, b long")


def _nodes(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Size, bitmaps and one document of each node of ``wanted``."""
    known = sets.filter(F.size("bitmap") > 0).join(wanted, "node", "left_semi")
    return known.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "bitmap", "wide")])


def _linked(near: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) of ``near`` that link, by their sorted arrays; only documents in ``near`` are read for them."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = _nodes(sets, wanted).select("doc_id")
    likely, _ = split_by_ids(docs, ids)
    arrays = scan(likely, ["doc_id", "text"], partial(_arrays, words), "node long, items binary")
    arrays = stage(arrays.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "arrays")
    # A hub may be in very many pairs: its array is copied to a few hundred pairs each.
    hubs = near.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("copies"))
    dealt = near.join(hubs, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    dealt = dealt.select("a", "b", "part").join(arrays.select(F.col("node").alias("b"), F.col("items").alias("y_items")), "b")
    copied = arrays.join(hubs, arrays["node"] == hubs["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.col("items").alias("x_items"))
    return dealt.join(copied, ["a", "part"]).select("a", "b", "x_items", "y_items").mapInArrow(
        partial(_exact, percent=percent), "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        *members.columns, F.coalesce("label", "node").alias("label"))


def _one_a_node(sets: DataFrame) -> DataFrame:
    """node, tiles: one row for each node with tiles. Only rows whose node may occur twice, by a bitmap of bounded size, are moved."""
    tiled = sets.filter(F.size("tiles") > 0).select("node", "tiles")
    twice = tiled.groupBy("node").count().filter("count > 1").select("node")
    likely, clear = split_by_ids(tiled, twice, "node")
    return clear.unionAll(likely.groupBy("node").agg(F.first("tiles").alias("tiles")))


def _tiles_and_hubs(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, node) of the tiles by which each node has to be found, and the (tile, hub) of those with two such nodes at least.

    Tiles move once: a window over a tile, which streams and spills, tells its number of nodes. Links share ``need`` tiles of a band, so
    a node leaves its fullest ``need - 1`` there: the emptiest of the shared ones has ``need - 1`` fuller ones beside it, and neither
    side leaves it. The hub is the member whose tiles are fullest together: among near copies, the text that the others derive from.
    """
    banded = _one_a_node(sets).select("node", F.posexplode("tiles").alias("band", "of"))
    named = banded.select("node", "band", F.col("of.need").alias("need"), F.explode("of.names").alias("tile"))
    shared = named.withColumn("c", F.count("*").over(Window.partitionBy("tile"))).filter("c > 1")
    # One order for all nodes: by the tile's number of nodes, then by its name.
    fullest = Window.partitionBy("node", "band").orderBy(F.desc("c"), F.desc("tile"))
    ranked = shared.withColumns({"s": F.sum("c").over(Window.partitionBy("node")), "rank": F.row_number().over(fullest)})
    members = stage(ranked.filter("rank >= need").select("tile", "node", "s"), "members")
    hubs = members.groupBy("tile").agg(F.max_by("node", F.struct("s", "node")).alias("hub"), F.count("*").alias("c"))
    return members.select("tile", "node"), stage(hubs.filter("c > 1").select("tile", "hub"), "hubs")


def joined_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node of each document), and the components' (node, label) for nodes that are not their own label."""
    sets = stage(scan(docs, ["doc_id", "text"], partial(_describe, words, percent),
                      "doc_id long, n long, node long, bitmap array<long>, wide binary, tiles array<struct<need:int,names:array<long>>>"), "sets")
    members, hubs = _tiles_and_hubs(sets)
    others = members.join(hubs, "tile").filter("node <> hub")
    pairs = stage(others.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    nodes = stage(_nodes(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "nodes")
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("bitmap").alias("bx"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("bitmap").alias("by"))
    near = pairs.join(y, "b").join(x, (pairs["a"] == x["a"]) & _near(percent)).select(pairs["a"], "b")
    near = stage(_closer(near, nodes, percent), "near")
    # Arrays are large: each node meets its most frequent hub first, then only hubs whose component it has not joined by that.
    degree = near.groupBy("a").agg(F.count("*").alias("degree"))
    best = stage(near.join(degree, "a").groupBy("b").agg(F.max_by("a", F.struct("degree", "a")).alias("a")).select("a", "b"), "best")
    links = stage(_linked(best, sets, docs, words, percent), "links")
    labels = components(links)
    left = stage(_across(near.join(best, ["a", "b"], "left_anti"), labels), "left")
    if not left.isEmpty():
        links = stage(links.unionAll(_linked(left, sets, docs, words, percent)), "links")
        labels = components(links)
    rest = stage(_open_tiles(others.select("tile", "node"), labels), "rest")
    if rest.isEmpty():
        return sets.select("doc_id", "n", "node"), labels
    # All that is left to compare; a pair leaves the join only if its bitmaps may hold a link.
    rest = _with_earlier(rest.join(_distinct_tiles(rest), "tile", "left_semi")).join(nodes.select("node", "n", "bitmap"), "node")
    p = rest.select("tile", F.col("node").alias("a"), F.col("label").alias("la"), F.col("earlier").alias("ex"), F.col("n").alias("nx"),
                    F.col("bitmap").alias("bx"))
    q = rest.select("tile", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("earlier").alias("ey"), F.col("n").alias("ny"),
                    F.col("bitmap").alias("by"))
    close = p.join(q, (p["tile"] == q["tile"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
                   & ~F.arrays_overlap("ex", "ey") & _near(percent))
    close = stage(_closer(close.select("a", "b").distinct(), nodes, percent), "close")
    more = _linked(close, sets, docs, words, percent)
    return sets.select("doc_id", "n", "node"), components(stage(links.unionAll(more), "links"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    x = labels.select(F.col("node").alias("_x"), F.col("label").alias("_lx"))
    y = labels.select(F.col("node").alias("_y"), F.col("label").alias("_ly"))
    out = pairs.join(x, F.col("a") == F.col("_x"), "left").join(y, F.col("b") == F.col("_y"), "left")
    return out.filter(F.coalesce("_lx", "a") != F.coalesce("_ly", "b")).select("a", "b")


def _open_tiles(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = _labelled(members, labels)
    mixed = known.groupBy("tile").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("tile")
    return known.join(mixed, "tile")


def _distinct_tiles(members: DataFrame) -> DataFrame:
    same = members.groupBy("tile").agg(F.bit_xor(F.xxhash64("node")).alias("s"), F.count("*").alias("c"))
    return same.groupBy("s", "c").agg(F.min("tile").alias("tile")).select("tile")


def _with_earlier(members: DataFrame) -> DataFrame:
    """Add ``earlier``: the node's tiles just before this one, by name. A pair that has one of them in common meets there too, so it need
    not leave the join here; the first tile that a pair has in common has no such one."""
    before = Window.partitionBy("node").orderBy("tile").rowsBetween(-EARLIER, -1)
    return members.withColumn("earlier", F.collect_list("tile").over(before))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows, labels = joined_sets(docs, words, percent)
    rows = rows.join(labels.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left").select(
        "doc_id", "n", F.coalesce("label", "node").alias("label"))
    rows = stage(rows, "labelled")
    least = rows.filter("n > 0").groupBy(F.col("label").alias("_l")).agg(F.min("doc_id").alias("_least"))
    return rows.join(least, (F.col("label") == F.col("_l")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def op5_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


def _with_nodes(docs: DataFrame, words: int) -> DataFrame:
    """row (all columns of ``docs``), size and node of its set."""
    def run(batches):
        for batch in batches:
            n, nodes = [], []
            for at in range(0, batch.num_rows, SLICE_ROWS):
                texts = batch.column("text").slice(at, SLICE_ROWS).to_pylist()
                for a, b in chunks(texts):
                    for array in _sets(texts[a:b], words):
                        n.append(len(array))
                        nodes.append(_name(array, int(mix(array).sum(dtype=np.uint64))) if len(array) else 0)
            row = batch.schema.field("row")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64))],
                schema=pa.schema([row, pa.field("n", pa.int64()), pa.field("node", pa.int64())]))

    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"))
    kind = whole.schema["row"].dataType
    return whole.mapInArrow(run, StructType().add("row", kind).add("n", "long").add("node", "long"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of the least id, nulls last, then of the least hash of its text, then of its columns.

    Rows without words are in no component and stay; of those that agree in every column one stays. Where ids are unique, rows are
    decided on by id; rows that share an id or have none are named by their sets once more and decided on one by one.
    """
    sets, labels = joined_sets(docs, words, percent)
    found = stage(_labelled(sets, labels), "components")
    least = stage(found.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    gone = found.filter("n > 0").join(least, "label").filter("doc_id <> least").select("doc_id", F.lit(True).alias("_gone"))
    odd = found.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id", F.lit(False).alias("_gone"))
    marked = stage(gone.unionAll(odd).groupBy("doc_id").agg(F.min("_gone").alias("_gone")), "gone")
    likely, clear = split_by_ids(docs, marked)
    # The mark's columns are kept apart from those of the rows.
    mark = marked.select(F.struct("doc_id", "_gone").alias("_mark"))
    judged = likely.select(F.struct("*").alias("row")).join(mark, F.col("row.doc_id").eqNullSafe(F.col("_mark.doc_id")), "left")
    plain = judged.filter("_mark IS NULL").select("row.*")
    named = stage(_with_nodes(judged.filter("NOT _mark._gone").select("row.*"), words), "odd")
    label = found.filter("n > 0").select("node", "label").distinct()
    first = named.filter("n > 0").join(label, "node").join(least, "label").filter(F.col("row.doc_id").eqNullSafe(F.col("least")))
    order = F.struct(F.xxhash64("row.text"), F.to_json("row"))
    kept = first.groupBy("label").agg(F.min_by("row", order).alias("row")).select("row.*")
    wordless = named.filter("n = 0").select("row.*").distinct()
    return clear.unionAll(plain).unionAll(kept).unionAll(wordless)
