"""Token ids in files of compressed bit planes.

A file holds the ids of many documents, one after another, cut into blocks of ``BLOCK`` ids whatever the documents' ends. A block is
transposed: bit plane b holds bit b of each of its ids (byte plane b: byte b), and each plane is compressed by zstandard on its own.
High planes are nearly constant and shrink to a few bytes. Bytes of a file, all numbers little-endian:

    "IDPL" | planes of every block | index, compressed | u64 start of the index | u64 ids | u32 ids a block | u8 planes | u8 bits | "IDPL"

``planes`` is 8, 16, 24 or 32 for bit planes or 1 to 4 for byte planes, and ``bits`` is 1 or 8. The index holds the compressed size of each
plane of each block (u32), then the number of documents (u64), their lengths in ids (u64), their doc_ids (i64) and a byte each that
is 1 where the doc_id is null. A block is thus found, read and decoded without the others (``ids_between``).

Writing: texts are encoded where they are read; ids, not texts, move to ranges of ascending doc_id; each task streams its range to a
file of its own. Only files named in the manifest, a table of one row a file, belong to the output: what a lost or repeated task leaves
behind is never read. Reading: one task a file, block by block. A file's first position comes from a running sum over the manifest.

Words cut at ASCII white space are encoded one by one and remembered: the tokenizer drops white space, and none of its steps looks
across it, so the ids of a text are those of its words in turn (held against whole texts in the tests). The memory of a worker forgets
all when it is full, which costs work only.

Defined results: null and empty texts have the end id only; null ids come first, rows of one id follow in the order of a hash of
them; repeated rows are all kept; very long texts span blocks; an empty table makes no documents; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipwatch.llm.frames import partitions
from dipwatch.llm.words import SPACED, scan
from dipwatch.session import stage, stage_path

MAGIC = b"IDPL"
BLOCK = 1 << 16
LEVEL = 3
#: Fixed values of op13's contract.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
REMEMBERED = 1 << 20
_IS_MARK, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(string.punctuation.replace("'", "").encode())] = True
_IS_LETTER[list(string.ascii_letters.encode())] = True
#: Lower case letters of Latin-1 beyond a-z.
_ACCENTED = "".join(c for c in map(chr, range(0xDF, 0x100)) if c.islower())
#: Bytes of text that are encoded at once: a word that repeats among them is looked up once.
CHUNK = 1 << 22
_TAIL = struct.Struct("<QQIBB4s")
_LEAST = -(1 << 63)


def split_planes(ids: np.ndarray, planes: int, bits: int) -> list[bytes]:
    """The planes of a block, least significant first."""
    if bits == 8:
        return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, b]).tobytes() for b in range(planes)]
    lanes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes // 8]
    # One row a bit, so that each plane packs on its own.
    each = np.unpackbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little").reshape(planes // 8, -1, 8)
    return [np.packbits(each[b // 8, :, b % 8], bitorder="little").tobytes() for b in range(planes)]


def join_planes(parts: list[bytes], count: int, bits: int) -> np.ndarray:
    out = np.zeros((count, 4), np.uint8)
    for b, part in enumerate(parts):
        if bits == 8:
            out[:, b] = np.frombuffer(part, np.uint8)
        else:
            plane = np.unpackbits(np.frombuffer(part, np.uint8), count=count, bitorder="little")
            out[:, b // 8] |= plane << np.uint8(b % 8)
    return out.reshape(-1).view("<u4")


class PlaneWriter:
    """Streams documents' ids to one file; holds at most a block and a document, and the index."""

    def __init__(self, sink, planes: int = 16, bits: int = 1, block: int = BLOCK):
        if bits == 1 and planes % 8:
            raise ValueError("bit planes come in whole bytes")
        self.sink, self.planes, self.bits, self.block = sink, planes, bits, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.at = len(MAGIC)
        self.sizes: list[int] = []
        self.lengths: list[int] = []
        self.names: list[int | None] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (self.planes * self.bits):
            raise ValueError(f"an id of document {doc_id} has more than {self.planes * self.bits} bits")
        self.names.append(doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            line = np.concatenate(self.held)
            whole = len(line) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(line[i:i + self.block])
            self.held = [line[whole:].copy()]
            self.waiting = len(line) - whole

    def _put(self, ids: np.ndarray) -> None:
        for plane in split_planes(ids, self.planes, self.bits):
            packed = self.zip.compress(plane)
            self.sizes.append(len(packed))
            self.sink.write(packed)
            self.at += len(packed)

    def close(self) -> int:
        """Write the rest and the index; the file's bytes."""
        if self.waiting:
            self._put(np.concatenate(self.held))
        index = b"".join([
            np.array(self.sizes, "<u4").tobytes(), struct.pack("<Q", len(self.names)), np.array(self.lengths, "<u8").tobytes(),
            np.array([0 if n is None else n for n in self.names], "<i8").tobytes(), bytes(n is None for n in self.names)])
        packed = self.zip.compress(index)
        tail = _TAIL.pack(self.at, self.total, self.block, self.planes, self.bits, MAGIC)
        self.sink.write(packed + tail)
        return self.at + len(packed) + len(tail)


class PlaneReader:
    """Reads a file that offers seek and read."""

    def __init__(self, source, size: int):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(size - _TAIL.size)
        at, self.total, self.block, self.planes, self.bits, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        source.seek(at)
        index = self.unzip.decompress(source.read(size - _TAIL.size - at))
        self.blocks = -(-self.total // self.block)
        n = self.blocks * self.planes
        sizes = np.frombuffer(index, "<u4", n).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]) + len(MAGIC)
        docs, = struct.unpack_from("<Q", index, 4 * n)
        at = 4 * n + 8
        self.lengths = np.frombuffer(index, "<u8", docs, at).astype(np.int64)
        names = np.frombuffer(index, "<i8", docs, at + 8 * docs)
        none = np.frombuffer(index, np.uint8, docs, at + 16 * docs)
        self.names = [None if z else int(x) for x, z in zip(names, none)]

    def read_block(self, i: int) -> np.ndarray:
        count = min(self.block, self.total - i * self.block)
        edge = self.offsets[i * self.planes:(i + 1) * self.planes + 1]
        self.source.seek(int(edge[0]))
        data = self.source.read(int(edge[-1] - edge[0]))
        parts = [self.unzip.decompress(data[a - edge[0]:b - edge[0]]) for a, b in zip(edge, edge[1:])]
        return join_planes(parts, count, self.bits)

    def ids_between(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1 of the file, by the blocks that hold them only."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        line = np.concatenate([self.read_block(i) for i in range(first, last + 1)])
        return line[start - first * self.block:end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position in the file, ids) in order; a block at a time and one document are held."""
        held, block, at = np.zeros(0, "<u4"), 0, 0
        for name, n in zip(self.names, self.lengths):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.read_block(block))
                have += len(parts[-1])
                block += 1
            line = np.concatenate(parts) if len(parts) > 1 else held
            yield name, at, line[:n]
            held, at = line[n:], at + int(n)


def opened(path: str, write: bool = False):
    """A file in the shared folder and, for reading, its size."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if not write:
        return where.open_input_file(name), where.get_file_info(name).size
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name), 0


class WordEncoder:
    """Ids of words as little-endian bytes, remembered until ``remembered`` parts are held.

    Texts are brought to lower case in A-Z where the tokenizer does so itself, and ASCII marks at a word's end, after an ASCII letter, are a
    part of their own, as the tokenizer cuts there: fewer different parts are left. All texts of a call are cut together, in numpy, and
    Arrow numbers their different parts, so each is looked up once a call. New parts of small letters of Latin-1 alone, which the
    tokenizer neither changes nor cuts, go to its model at once. The others go through all of it, many as one text with a mark between
    them whose id divides the result. Which of these hold is asked of the tokenizer at the start; where a call's texts have a special
    token, or would have one in lower case, its words are encoded as they are.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(vocabulary), remembered
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, added)) if added else b"(?!)")
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.known: dict[bytes, bytes] = {}
        letters = string.ascii_lowercase
        cut, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        seen = (lambda w: normal.normalize_str(w)) if normal else (lambda w: w)
        piece = (lambda w: [p for p, _ in cut.pre_tokenize_str(w)]) if cut is not None else (lambda w: [])
        # What the model gets for each letter; words of these letters alone can go to it at once.
        self.letters = {ord(x): p[0] for x in letters + _ACCENTED if seen(x) == x and len(p := piece(x)) == 1}
        known = list(map(chr, self.letters))
        pairs = [x + y for x in known for y in known] + ["".join(known)]
        self.direct = bool(known) and all(seen(w) == w and piece(w) == [w.translate(self.letters)] for w in pairs)
        self.simple = re.compile(f"[{''.join(known)}]+") if self.direct else None
        self.lowers = all(seen(x.upper()) == x for x in letters)
        self.parted = cut is not None and all(
            piece(seen(f"q{m}")) == ["q", seen(m)] for m in string.punctuation if m != "'")
        self.mark = next((m for m in "~^|@" if len(self._ids([m])[0]) == 1), None) if cut is not None else None
        self.mark_id = self._ids([self.mark])[0][0] if self.mark else None

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _bytes(self, ids) -> bytes:
        made = array(self.code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _whole(self, words: list[bytes]) -> Iterator[bytes]:
        return map(self._bytes, self._ids([w.decode("utf-8", "replace") for w in words]))

    def _together(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words without the mark."""
        text = f" {self.mark} ".join([w.decode("utf-8", "replace") for w in words])
        ids = np.array(self._ids([text])[0], self.kind)
        ends = np.flatnonzero(ids == self.mark_id)
        if len(ends) != len(words) - 1:
            return self._whole(words)
        data, size = ids.tobytes(), ids.itemsize
        ends = (ends * size).tolist()
        return (data[a:b] for a, b in zip([0] + [e + size for e in ends], ends + [len(data)]))

    def learn(self, parts: list[bytes], whole: bool = False) -> None:
        """Remember the ids of parts that are not known; ``whole``: encoded one by one, by all of the tokenizer."""
        known = self.known
        if not whole and self.direct:
            model, pack, letters, simple, rest = self.tokenizer.model.tokenize, self._bytes, self.letters, self.simple.fullmatch, []
            for x in parts:
                if simple(w := x.decode("utf-8", "replace")):
                    known[x] = pack([t.id for t in model(w.translate(letters))])
                else:
                    rest.append(x)
            parts = rest
        if not whole and self.mark is not None:
            mark = self.mark.encode()
            rest = [x for x in parts if mark not in x]
            for i in range(0, len(rest), 2048):
                known.update(zip(rest[i:i + 2048], self._together(rest[i:i + 2048])))
            parts = [x for x in parts if mark in x]
        for i in range(0, len(parts), 2048):
            known.update(zip(parts[i:i + 2048], self._whole(parts[i:i + 2048])))

    def _parts(self, data: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of ``data``, whose last byte is white space; ``cut``: without the marks at a word's end, which
        follow as parts."""
        inside = SPACED[data]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if cut:
            edge = np.diff(_IS_MARK[data].view(np.int8), prepend=np.int8(0))
            at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            at = at[~inside[to] & (at > 0) & _IS_LETTER[data[at - 1]]]
            # Each cut ends a part and starts the next, so both stay in step.
            starts, ends = (np.sort(np.concatenate([x, at]), kind="stable") for x in (starts, ends))
        return starts, ends

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        texts = [t or b"" for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        line = b"\n".join(texts) + b"\n"
        low = line.lower() if self.lowers else line
        # Nothing is changed or cut near a special token, nor where lower case would make one.
        special = any(self.special.search(x) for x in {line, low})
        data = np.frombuffer(line if special else low, np.uint8)
        starts, ends = self._parts(data, self.parted and not special)
        if not len(starts):
            return [b""] * len(texts)
        size = pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, size, pa.py_buffer(data[SPACED[data]])]).dictionary_encode()
        # Far faster than to_pylist.
        different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, different))
        if None in ids:
            self.learn([w for w, x in zip(different, ids) if x is None], special)
            ids = list(map(self.known.get, different))
        made = pa.array(ids, pa.large_binary()).take(parts.indices)
        _, size, packed = made.buffers()
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        at = np.frombuffer(size, np.int64)[first].tolist()
        packed = memoryview(packed) if packed is not None else b""
        return [bytes(packed[a:b]) for a, b in zip(at, at[1:])]


#: A word encoder a worker process and vocabulary: what one task learnt serves the next.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(vocabulary: str, remembered: int) -> WordEncoder:
    if (vocabulary, remembered) not in _ENCODERS:
        _ENCODERS[vocabulary, remembered] = WordEncoder(vocabulary, remembered)
    return _ENCODERS[vocabulary, remembered]


def _part(doc_ids: list[int | None], ties: list[int], bounds: np.ndarray) -> np.ndarray:
    """Ranges of ascending doc_id; an id that is a bound, perhaps of several ranges, is dealt to those beside it by tie."""
    keys = np.array([_LEAST if d is None else d for d in doc_ids], np.int64)
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    share = np.array(ties, np.int64) / 2.0 ** 64 + 0.5
    return (low + np.minimum(high - low, (share * (high - low + 1)).astype(np.int64))).astype(np.int32)


def _encoded(vocabulary: str, end: int | None, bounds: np.ndarray, remembered: int = REMEMBERED):
    """make() for ``scan``: rows of ``encoded``."""
    def make():
        encoder = _encoder(vocabulary, remembered)
        tail = b"" if end is None else encoder._bytes([end])
        width = np.dtype(encoder.kind).itemsize

        def step(rows: dict) -> pa.RecordBatch:
            out = [ids + tail for ids in encoder.texts(rows["text"])]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(_part(rows["doc_id"], rows["tie"], bounds)), pa.array(rows["tie"], pa.int64()),
                 pa.array([width] * len(out), pa.int8()), pa.array(out, pa.binary())], ["doc_id", "part", "tie", "width", "ids"])

        return step

    return make


def encoded(docs: DataFrame, vocabulary: str, end: int | None = END_ID) -> DataFrame:
    """doc_id, ids (binary, little-endian, of ``width`` bytes each), the range of doc_ids that a row is in (part) and its order among
    rows of one id (tie). ``vocabulary`` is a tokenizer file that every worker reaches.

    Ranges have about as many rows each; only their bounds, a number each, pass through the driver.
    """
    count = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.monotonically_increasing_id()).alias("tie"), "text")
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"))
    found = keys.approxQuantile("key", [i / count for i in range(1, count)], 0.2 / count) if count > 1 else []
    bounds = np.array([max(_LEAST, min(x, 2.0 ** 63 - 1024)) for x in found], np.float64).astype(np.int64)
    return scan(rows, ["doc_id", "tie", "text"], _encoded(vocabulary, end, bounds),
                "doc_id long, part int, tie long, width tinyint, ids binary", CHUNK)


def _write(batches: Iterator[pa.RecordBatch], path: str, planes: int, bits: int, block: int) -> Iterator[pa.RecordBatch]:
    writer, part, name = None, 0, ""
    for batch in batches:
        if writer is None and batch.num_rows:
            part, name = batch.column("part")[0].as_py(), f"{path}/{uuid.uuid4().hex}.planes"
            sink, _ = opened(name, write=True)
            writer = PlaneWriter(sink, planes, bits, block)
        for doc_id, width, ids in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids")):
            writer.add(doc_id, np.frombuffer(ids.as_buffer(), f"<u{width}"))
    if writer is not None:
        size = writer.close()
        sink.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [name], "docs": [len(writer.names)], "ids": [writer.total], "bytes": [size]},
            pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))


def write_planes(ids: DataFrame, path: str, planes: int = 16, bits: int = 1, block: int = BLOCK) -> DataFrame:
    """Write the rows of ``encoded`` to files under ``path`` in ascending doc_id order and return the manifest:
    part, file, docs, ids, bytes and ``base``, the number of ids in the files before."""
    ranged = ids.repartitionById(partitions(ids.sparkSession), "part").sortWithinPartitions(
        "part", F.asc_nulls_first("doc_id"), "tie")
    files = stage(ranged.mapInArrow(partial(_write, path=path, planes=planes, bits=bits, block=block),
                                    "part int, file string, docs long, ids long, bytes long"), "manifest")
    # One row a file, so the running sum is short.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], whole: bool, rows: int = 1024, held_ids: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    def table(found: list) -> pa.RecordBatch:
        columns = list(zip(*found))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if whole else pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])

    for batch in batches:
        for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
            source, size = opened(name)
            found, held = [], 0
            with source:
                for doc_id, at, ids in PlaneReader(source, size).documents():
                    data = ids.tobytes()
                    found.append((doc_id, base + at, len(ids), data if whole else zlib.crc32(data)))
                    held += len(ids)
                    if len(found) >= rows or held >= held_ids:
                        yield table(found)
                        found, held = [], 0
            if found:
                yield table(found)


def read_planes(manifest: DataFrame, whole: bool = True) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens and their ids (``whole``) or the checksum of those."""
    files = manifest.select("file", "base").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(partial(_read, whole=whole),
                            "doc_id long, start long, n_tokens long, " + ("ids binary" if whole else "ids_crc32 long"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op13_token_planes(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark: SparkSession = docs.sparkSession
    manifest = write_planes(encoded(docs, vocabulary or default_vocabulary()), path or stage_path(spark, "planes"))
    return read_planes(manifest, whole=False)
