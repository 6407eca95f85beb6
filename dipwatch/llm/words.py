"""Word and shingle hashes of many texts at once, in numpy over the bytes of an Arrow batch.

Texts come as binary columns. All separators used here are ASCII bytes, which never occur inside a multi-byte UTF-8 character, so
work on bytes gives the same words as work on code points. Words are known by a 64-bit hash: a polynomial over the bytes with
random coefficients, modulo 2**64, then mixed. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
SLICE_ROWS = 1024
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(outside: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for first, last in outside:
        table[first:last + 1] = False
    return table


#: Fixed values of the contracts: bytes that are not part of a word.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64, for i up to n at least."""
    size = max(CHUNK_BYTES, 1 << max(0, n).bit_length())
    if size not in _powers:
        def table(base: int) -> np.ndarray:
            out, step = np.ones(1, np.uint64), base
            while len(out) <= size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step & _MASK
            return out
        _powers.clear()
        _powers[size] = table(BASE), table(pow(BASE, -1, 1 << 64))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of a run of texts: ``first[i]:first[i + 1]`` are those of text i; starts and ends point into ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    prefix: np.ndarray
    inverse: np.ndarray

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


def words_of(texts: list[bytes | None], table: np.ndarray = SPACED, lower: bool = True) -> Words:
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = _LOWER[data] if lower else data
    inside = table[data].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    power, inverse = _power_tables(len(data))
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTES[data] * power[:len(data)], out=prefix[1:])
    return Words(data, starts, ends, np.searchsorted(starts, begins), prefix, inverse)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words inside each text and the texts' offsets into them; a text with fewer words, but not none,
    has its whole sequence as one."""
    counts = np.diff(first)
    odd = [np.uint64(pow(BASE, 2 * j + 1, 1 << 64)) for j in range(k)]
    total = len(hashes)
    if total >= k:
        runs = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            runs += mix(hashes[j:total - k + 1 + j] * odd[j])
        runs = mix(runs)
    else:
        runs = np.zeros(0, np.uint64)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(first[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    out = runs[np.minimum(place, max(0, len(runs) - 1))] if len(runs) else np.zeros(len(place), np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h, value = hashes[first[i]:first[i + 1]], 0
        for j, x in enumerate(h):
            value = (value + int(mix(x[None] * odd[j])[0])) & _MASK
        # The length keeps a short sequence apart from the runs of full length.
        out[offsets[i]] = mix(np.array([(value + len(h) * BASE) & _MASK], np.uint64))[0]
    return out, offsets


def chunks(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``size`` bytes, so that the arrays of one span stay small; a longer text is alone."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def scan(docs: DataFrame, columns: list[str], make: Callable, schema: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Run ``make()`` -> function(dict of columns as lists) -> Arrow table or batch or None over chunks of rows of ``docs``,
    of about ``chunk`` bytes of text.

    ``text`` and ``html`` arrive as UTF-8 bytes. ``make`` is called once a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            # Few rows at a time become Python values.
            for at in range(0, batch.num_rows, SLICE_ROWS):
                whole = batch.slice(at, SLICE_ROWS).to_pydict()
                by = next((c for c in ("text", "html") if c in whole), None)
                spans = chunks(whole[by], chunk) if by else [(0, len(whole[columns[0]]))]
                for a, b in spans:
                    if a < b and (out := step({c: v[a:b] for c, v in whole.items()})) is not None:
                        yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        if (last := getattr(step, "rest", None)) and (out := last()) is not None:
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    picked = docs.select(*[F.col(c).cast("binary").alias(c) if c in ("text", "html") else F.col(c) for c in columns])
    return picked.mapInArrow(run, schema)
