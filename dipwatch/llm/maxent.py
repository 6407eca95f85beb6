"""Numpy side of the class-factored maximum-entropy language model: tokens, classes, hashed features, updates, scores.

P(word | history) = P(class | history) * P(word | class). The first factor is a softmax over hashed features of the history: the last
word, the last two, the words two and three back (skips), and the classes of the last three. The second is the word's smoothed share
of its class. A class is a cluster of word kinds (a hash of a word's first two and last three bytes) that stand in like contexts, so
every word, seen or not, has one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from dipwatch.llm.words import words_of

KINDS = 1 << 13
CONTEXT = 32
CLASSES = 16
#: Table rows at least, as a power of two; beyond, one for so many training tokens at most.
TABLE_BITS, TOKENS_A_ROW = 16, 4096
FEATURES = 5
BATCH = 8192
RATE = 0.25
END = np.uint64(0x51ED270B7C6E9D13)
_ODD = [np.uint64(x | 1) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]


@dataclass
class Tokens:
    """Words of a run of texts, each text closed by the end token; ``first[i]:first[i + 1]`` are those of text i."""

    hashes: np.ndarray
    kinds: np.ndarray
    first: np.ndarray
    #: Place of each token in its text.
    place: np.ndarray


def tokens_of(texts: list[bytes | None]) -> Tokens:
    w = words_of(texts)
    n = len(texts)
    first = w.first + np.arange(n + 1)
    at = np.arange(len(w.starts)) + np.repeat(np.arange(n), np.diff(w.first))
    hashes, kinds = np.full(first[-1], END), np.zeros(first[-1], np.int64)
    hashes[at] = w.hashes()
    head, tail = w.hashes(ends=np.minimum(w.starts + 2, w.ends)), w.hashes(starts=np.maximum(w.ends - 3, w.starts))
    kinds[at] = 1 + ((head * _ODD[0] ^ tail * _ODD[1]) >> np.uint64(40)).astype(np.int64) % (KINDS - 1)
    return Tokens(hashes, kinds, first, np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first)))


def _dimension(kinds: np.ndarray) -> np.ndarray:
    return (kinds.astype(np.uint64) * _ODD[2] >> np.uint64(59)).astype(np.int64) % CONTEXT


def contexts(t: Tokens) -> np.ndarray:
    """Counts of each kind with the hashed kinds before and after it."""
    out = np.zeros(KINDS * 2 * CONTEXT, np.int64)
    inner = np.flatnonzero(t.place > 0)
    left, right = t.kinds[inner - 1], t.kinds[inner]
    out += np.bincount(right * 2 * CONTEXT + _dimension(left), minlength=len(out))
    out += np.bincount(left * 2 * CONTEXT + CONTEXT + _dimension(right), minlength=len(out))
    return out.reshape(KINDS, 2 * CONTEXT)


def cluster(counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Class of each kind, by weighted k-means over square roots of context shares; kinds never seen are in class 0."""
    weight = counts.sum(1).astype(float)
    points = np.sqrt((counts + 0.5) / (weight[:, None] + counts.shape[1] * 0.5))
    order = np.argsort(-weight, kind="stable")
    # Seeds: the most frequent kinds, each far from those before it.
    centres = [points[order[0]]]
    for _ in range(CLASSES - 1):
        far = np.min([((points[order[:512]] - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[order[int(np.argmax(far * weight[order[:512]]))]])
    centres = np.array(centres)
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1)
        for k in range(CLASSES):
            w = weight * (near == k)
            if w.sum():
                centres[k] = (points * w[:, None]).sum(0) / w.sum()
    near[weight == 0] = 0
    return near.astype(np.int64)


def table_bits(tokens: int) -> int:
    """Size of the table, as a power of two, for so many training tokens."""
    return max(TABLE_BITS, (max(0, tokens - 1) // TOKENS_A_ROW).bit_length())


def history(t: Tokens, classes: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Rows of each token's features in a table of ``2 ** bits``, FEATURES x tokens. Places before the text hold zeros."""
    n = len(t.hashes)
    own = classes[t.kinds]

    def back(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, values.dtype)
        out[by:] = values[:-by] if n > by else values[:0]
        out[t.place < by] = 0
        return out

    h1, h2, h3 = (back(t.hashes, i) for i in (1, 2, 3))
    c = sum((back(own, i) + (t.place >= i)).astype(np.uint64) << np.uint64(6 * i) for i in (1, 2, 3))
    shift = np.uint64(64 - bits)
    return np.stack([
        h1 * _ODD[0] + _ODD[5] >> shift, (h1 * _ODD[1] ^ h2 * _ODD[2]) * _ODD[5] >> shift, h2 * _ODD[3] + _ODD[4] >> shift,
        h3 * _ODD[4] + _ODD[3] >> shift, (c + np.uint64(1)) * _ODD[0] * _ODD[2] >> shift]).astype(np.int64)


def _bits(weights: np.ndarray) -> int:
    return len(weights).bit_length() - 1


def log_shares(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history), tokens x classes."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z = z + weights[r]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def update(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, t: Tokens, classes: np.ndarray) -> None:
    """Adaptive gradient steps over mini-batches of the tokens, in place."""
    rows, own = history(t, classes, _bits(weights)), classes[t.kinds]
    for a in range(0, len(own), BATCH):
        part, y = rows[:, a:a + BATCH], own[a:a + BATCH]
        g = np.exp(log_shares(weights, part))
        g[np.arange(len(y)), y] -= 1
        for r in part:
            # Sixteen bits are sorted by radix.
            order = np.argsort(r.astype(np.uint16) if len(weights) <= 1 << 16 else r, kind="stable")
            at = r[order]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            use = at[begin]
            grad = np.add.reduceat(g[order], begin, axis=0) / np.sqrt(np.diff(np.append(begin, len(at))))[:, None]
            squares[use] += grad * grad
            weights[use] -= np.float32(RATE) * grad / (np.sqrt(squares[use]) + np.float32(1e-3))
            touched[use] = True


def class_scores(weights: np.ndarray, t: Tokens, classes: np.ndarray) -> np.ndarray:
    """log10 P(class of the token | history) of each token."""
    rows, own = history(t, classes, _bits(weights)), classes[t.kinds]
    out = np.empty(len(own))
    for a in range(0, len(own), BATCH):
        part = log_shares(weights, rows[:, a:a + BATCH])
        out[a:a + BATCH] = part[np.arange(len(part)), own[a:a + BATCH]]
    return out / np.log(10)
