"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction has one gate: ``f = sigmoid(E_f[x] + h U_f)``, ``n = tanh(E_n[x] + (f h) U_n)``, ``h' = h + f (n - h)``. Both states
label every byte with a distribution over the languages; a document's probabilities are the means over the bytes of its letters.
Texts are run through in windows of ``WINDOW`` bytes, all windows of a chunk side by side, so whole texts of any length take bounded
memory. Training is by backpropagation through time, with Adam, on windows of a bounded sample (``FIT_ROWS`` documents,
``FIT_WINDOWS`` windows) of the documents outside the held-out quarter that have a language.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if no document has a language; ties
go to the first language by code point; a null id is not held out; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipwatch.llm.toxicity import remainder
from dipwatch.llm.words import _LOWER, scan

FIT_ROWS = 1_500
FIT_WINDOWS = 24_000
WINDOW = 64
HIDDEN = 8
BATCH, STEPS, RATE = 256, 350, 0.02
#: A chunk's states of one step fit in a core's cache.
CHUNK = 1 << 17
UNDETERMINED = "und"
#: Byte 0 fills up windows; a gate that stays shut leaves the state as it is.
SHUT = np.float32(-40)
_LETTER = np.zeros(256, np.float32)
_LETTER[97:123] = 1
_LETTER[128:] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= np.float32(0.5)
    return x


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.languages = languages
        n, h = len(languages), HIDDEN
        self.p = {}
        for d in ("forth", "back"):
            self.p[f"E {d}"] = draw.normal(0, 0.3, (256, 2 * h)).astype(np.float32)
            self.p[f"Uf {d}"] = draw.normal(0, 0.3, (h, h)).astype(np.float32)
            self.p[f"Un {d}"] = draw.normal(0, 0.3, (h, h)).astype(np.float32)
            self.p[f"W {d}"] = draw.normal(0, 0.3, (h, n)).astype(np.float32)
        self.p["b"] = np.zeros(n, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Logits of each step (time x window x language); ``x`` is time x window."""
        e, uf, un, w = (self.p[f"{k} {d}"].copy() for k in ("E", "Uf", "Un", "W"))
        e[0, :HIDDEN] = SHUT
        steps, width = x.shape
        out = np.empty((steps, width, w.shape[1]), np.float32)
        h = np.zeros((width, HIDDEN), np.float32)
        for t in range(steps) if d == "forth" else range(steps - 1, -1, -1):
            a = e[x[t]]
            f = _sigmoid(a[:, :HIDDEN] + h @ uf)
            m = f * h
            n = m @ un
            n += a[:, HIDDEN:]
            np.tanh(n, out=n)
            new = n - h
            new *= f
            new += h
            if keep is not None:
                keep.append((t, h, f, m, n, new))
            h = new
            np.matmul(h, w, out=out[t])
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = self._run(x, "forth")
        z += self._run(x, "back")
        z += self.p["b"]
        return z

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the letters of the windows."""
        kept = {d: [] for d in ("forth", "back")}
        z = self._run(x, "forth", kept["forth"]) + self._run(x, "back", kept["back"]) + self.p["b"]
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        z[:, np.arange(len(y)), y] -= 1
        weight = _LETTER[x]
        z *= (weight / max(1.0, float(weight.sum())))[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["b"] = z.sum((0, 1))
        for d, steps in kept.items():
            uf, un, w = (self.p[f"{k} {d}"] for k in ("Uf", "Un", "W"))
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, f, m, n, new in reversed(steps):
                grads[f"W {d}"] += new.T @ z[t]
                dh = dh + z[t] @ w.T
                dn = dh * f * (1 - n * n)
                dm = dn @ un.T
                df = (dh * (n - h) + dm * h) * f * (1 - f)
                grads[f"Un {d}"] += m.T @ dn
                grads[f"Uf {d}"] += h.T @ df
                np.add.at(grads[f"E {d}"], x[t], np.concatenate([df, dn], 1))
                dh = dh * (1 - f) + dm * f + df @ uf.T
        return grads


def windows(texts: list[bytes | None], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(time x window of lower-cased bytes, filled up with 0; text of each window)."""
    size = np.array([len(t or b"") for t in texts], int)
    count = -(-size // width)
    data = _LOWER[np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)]
    flat = np.zeros(int(count.sum()) * width, np.uint8)
    shift = np.cumsum(count) * width - count * width - (np.cumsum(size) - size)
    flat[np.arange(len(data)) + np.repeat(shift, size)] = data
    return np.ascontiguousarray(flat.reshape(-1, width).T), np.repeat(np.arange(len(texts)), count)


def fit(texts: list[bytes], langs: list[str]) -> Network | None:
    known = sorted(set(langs))
    if not known:
        return None
    net, draw = Network(known), np.random.Generator(np.random.PCG64(5))
    x, of = windows(texts)
    y = np.array([known.index(v) for v in langs], int)[of]
    # As many windows of each language, as far as there are any.
    share = [np.flatnonzero(y == i) for i in range(len(known))]
    share = [draw.permutation(s)[:FIT_WINDOWS // len(known)] for s in share if len(s)]
    if not share:
        return net
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        batch = np.concatenate([draw.choice(s, BATCH // len(share)) for s in share])
        grads = net.gradient(x[:, batch], y[batch])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, texts: list[bytes | None]) -> np.ndarray:
    x, of = windows(texts)
    z = net.logits(x)
    z -= z.max(2, keepdims=True)
    np.exp(z, out=z)
    weight = _LETTER[x]
    z *= (weight / z.sum(2))[:, :, None]
    out = np.zeros((len(texts), len(net.languages)))
    np.add.at(out, of, z.sum(0))
    return out / np.maximum(1e-9, out.sum(1, keepdims=True))


def has_letter(text: bytes | None, lowered: np.ndarray | None = None) -> bool:
    if not text:
        return False
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(remainder(F.col("doc_id"), 4) != 2)
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = picked.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return got.column("text").to_pylist(), got.column("lang").to_pylist()


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def step(rows: dict) -> pa.Table:
            net, n = sent.value, len(rows["doc_id"])
            lang, score = [UNDETERMINED] * n, [0.0] * n
            some = [i for i, t in enumerate(rows["text"]) if has_letter(t)]
            if net is not None and some:
                p = probabilities(net, [rows["text"][i] for i in some])
                for i, best, value in zip(some, p.argmax(1), p.max(1)):
                    lang[i], score[i] = net.languages[best], min(1.0, float(value))
            return pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

        return step

    return scan(docs, ["doc_id", "text"], make, "doc_id long, lang_pred string, score double", CHUNK)


def op9_language(docs: DataFrame) -> DataFrame:
    return predicted(docs, fit(*_sample(docs))).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
