from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dipwatch.llm import token_files as T
from tests.llm import data


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(T.default_vocabulary())


def _whole(tokenizer, text: str | None) -> list[int]:
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [T.END_ID]


def _expected(tokenizer, rows):
    """Brute force: whole texts one after another in ascending id order."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array(_whole(tokenizer, text), "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits, planes", [(1, 16), (1, 8), (1, 32), (8, 1), (8, 2), (8, 3), (8, 4)])
@pytest.mark.parametrize("block", [8, 1000])
def test_planes_round_trip(bits, planes, block):
    draw = np.random.default_rng(planes * bits + block)
    top = 1 << min(32, planes * bits)
    docs = [(i if i % 3 else None, draw.integers(0, top, n, dtype=np.uint64).astype("<u4")) for i, n in enumerate([0, 1, 7, 8, 9, 0, 2500, 3])]
    sink = io.BytesIO()
    writer = T.PlaneWriter(sink, planes, bits, block)
    for name, ids in docs:
        writer.add(name, ids)
    size = writer.close()
    assert size == len(sink.getvalue())
    reader = T.PlaneReader(sink, size)
    got = list(reader.documents())
    assert [g[0] for g in got] == [d[0] for d in docs]
    assert all((g[2] == d[1]).all() and len(g[2]) == len(d[1]) for g, d in zip(got, docs))
    line = np.concatenate([d[1] for d in docs])
    for start, end in [(0, 0), (0, 1), (5, 30), (len(line) - 3, len(line)), (0, len(line)), (999, 1001)]:
        assert (reader.ids_between(start, end) == line[start:end]).all()


def test_planes_by_hand():
    # Bit planes of 1, 2, 3, 0 are 1010.. and 0110.., least bit first in a byte.
    assert T.split_planes(np.array([1, 2, 3, 0], "<u4"), 8, 1)[:3] == [bytes([0b0101]), bytes([0b0110]), bytes([0])]
    assert T.split_planes(np.array([0x0201, 0x0403], "<u4"), 2, 8) == [b"\x01\x03", b"\x02\x04"]


def test_ids_beyond_the_planes_are_refused():
    with pytest.raises(ValueError):
        T.PlaneWriter(io.BytesIO(), 16, 1).add(1, np.array([1 << 16], "<u4"))
    with pytest.raises(ValueError):
        T.PlaneWriter(io.BytesIO(), 12, 1)
    with pytest.raises(ValueError):
        T.PlaneReader(io.BytesIO(b"x" * 64), 64)


def test_words_in_turn_are_the_whole_text(tokenizer):
    draw = random.Random(5)
    parts = ["It's", "we'LL", "ÅNGSTRÖM", "été", "́x", "Σας", "İx", "12ab3", "<|endoftext|>", "a<|startoftext|>b", " ", " x",
             "\x1cy", "\x85", "日本語", "🙂👍", "...", "Word.", "WORD!?", "a~b", "~", "x'~", "K\u0301.", "e.\u0301", "q'.", "don't.", "\u0000", "don't've", "ﬁ", "ẛ̣", "'s"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "\n", "\t", "", "\r\n", "  "]) for _ in range(40)) for _ in range(200)]
    step = T._encoded(T.default_vocabulary(), None, np.zeros(0, np.int64), remembered=50)()
    got = []
    for i in range(0, len(texts), 20):
        part = [t.encode() for t in texts[i:i + 20]]
        got += step({"doc_id": list(range(len(part))), "tie": [0] * len(part), "text": part}).column("ids").to_pylist()
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


class Counted(dict):
    looked_up = 0

    def get(self, key):
        self.looked_up += 1
        return super().get(key)


def test_a_repeated_word_is_looked_up_once_a_call(tokenizer):
    encoder = T.WordEncoder(T.default_vocabulary())
    encoder.known = Counted()
    draw = random.Random(3)
    words = ["Uno", "uno,", "UNO!?", "señal", "SEÑAL", "œuf", "straße.", "it's", "x~y", "...", "é,", "ÿ÷ø"]
    texts = [" ".join(draw.choice(words) for _ in range(200)) for _ in range(10)]
    got = encoder.texts([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [_whole(tokenizer, t)[:-1] for t in texts]
    # Looked up, learnt, looked up again; lower case and marks leave fewer parts than words.
    assert encoder.known.looked_up <= 2 * 16 and len(encoder.known) <= 16


def test_special_tokens_count_as_they_are_written(tokenizer):
    encoder = T.WordEncoder(T.default_vocabulary())
    for texts in (["<|ENDOFTEXT|> Word, word"], ["a<|endoftext|>, Word,", None, "Word, <|endoftext|>."], ["", None], ["Word, <|Endoftext|>", "word."]):
        got = encoder.texts([None if t is None else t.encode() for t in texts])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [_whole(tokenizer, t)[:-1] for t in texts]


def test_whole_table_against_brute_force(spark, tokenizer):
    docs = spark.read.parquet(f"{data.SF}/documents.parquet")
    got = [tuple(r) for r in T.op13_token_planes(docs).orderBy("doc_id").collect()]
    assert got == _expected(tokenizer, sorted(tuple(r) for r in docs.select("doc_id", "text").collect()))


def test_edges(spark, tokenizer, tmp_path):
    docs = data.clashing(data.edge_docs(spark)).withColumns({"ids": F.lit("x"), "base": F.lit("y")})
    manifest = T.write_planes(T.encoded(docs, T.default_vocabulary()), f"file://{tmp_path}/out", planes=2, bits=8, block=100)
    back = T.read_planes(manifest).collect()
    rows = data.edge_rows()
    assert len(back) == len(rows) == manifest.agg(F.sum("docs")).first()[0]
    back.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    starts = np.cumsum([0] + [r["n_tokens"] for r in back])
    assert [r["start"] for r in back] == starts[:-1].tolist()
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in back)
    assert got == sorted((str(r[0]), _whole(tokenizer, r[1])) for r in rows)
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) == manifest.agg(F.sum("bytes")).first()[0]


def test_only_files_of_the_manifest_count(spark, tmp_path):
    ids = spark.createDataFrame([(1, 0, 0, 4, bytearray(b"\x05\0\0\0"))], "doc_id long, part int, tie long, width tinyint, ids binary")
    first = T.write_planes(ids, str(tmp_path / "x"))
    T.write_planes(ids, str(tmp_path / "x"))
    assert len(list((tmp_path / "x").iterdir())) == 2
    assert [(r["doc_id"], r["start"], bytes(r["ids"])) for r in T.read_planes(first).collect()] == [(1, 0, b"\x05\0\0\0")]


def test_parts_ascend_and_divide_a_hot_id():
    draw = np.random.default_rng(1)
    bounds = np.array([5, 9, 9, 9, 30])
    ids = [None, -4, 5, 6, 8, 10, 30, 31] + [9] * 4000
    ties = draw.integers(-(1 << 63), (1 << 63) - 1, len(ids)).tolist()
    parts = T._part(ids, ties, bounds)
    assert parts[[0, 1]].tolist() == [0, 0] and parts[2] in (0, 1) and parts[[3, 4, 5]].tolist() == [1, 1, 4] and parts[7] == 5
    assert (np.bincount(parts[8:])[1:5] > 800).all() and len(np.bincount(parts[8:])) == 5
    rows = sorted(zip(ids, ties, parts.tolist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)


def test_empty_table(spark):
    got = T.op13_token_planes(data.no_docs(spark))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0
