import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe, tokens, topk

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "a", "It's we're  two   spaces\n\n\ttabs ", "naïve café — “quotes” 数字 123 ١٢٣ 😀", "\x1c \x85 　x\xa0y", " \n" * 50, "x" * 3000, "<|endoftext|> <|im_start|>"] + ["word " * 700 + "'re 'll" * 90, "同じ" * 900]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.array([random.Random(bits).randrange(1 << bits) for _ in range(1001)], dtype=np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokens.unpack(data, bits, 1001) == ids).all()


def test_width():
    assert [tokens.width(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


MIXED = st.text(alphabet=st.sampled_from(list("ab1' \n\té!?-\x85\xa0\u2000\u3000\x1c×à数") + ["\r"]), max_size=12)


@pytest.mark.parametrize("window", [tokens.WINDOW, 5])
def test_columns_encode_like_the_library(window, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", window)
    path = P.path("byte_bpe_50k.json")
    model, ours = Tokenizer.from_file(path), tokens.LibraryEncoder(path)

    @given(st.lists(st.none() | st.text(max_size=40) | st.lists(MIXED | st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", "  ", "'re"]), max_size=9).map("".join), max_size=6))
    @settings(max_examples=200, deadline=None)
    def check(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in ours(pa.array(texts, pa.string()))] == [model.encode(t or "", add_special_tokens=False).ids for t in texts]

    check()
    long = "x" * 50_000 + " word's  " * 9000 + "\n" * 4000 + "<|endoftext|>" * 3 + "é" * 3000
    assert np.frombuffer(ours(pa.array([long], pa.string()))[0], "<u4").tolist() == model.encode(long, add_special_tokens=False).ids


def test_token_files(spark):
    rows = [(i * 7 % 11 if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uri string")
    path = P.path("byte_bpe_50k.json")
    folder, files = tokens.write_tokens(docs, path, 2, 50257, block=16)
    got = [tuple(r) for r in tokens.read_tokens(spark, files).orderBy("start").collect()]
    model = Tokenizer.from_file(path)
    want = {}
    for d, t, _ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for d, start, n, crc in got:
        assert start == at and (n, crc) in want[d]
        want[d].remove((n, crc))
        at += n
    f = tokens.TokenFile(files[-1][0])
    every = f.read(0, f.ids)
    assert (f.read(5, 40) == every[5:40]).all() and len(f.read(f.ids, f.ids + 9)) == 0
    assert tokens.read_tokens(spark, tokens.write_tokens(docs.limit(0), path, 2, 50257)[1]).count() == 0


@given(st.text(alphabet=st.sampled_from(list("ab1' \n\té—'re")) | st.characters(codec="utf-8"), max_size=200), st.integers(1, 12), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_stitching_finds_the_same_pre_tokens(text, size, overlap):
    pattern = regex.compile(P.PATTERN)
    parts = [(at, t, bpe.boundaries(t, pattern)) for at, t in bpe.chunks(text, size, overlap)]
    found = [t[a:b] for t, own in bpe.stitched(iter(parts), pattern) for a, b in zip(own, own[1:])]
    assert found == pattern.findall(text)


def test_bpe_against_the_library(spark):
    rows = [(i if i else None, t, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[9], 1), (3, TEXTS[9], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int")
    coded = bpe.encode(docs, RANKS, P.PATTERN, size=64, overlap=16)
    got = sorted((r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"]), r["__key"]) for r in bpe.decode(coded, RANKS).collect())
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = sorted((d or 0, np.array(model.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode(), k) for d, t, k in rows)
    assert got == want
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_topk_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 1) for i in range(300)]
    rows += [(300 + i, [0.5] * 6, 1) for i in range(150)] + [(450, [0.0] * 6, 1), (451, None, 1), (452, [None] * 6, 1), (453, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 1), (455, [], 1), (454, [1.0, 2.0], 1), (400, [2.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    ready = topk.quantised(table)
    for block in (3, 1000):
        got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in topk.exact_topk(ready, ready.filter("vec_id % 50 = 0"), 5, block_rows=block).collect())
        whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
        queries = {}
        for i, v in whole:
            if i % 50 == 0 and (i not in queries or tuple(v) < tuple(queries[i])):
                queries[i] = v
        want = []
        for q, x in queries.items():
            order = sorted((-float(v @ x), i) for i, v in whole if i != q and len(v) == len(x))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
        assert got == sorted(want)
    assert topk.exact_topk(ready.limit(0), ready.limit(0), 5).count() == 0


