import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import queries, wordbpe

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plainly(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PARTS = st.one_of(
    st.text(alphabet=st.sampled_from(list("abest'ré!?.1 \n\t") + ["́", "̣", "̸", "<", "\x85", "\xa0", "　", "\x1c", "İ", "가", "ᆨ", "ᄀ", "ᅡ", "か", "゙", "數", "字"]), max_size=30),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "'re", "'ll", "!'s", "''s", "internationalization", "</w>", "Straße", "ΑΣ", "..." * 9, "the quick brown ", "x" * 40, "ab" * 30]),
    st.text(max_size=6),
)


@given(st.lists(PARTS, max_size=40).map("".join), st.integers(1, 60), st.integers(1, 40))
@settings(max_examples=600, deadline=None)
def test_trees_of_any_leaves_equal_the_library(text, leaf, window):
    model = wordbpe.word_encoder(PATH)
    nodes = [(t, np.frombuffer(model.texts([t.encode()])[0], "<u4")) for t in wordbpe.leaves(text, model, leaf)]
    assert "".join(t for t, _ in nodes) == text
    whole, ids = wordbpe.tree(nodes, model, window) if nodes else ("", np.empty(0, "<u4"))
    assert whole == text and ids.tolist() == plainly(text)


@pytest.mark.parametrize("text", ["a" * 9000, "abc" * 3001, "donaudampfschifffahrtsgesellschaft" * 300, "'" * 5000 + "s" * 5000, "數字同じ" * 2000, "-=" * 4000 + "re", "é" * 3000, "́" * 3000, "<|endoftext|>" * 700])
def test_texts_without_white_space(text):
    model = wordbpe.word_encoder(PATH)
    nodes = [(t, np.frombuffer(model.texts([t.encode()])[0], "<u4")) for t in wordbpe.leaves(text, model, 333)]
    assert wordbpe.tree(nodes, model)[1].tolist() == plainly(text)


def test_windows_stay_small_where_sides_agree(monkeypatch):
    """A join reads a few windows' characters, however long its sides are, also inside one word."""
    model, seen = wordbpe.WordEncoder(PATH), []
    text = "".join(chr(97 + hashlib.sha256(str(i).encode()).digest()[0] % 26) for i in range(40_000))
    plain = model.window
    monkeypatch.setattr(model, "window", lambda t: seen.append(len(t)) or plain(t))
    half = len(text) // 2
    nodes = [(t, plain(t)) for t in (text[:half], text[half:])]
    assert wordbpe.tree(nodes, model)[1].tolist() == plainly(text)
    assert sum(seen) < 4000


def test_documents_against_the_library(spark):
    texts = ["", None, "a", " \n", "It's we're!'s  İ", "word " * 900 + "x" * 2000, "<|endoftext|>" * 90, "é" * 700, "the cat's " * 70]
    rows = [(i if i else None, t, i, "c") for i, t in enumerate(texts)] + [(5, texts[5], 1, "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int, ids string")
    got = wordbpe.decode(wordbpe.encode(docs, PATH, leaf=64, window=16), PATH).collect()
    want = sorted((d or 0, k, np.array(plainly(t), "<u4").tobytes(), LIBRARY.decode(plainly(t), skip_special_tokens=False)) for d, t, k, _ in rows)
    assert sorted((r["doc_id"] or 0, r["__key"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    # More leaves than one round joins.
    long = spark.createDataFrame([(1, "ab cde's! " * 4000 + "z" * 999)], "doc_id long, text string")
    row = wordbpe.encode(long, PATH, leaf=50, window=16).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == plainly("ab cde's! " * 4000 + "z" * 999)
    assert wordbpe.encode(docs.limit(0), PATH).count() == 0
    assert wordbpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first()["decoded"] is None


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_word_bpe(spark, folder).collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = plainly(r["text"])
        assert got.pop(r["doc_id"]) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(LIBRARY.decode(ids, skip_special_tokens=False).encode()))
    assert not got


def test_a_tokenizer_that_codes_white_space_is_refused():
    with pytest.raises(ValueError):
        wordbpe.WordEncoder(P.path("byte_bpe_50k.json"))
