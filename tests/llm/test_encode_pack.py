import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import encode, pack


@pytest.fixture(scope="module")
def raw():
    with open(encode.VOCAB_PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(raw):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw, text):
    return np.frombuffer(encode.encoder_for(raw).encode(text), "<i4").tolist()


CASES = ["", " ", "a", "Don't they'll  we've\n\n x", "<|endoftext|> and <|im_start|>", "研究者はログを保管する。2025年", "한국어 문장입니다.", "ééé naïve – “q”", "a" * 5000, "学" * 3000, "\t\r\n \x0b", "x y　z\x85w", "🙂🙃" * 50, "0123456789 12.5%"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_public_library(raw, reference, text):
    assert ids(raw, text) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(raw, reference, text):
    assert ids(raw, text) == reference.encode_ordinary(text)


def test_round_trip(raw, reference):
    text = "Policy 2025: les règles – 规定 " * 40
    assert reference.decode(ids(raw, text)) == text


def test_long_words_merge_alike(raw):
    e = encode.encoder_for(raw)
    word = (b"abcd" * 40 + "学".encode() * 9)[: encode.LONG_WORD]
    assert e._merge_long(word) == e.merge(word)


def test_frames(spark, raw):
    rows = [(1, "two words", "x"), (2, None, "y"), (3, "", "z"), (None, "no id", "w"), (1, "two words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in encode.encode_ids(df).collect()}
    assert got == {(1, tuple(ids(raw, "two words"))), (2, ()), (3, ()), (None, tuple(ids(raw, "no id")))}
    assert encode.encode_ids(df).count() == 5
    assert encode.encode_ids(df.limit(0)).count() == 0


def test_packing_bounds():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, (rng.pareto(1.2, 20000) * 120 + 1).astype(int))
    where = pack.pack_sizes(sizes)
    fill = np.bincount(where, sizes)
    assert fill.max() <= 2048 and fill.sum() == sizes.sum()
    assert 1 - sizes.sum() / (2048 * len(fill)) < 0.02


def test_packing_frames(spark):
    rows = [(1, "word " * 9000), (2, "short"), (3, None), (4, ""), (5, "short"), (5, "short"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack.pack_documents(df, capacity=1000).toPandas()
    assert set(got.doc_id.dropna()) == {1, 2, 5} and len(got) == 10 + 4
    assert got.groupby("container_id").n_tokens.sum().max() <= 1000
    big = got[got.doc_id == 1].sort_values("piece_no")
    assert (big.start == big.piece_no * 1000).all() and big.n_tokens.sum() == 9001
    assert pack.pack_documents(df.limit(0)).count() == 0
    assert pack.packing_report(pack.pack_documents(df.limit(0))).first().unused_share is None
