"""Encoders against the public libraries, packing against its contract."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from posegrid.llm import byte_bpe, packing
from posegrid.llm.word_tokens import WordBpe

ODD = ["", " ", "  ", "\n\n x", "a  b \n c", "don't WE'LL 's 'sx ''s", "Ünïcödé éé 日本語 ١٢٣ ½", "x" * 400, "ab" * 300 + "\t\t" + "é" * 50, "\u00a0\u2003 z\u2028", "e\u0301 ΑΣ Σ İ", "<|endoftext|> a<|startoftext|>b", "\x1c\x1d a\x85b", "$$$ ###!!?? 12345 3.14", "🙂👩‍👩‍👧 ok"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def words():
    return WordBpe(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def word_reference():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def both(encoder, reference, texts):
    ids, sizes = encoder.texts(texts)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == reference.encode_ordinary(t), repr(t)
        assert encoder.v.decode(ids[a:b].astype(np.int64))[0].tobytes() == t.encode()


def test_odd_texts(encoder, reference):
    both(encoder, reference, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(encoder, reference, texts):
    both(encoder, reference, texts)


@settings(max_examples=80, deadline=None)
@given(st.text("theand ring", max_size=40), st.text("theand ring", max_size=10), st.integers(0, 40), st.integers(0, 40))
def test_edits_equal_a_fresh_encoding(encoder, text, more, a, b):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    e = byte_bpe.Editable(encoder, text.encode()).append(more.encode())
    fresh = lambda s: byte_bpe.Editable(encoder, s.encode()).ids()
    assert e.ids() == fresh(text + more)
    assert e.replace(a, b, more.encode()).ids() == fresh(text[:a] + more + (text + more)[b:])


def word_ids(words, text):
    return words.ids(text.encode().split())[0].tolist()


def test_odd_words(words, word_reference):
    for t in ODD:
        assert word_ids(words, t) == word_reference.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF), max_size=60))
def test_any_words(words, word_reference, text):
    assert word_ids(words, text) == word_reference.encode(text, add_special_tokens=False).ids


def check_pieces(rows, ids, window):
    docs, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(docs) == set(ids)
    for k, v in docs.items():
        at = 0
        for start, length in sorted(v):
            assert start == at
            at += length
        assert at == len(ids[k])
    padding = 0
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("window,open_windows,parts", [(64, 2, 3), (64, 16, 1), (2048, 64, 20)])
def test_packing(spark, word_reference, window, open_windows, parts):
    rng = np.random.default_rng(window + parts)
    texts = {i: " ".join(rng.choice(["the", "and", "windows", "xyzzy", "é"], rng.integers(0, 150))) for i in range(60)} | {100: None, 101: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumnRenamed("doc_id", "key").repartition(parts)
    rows = packing.pack(df.withColumn("ids", df["key"]), P.path("word_bpe_49k.json"), id_col="key", window=window, open_windows=open_windows).collect()
    ids = {k: [*word_reference.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert check_pieces(rows, ids, window) == 0
    assert all(list(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_encode_and_decode(spark, reference):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "a b"), (0, "again")], "doc_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    e = byte_bpe.encode(df, path, P.PATTERN)
    rows = e.collect()
    assert len(rows) == len(ODD) + 3 and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    back = sorted((r["decoded"] for r in byte_bpe.decode(e, path).collect()))
    assert back == sorted((t or "").encode() for t in [*ODD, None, "a b", "again"])
