"""Token files: exact round trips, checksums, and the tokenizer."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvaframe.llm import rangecoder as rc
from sylvaframe.llm import textops as tx
from sylvaframe.llm import tokenfiles
from sylvaframe.llm.queries import QUERIES
from sylvaframe.llm.wordtokens import WordTokenizer, stretches
from test_text_kernels import thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 999)), max_size=5000), st.sampled_from([1, 64, 1024]), st.sampled_from([2, 4096]))
def test_blocks(ids, stretch, lanes):
    flat = np.array(ids, np.uint32)
    old = rc.STRETCH, rc.LANES
    rc.STRETCH, rc.LANES = stretch, lanes
    try:
        coded = rc.encode_block(flat, 1000)
        back = rc.decode_block(np.concatenate([*coded, np.zeros(0, np.uint32)]), np.array([len(x) for x in coded], np.int64), len(flat), 1000)
    finally:
        rc.STRETCH, rc.LANES = old
    assert np.array_equal(flat, back)


def packed(ids, docs, vocabulary, block):
    p = rc.Packer(vocabulary, block)
    for i, d in zip(ids, docs):
        p.add([i], [len(d)], d)
    return p.segment()


def test_segment():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, n).astype(np.uint32) for n in (700, 0, 1, 5000)]
    raw = packed([5, None, 7, 8], docs, 50, 512)
    ids, size, blocks = rc.unpack(raw)
    assert ids == [5, None, 7, 8] and size.tolist() == [700, 0, 1, 5000] and np.array_equal(np.concatenate(list(blocks)), np.concatenate(docs))
    assert tokenfiles.crcs(size, rc.unpack(raw)[2]) == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
    ids, size, blocks = rc.unpack(packed([], [], 50, 512))
    assert (ids, len(size), list(blocks)) == ([], 0, [])
    assert len(raw) < 5701 * 1.0
    broken = bytearray(raw)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        list(rc.unpack(bytes(broken))[2])
    with pytest.raises(ValueError):
        packed([1], [np.array([50], np.uint32)], 50, 512)


def test_fewer_bits_than_a_table_of_frequencies(spark, sf):
    """Fewer bits an id than the entropy of the ids' own frequencies, whose table would come on top."""
    own = tokenfiles._tokenizer(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    flat = np.concatenate([own.encode(*_bytes(t), 2)[0] for t in texts])
    share = np.bincount(flat) / len(flat)
    share = share[share > 0]
    assert 8 * len(packed([1], [flat], own.vocabulary, rc.BLOCK)) / len(flat) < -(share * np.log2(share)).sum()


def _bytes(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


TRICKY = ["end. end, end!! a&&& b|c d_e f-g 'h i's. j.'s", "it's  don't I'LL", "a\u0301 e\u0301\n\u0301x", "ΣΑΣ ΟΔΟΣ ς", "<|endoftext|> x<|startoftext|>", "\u00a0\u2003wide\tspaces\r\n", "%%% a#b ...!!", "世界 123 ４５", "", "l'été ÀÉÎÕÜß÷× 'sé d'son ''s !'s 're've'll'l 'R x'", "<|a <|ENDOFTEXT|><|", "a\x1cb\x0bc\x85d"]


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.sampled_from(TRICKY), st.text(alphabet=st.sampled_from("abT .,!_&'s\n\u0301\u00e9Σς#<|>12世\t\u2003éÀ÷slv"), max_size=30)))
def test_words_tokenize_like_texts(text):
    own = tokenfiles._tokenizer(PATH)
    ids, size = own.encode(*_bytes(text, "", text), 2)
    want = [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert ids.tolist() == [*want, 2, *want] and size.tolist() == [len(want), 1, len(want)]


@pytest.mark.parametrize("n", [8, 512, 1024, 4096, 65536])
def test_swapped_letters(n):
    own = tokenfiles._tokenizer(PATH)
    texts = [thue_morse(n), thue_morse(n, "b", "a")]
    assert own.encode(*_bytes(*texts))[0].tolist() == [x for t in texts for x in own.tokenizer.encode(t, add_special_tokens=False).ids]


def test_pieces_that_share_a_hash(monkeypatch):
    """Whatever the hash, ids are right: hits are compared."""
    whole = tx.hash_words
    monkeypatch.setattr(tx, "hash_words", lambda *a, **k: (np.full_like((x := whole(*a, **k))[0], 7), x[1]))
    own, text = WordTokenizer(PATH), "one two three été <|endoftext|> four 世界 one été four"
    assert own.encode(*_bytes(text))[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_files():
    own, text = WordTokenizer(public_tokenizers.path("byte_bpe_50k.json")), "One  two, été\n<|x 世界"
    assert not own.by_words and own.encode(*_bytes(text, "", text), 2)[0].tolist() == [*(x := own.tokenizer.encode(text, add_special_tokens=False).ids), 2, 2, *x, 2]


def test_small_table_of_words(spark, sf):
    """A table that is emptied, or outgrown by one slice, gives the same ids."""
    own, small = tokenfiles._tokenizer(PATH), WordTokenizer(PATH, held=16)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert small.encode(*_bytes(r.text or ""))[0].tolist() == own.tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_long_text(spark, monkeypatch):
    """A text beyond a slice is tokenized in stretches and coded in several blocks."""
    text = "one two, three's été 12 <|endoftext|> " * 2000
    monkeypatch.setattr(tx, "SLICE_BYTES", 4096)
    monkeypatch.setattr(stretches, "__defaults__", (4096,))
    parts = list(stretches(_bytes(text)[0]))
    assert len(parts) > 10 and b"".join(p.tobytes() for p in parts).decode() == text
    assert [len(p) for p in stretches(np.full(9000, 97, np.uint8), 4096)] == [9000]
    monkeypatch.undo()
    docs = spark.createDataFrame([(1, "a b"), (2, text * 130), (3, "c")], "doc_id long, text string")
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.digests(spark, tokenfiles.write(docs, PATH, block=500_000)).collect()}
    T, at = tokenfiles._tokenizer(PATH).tokenizer, 0
    for d, t in ((1, "a b"), (2, text * 130), (3, "c")):
        ids = [*T.encode(t, add_special_tokens=False).ids, 2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_query(spark, sf):
    own = tokenfiles._tokenizer(PATH)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, at = {}, 0
    for d, t in docs:
        ids = [*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_mixed_range_coder"](spark, sf).collect()}
    assert got == want


def test_awkward(spark):
    rows = tokenfiles.digests(spark, tokenfiles.write(awkward(spark), PATH, block=256)).orderBy("start").collect()
    assert len(rows) == 15 and rows[0].id is None and [r.n_tokens for r in rows if r.id in (4, 5)] == [1, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    tokens = tokenfiles.read(spark, tokenfiles.write(awkward(spark).filter("doc_id = 6"), PATH)).first().tokens
    assert tokens[-1] == 2 and len(tokens) == 2
    assert tokenfiles.digests(spark, tokenfiles.write(empty(spark), PATH)).count() == 0
