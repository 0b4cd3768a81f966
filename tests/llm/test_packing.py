"""Packed sequences: the rule against plain Python, every id once, no padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvaframe.llm import packing, tokenfiles
from sylvaframe.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_levels(sizes, size):
    """The level each document goes to, by squaring all counts for every choice."""
    windows, out = [], []
    for n in sizes:
        def after(i):
            level = Counter(w for k, w in enumerate(windows) if k != i and w < size)
            top = (windows[i] if i is not None else 0) + n
            return sum(c * c for c in (level + Counter([top] if top < size else [])).values())

        options = [(after(i), -w, -i, i) for i, w in enumerate(windows) if w < size and w + n <= size] + [(after(None), 0, 0, None)]
        _, level, _, i = min(options, key=lambda o: o[:3])
        out.append(-level)
        if i is None:
            windows.append(n)
        else:
            windows[i] += n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_levels(sizes):
    levels, got = packing.Levels(12), []
    for k, n in enumerate(sizes):
        got.append(levels.choice(n) if n < 12 else 0)
        levels.place((k, 0, n, np.full(n, k)))
    assert got == plain_levels(sizes, 12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=80))
def test_nothing_is_lost_or_padded(sizes):
    levels, out = packing.Levels(16), []
    for k, n in enumerate(sizes):
        out.append(levels.place((k, 0, n, np.arange(n) + 100 * k)) or [])
    full = len([s for s in out if s])
    out = [s for s in out if s] + list(levels.rest())
    assert all(sum(len(p[-1]) for p in s) in (1, 2, 4, 8, 16) for s in out) and all(sum(len(p[-1]) for p in s) == 16 for s in out[:full])
    flat = sorted((int(x), p[0], p[1] + i) for s in out for p in s for i, x in enumerate(p[-1]))
    assert flat == [(100 * k + i, k, i) for k, n in enumerate(sizes) for i in range(n)]


def held(rows, window=2048):
    """Pieces by document and by sequence, once they are seen to be gapless."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        n = sum(r.length for r in own)
        assert n <= window and n & (n - 1) == 0  # no padding
    return docs, seqs


def test_query(spark, sf):
    own = tokenfiles._tokenizer(PATH).tokenizer
    docs, seqs = held(QUERIES["op11_sum_of_squares"](spark, sf).collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = np.array([*own.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.sort(key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    # but for long documents, fewer are cut than if all were poured together
    assert sum(len(p) > -(-p[0].doc_tokens // 2048) for p in docs.values()) < sum(p[0].doc_tokens % 2048 for p in docs.values()) / 2048


def test_awkward(spark):
    rows = packing.digests(packing.packed(awkward(spark), PATH, window=64)).collect()
    docs, _ = held(rows, 64)
    assert len(docs) == 14 and all(sum(r.length for r in own) == sum({r.start: r.length for r in own}.values()) or d == 12 for d, own in docs.items())
    assert [(r.start, r.length, r.doc_tokens) for d in (4, 5) for r in docs[d]] == [(0, 1, 1)] * 2 and len({r.start for r in docs[11]}) > 50
    assert packing.digests(packing.packed(empty(spark), PATH)).count() == 0
    tokens = packing.packed(awkward(spark).filter("doc_id = 6"), PATH, window=8).select(F.explode("tokens")).collect()
    assert [r[0] for r in tokens][-1] == 1


def test_long_text(spark, monkeypatch):
    text = "one two, three's été 12 <|endoftext|> " * 240_000
    docs = spark.createDataFrame([(1, "a b"), (2, text), (3, "c")], "doc_id long, text string")
    found, _ = held(packing.digests(packing.packed(docs, PATH)).collect())
    own = tokenfiles._tokenizer(PATH).tokenizer
    one = own.encode("one two, three's été 12 <|endoftext|> ", add_special_tokens=False).ids
    ids = np.array([*one * 240_000, 1], "<u4")
    assert {r.doc_tokens for r in found[2]} == {len(ids)}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in found[2]) and sum(r.length for r in found[2]) == len(ids)
