"""Ranked search against plain Python."""

import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import ALNUM, awkward, empty, low
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvaframe.llm import search
from sylvaframe.llm import textops as tx
from sylvaframe.llm.queries import QUERIES, SQL


def plain(docs, items, k=10):
    counts = [(d, Counter(ALNUM.findall(low(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    N, L = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in dict.fromkeys(items):
        own, scores = set(ALNUM.findall(low(text))), []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own & set(c))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10, parts=3, terms=True):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "score", "rank", "block", "terms", "segment")}).repartition(parts)
    i = spark.createDataFrame(items, "item_id int, text string").withColumns({c: F.lit("clash") for c in ("id", "doc_id", "score", "rank", "terms")})
    if terms:
        return sorted(map(tuple, search.search(d, i, k=k).collect()), key=repr)
    index, n, _ = search.build(d)
    return sorted(map(tuple, search.ranked(index, n, i, k=k).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=12), min_size=1, max_size=60), st.lists(st.integers(0, 25), min_size=1, max_size=8), st.integers(1, 12), st.integers(0, 900_000))
def test_best_first(texts, query, k, least):
    """A segment's search equals scoring all its documents, ties and all, from any threshold."""
    col = pa.array([" ".join(f"w{x}" for x in t) for t in texts])
    one = search.counted_segment(pa.array(range(len(texts)), pa.int64()), col, 0)
    count, node, tf, length = (one.column(c)[0].values.to_numpy().astype(np.int64) for c in ("count", "node", "tf", "lengths"))
    n_docs, n_terms = one.column("n_docs")[0].as_py(), one.column("n_terms")[0].as_py()
    assert n_terms == sum(map(len, texts)) and sorted(one.column("terms")[0].as_py()) == sorted({f"w{x}" for t in texts for x in t})
    levels, top = search.tree(count, node, search.saturated(tf, length[node], n_docs, n_terms), len(length))
    words = list(dict.fromkeys(f"w{x}" for x in query))
    weights = np.array([int(w[1:]) % 5 * 100 + 1 for w in words])
    segment = search.Segment({"terms": one.column("terms")[0].values, "ids": one.column("ids")[0].values, "levels": levels}, pa.array(words))
    got = sorted(segment.best(np.arange(len(words)), weights, k, least), key=lambda x: (-x[0], x[1]))[:k]
    want = []
    for d, t in enumerate(texts):
        c = Counter(f"w{x}" for x in t)
        m = 10 + 90 * len(t) * n_docs // max(1, n_terms)
        s = sum(int(w) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x, w in zip(words, weights) if c[x])
        if s >= max(1, least):
            want.append((s, d))
    assert got == sorted(want, key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("segment, block, terms", [(8 << 20, 1024, True), (200, 2, True), (200, 3, False)])
def test_against_plain(spark, monkeypatch, segment, block, terms):
    """Few words, so scores tie; copies, repeated ids, nulls, items with one id, small segments and blocks."""
    monkeypatch.setattr(search, "SEGMENT", segment)
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(segment)
    docs = [(int(i), " ".join(f"W{x}" for x in rng.integers(0, 30, rng.integers(0, 15)))) for i in rng.integers(0, 150, 200)]
    docs += docs[:30] + [(None, "w1 w2"), (None, None), (500, None), (501, ""), (502, "... !!"), (-3, "W1 w2 ÀB-àb été"), (503, "w3 " * 3000)]
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 4))) for i in range(7)] + [(0, "w1 w1 W2"), (0, "w1 w1 W2"), (9, None), (10, "unseen"), (11, "ÀB Été"), (None, "w3")]
    want = plain(docs, items)
    assert len(want) > 60 and found(spark, docs, items, terms=terms) == want


def test_words_that_share_a_hash(spark, monkeypatch):
    """Whatever the hash, terms are told apart inside a segment."""
    whole = tx.hash_words
    monkeypatch.setattr(tx, "hash_words", lambda *a, **k: (np.full_like((x := whole(*a, **k))[0], 7), x[1]))
    one = search.counted_segment(pa.array([1, 2], pa.int64()), pa.array(["a b a", "c B bb"]), 0)
    assert dict(zip(one.column("terms")[0].as_py(), one.column("count")[0].as_py())) == {"a": 1, "b": 2, "bb": 1, "c": 1}


def test_edges(spark):
    assert search.search(empty(spark), spark.createDataFrame([(1, "a")], "item_id int, text string")).count() == 0
    assert search.search(awkward(spark), spark.createDataFrame([], "item_id int, text string")).count() == 0
    rows = search.search(awkward(spark), spark.createDataFrame([(1, "row straße TAIL one"), (2, "世界")], "item_id int, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == {(1, 10), (1, 11), (1, 6), (1, 7), (1, None), (1, 12), (2, -7)} and len(rows) == 8


def test_query(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = plain(docs, items)
    assert sorted(map(tuple, QUERIES["op13_max_tree_search"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({SQL['op13_max_tree_search']})").fetchall(), key=repr) == want
