"""Hard negatives against plain Python."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import negatives as hn
from sylvaframe.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, anchor, positives=5, negatives=10, window=(30, 90), scale=256):
    own = []
    for i, v, l in rows:
        if i is None or l is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, l, tuple(int(np.floor(scale * np.float64(np.float32(x)))) for x in v)))
    out, done = [], set()
    for k, (i, l, v) in enumerate(own):
        if not anchor(i) or (i, l, v) in done:
            continue
        done.add((i, l, v))
        dot = lambda w: sum(x * y for x, y in zip(v, w))
        best = sorted((-dot(w), j) for n, (j, m, w) in enumerate(own) if m == l and n != k)[:positives]
        for s, p in best:
            s = -s
            near = sorted((-dot(w), j) for j, m, w in own if m != l and window[0] * s <= 100 * dot(w) <= window[1] * s)[:negatives]
            out += [(i, p, r, j, s, -t) for r, (t, j) in enumerate(near, 1)]
    return sorted(out)


def got(spark, rows, block=None, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "score", "block", "rank")}).repartition(parts)
    return sorted(map(tuple, hn.mined(hn.quantized(df), F.col("id") % 10 == 0, **kw).collect()))


@pytest.mark.parametrize("cells", [1 << 20, 64])
@pytest.mark.parametrize("block", [8192, 3])
def test_against_plain(spark, monkeypatch, cells, block):
    """Few values, so ties abound; repeated rows, repeated ids, nulls anywhere, ragged and empty vectors."""
    monkeypatch.setattr(hn, "CELLS", cells)
    monkeypatch.setattr(hn, "BLOCK", block)
    rng = np.random.default_rng(cells + block)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 5, rng.choice([4, 4, 4, 3, 0])) / 4], int(rng.integers(0, 3))) for i in rng.integers(0, 90, 150)]
    rows += rows[:20] + [(10, None, 1), (20, [0.5, None], 1), (30, [float("nan"), 1.0], 0), (40, [float("inf")], 0), (None, [1.0, 1.0], 1), (50, [1.0, 1.0], None)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and got(spark, rows) == want


def test_many_copies(spark):
    """A third of all rows equal; an anchor among its copies."""
    rows = [(i, [1.0, 0.5], 1) for i in range(60)] + [(100 + i, [0.5, i / 64], i % 3) for i in range(80)]
    assert got(spark, rows, parts=5) == plain(rows, lambda i: i % 10 == 0)


def test_exact_beyond_doubles(spark):
    """Sums beyond 2^53 are taken in integers, those beyond 63 bits are an error."""
    rows = [(i, [2.0**21 + i, 3.0 + i, 2.0**20], i % 2) for i in range(25)]
    assert hn._product(3, 1 << 30, 1 << 30) is np.int64 and hn._product(3, 1 << 20, 1 << 20) is np.float64
    assert got(spark, rows, window=(10, 100)) == plain(rows, lambda i: i % 10 == 0, window=(10, 100))
    with pytest.raises(ValueError):
        got(spark, [(i, [1e18], 0) for i in range(3)])


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(10, [1.0], 1)]) == [] and got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows, lambda i: i % 100 == 0)
    assert len(want) > 100 and sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert sorted(con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({SQL['op12_hard_negatives']})").fetchall()) == want
