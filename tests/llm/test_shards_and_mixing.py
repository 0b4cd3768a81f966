"""K-d shards and the mix."""

import zlib
from collections import Counter

import pytest
from helpers import WORD, awkward, empty
from pyspark.sql import functions as F

from sylvaframe.llm import mixing, neardup, shards
from sylvaframe.llm.queries import QUERIES


def test_shards_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_kd_shards"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes"
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    largest = max(r.size for r in rows)
    assert max(load.values()) - min(load.values()) <= 2 * largest


def test_split_is_the_weighted_median(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    load = {r.shard: r.s for r in shards.assign(rows, shards=3).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    total = sum(load.values())
    assert set(load) == {0, 1, 2} and all(abs(v - total / 3) <= 0.01 * total for v in load.values())


def plain_tree(rows, leaves, first, extent, out):
    """rows: (size, wide, crc, id); the k-d tree by sorting."""
    if leaves == 1 or not rows:
        out.update({r: first for r in rows})
        return
    weight = sum(r[0] for r in rows)
    spread = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / extent[d] for d in range(3)]
    dim = max(range(3), key=lambda d: (spread[d], -d))
    keys, need, held, cut = [dim, 2, 3], weight * (leaves // 2) / leaves, rows, []
    for depth, k in enumerate(keys):
        below = 0
        for v in sorted({r[k] for r in held}):
            own = sum(r[0] for r in held if r[k] == v)
            if below + own >= need:
                break
            below += own
        need -= below
        if min(need, own - need) <= shards.TOLERANCE * weight or depth == 2:
            cut.append(v if need <= own - need else v + 1)
            break
        cut.append(v)
        held = [r for r in held if r[k] == v]
    left = [r for r in rows if tuple(r[k] for k in keys[: len(cut)]) < tuple(cut)]
    inside = set(left)
    plain_tree(left, leaves // 2, first, extent, out)
    plain_tree([r for r in rows if r not in inside], leaves - leaves // 2, first + leaves // 2, extent, out)


@pytest.mark.parametrize("n", [5, 8, 33])
def test_shards_equal_a_plain_tree(spark, sf, n):
    docs = [(r.doc_id, (r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(len(t.encode()) + 1, len(t.encode()) - len(t), zlib.crc32(t.encode()), i) for i, t in docs]
    want = {}
    plain_tree(rows, n, 0, [max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in range(3)], want)
    want = {r[3]: s for r, s in want.items()}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.shard for r in shards.assign(table, shards=n).collect()} == want
    assert {r.doc_id: r.shard for r in shards.with_shard(table, shards=n).collect()} == want


def test_many_shards(spark):
    """Neither plans nor code grow with the shards."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 97 AS INT)) AS text")
    load = {r.shard: r.s for r in shards.assign(rows, shards=700).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    mean = sum(load.values()) / 700  # each cut misses its quantile by half a row at most, and halves what came from above
    assert len(load) == 700 and all(abs(x - mean) <= 2 * 97 for x in load.values())


def test_equal_texts_split_only_where_they_must(spark):
    rows = spark.createDataFrame([(i, "the same text") for i in range(64)], "doc_id long, text string")
    assert Counter(r.shard for r in shards.assign(rows, shards=4).collect()) == {k: 16 for k in range(4)}


def test_shards_awkward(spark):
    rows = shards.assign(awkward(spark), shards=4)
    assert rows.count() == 15
    assert shards.assign(empty(spark), shards=4).count() == 0
    kept = shards.with_shard(awkward(spark), target_bytes=60_000)
    assert kept.count() == 15 and kept.columns.count("shard") == 1 and kept.filter("shard is null").count() == 0
    same = spark.createDataFrame([(1, "a")] * 10, "doc_id long, text string")
    assert shards.assign(same, shards=8).count() == 10


def level(sizes, weights, share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    target, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_hash_mix"](spark, sf).collect()
    assert len(rows) == len(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(rows) == sorted(QUERIES["op7_hash_mix"](spark, sf).collect())


def test_mix_is_nested(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    less, more = ({r.doc_id: r.copies for r in mixing.taken(docs, share=s).collect()} for s in (0.7, 0.9))
    assert all(less[d] <= more[d] for d in less)


def test_mix_awkward(spark):
    rows = mixing.taken(awkward(spark)).collect()
    assert len(rows) == 15 and {r.source for r in rows} == {"a", "b", "c", "d", None}
    mixed = mixing.mixed(awkward(spark))
    assert mixed.columns == awkward(spark).columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the operators' own come back as they were."""
    names = ["__hash", "__copy", "__s", "__i", "__source", "__cut", "__whole", "c0", "c1", "c2"]
    plain = awkward(spark)
    rows = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for stage in (mixing.mixed, neardup.deduplicated):
        found = stage(rows)
        assert found.columns == rows.columns
        got = [r.asDict() for r in found.collect()]
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in got for n in names)
        assert sorted(str(tuple(r[c] for c in plain.columns)) for r in got) == sorted(str(tuple(r)) for r in stage(plain).collect())
