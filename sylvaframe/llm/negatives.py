"""Hard-negative mining by blocked dense matrix products.

Vectors are brought to integers once and stored. Anchors are a stated set of rows; they are dealt out in blocks of at most
``BLOCK`` rows and ``BLOCK_BYTES`` bytes, and each block takes two passes over all rows, of which Spark hands every task a
part:

1. The block, sorted by label, travels with the tasks. A task multiplies each label's anchors by its candidates of that
   label in float64, which is exact while sums stay below 2^53 (counted from the largest components and the dimension;
   beyond it the products are taken in 64-bit integers, and scores that might not fit those are an error), and keeps the
   best few of each anchor. These lists are mergeable: the best of all tasks' lists are the anchor's positives.
2. The positives' scores give each anchor and positive a window of scores. A task multiplies the block by all its
   candidates and keeps the best few of another label inside each window. Merged likewise.

No pair leaves a task but those in its lists, so what is shuffled is anchors times tasks times the lists' length. Every
block's result is a folder of its own, written by Spark's committer.

Defined cases: rows with a null id, a null label, a null vector, or any null or non-finite component take no part; vectors
of unequal length are compared as if zeros followed the shorter one, so an empty vector scores 0 with all; of rows equal in
id, label and vector one is an anchor and all are candidates (an anchor leaves out one row equal to itself); rows of one id
that differ otherwise are rows of their own; equal scores stand in the order of their ids; an anchor without positives, or
a window without rows, gives no row; so does an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops as tx
from .common import shared_dir, shipped, stored

#: Anchors, and bytes of their vectors, that travel with the tasks of one job.
BLOCK, BLOCK_BYTES = 8192, 64 << 20
#: Cells of a product held at a time, and bytes of the vectors that are turned to float64 for it.
CELLS = 1 << 20
SCHEMA = "id long, label long, v array<long>"


def quantized(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, their components multiplied by scale and rounded down."""
    usable = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    out = out.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", usable))
    return out.select("id", "label", F.transform("x", lambda x: F.floor(scale * x)).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows, filled with zeros up to dim."""
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _product(dim: int, a: int, b: int) -> type:
    """In what the product of vectors is exact, from the largest components' sizes."""
    most = dim * a * b
    if most >= 1 << 63:
        raise ValueError(f"scores of {dim} components of up to {a} and {b} may not fit 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


class Best:
    """The k best (score, id) of each of n lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.at, self.score, self.id, self.own = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, rows: np.ndarray, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> None:
        """score, allowed [list, candidate]: candidates of the lists ``rows``; own: which of them are the anchor itself."""
        least = self.least[rows]
        good = allowed & (score >= least[:, None])
        many = np.flatnonzero(good.sum(axis=1) > 4 * self.k)
        if len(many):
            # what lies below a list's k-th in this product alone can't be among its best
            floor = np.iinfo(np.int64).min
            kth = np.partition(np.where(good[many], score[many], floor), -self.k, axis=1)[:, -self.k]
            good[many] &= score[many] >= kth[:, None]
        i, j = np.nonzero(good)
        if not len(i):
            return
        mine = np.zeros(len(i), np.int64) if own is None else own[i, j].astype(np.int64)
        touched = np.unique(rows[i])
        inside = np.isin(self.at, touched)
        at, sc, id_, ow = (np.r_[a[inside], b] for a, b in ((self.at, rows[i]), (self.score, score[i, j]), (self.id, ids[j]), (self.own, mine)))
        order = np.lexsort((id_, -sc, at))
        at, sc, id_, ow = (x[order] for x in (at, sc, id_, ow))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[first, len(at)])
        place = np.arange(len(at)) - np.repeat(first, size)
        keep = place < self.k
        last = place == self.k - 1
        self.least[at[last]] = sc[last]
        self.at, self.score, self.id, self.own = (np.r_[a[~inside], b[keep]] for a, b in ((self.at, at), (self.score, sc), (self.id, id_), (self.own, ow)))


def _scored(anchors: np.ndarray, candidates: np.ndarray, kind: type) -> np.ndarray:
    out = anchors.astype(kind, copy=False) @ candidates.astype(kind, copy=False).T
    return out.astype(np.int64, copy=False)


def _parts(batch, dim: int, n_anchors: int):
    """A batch's ids, labels and vectors in parts whose product with so many anchors stays in bounds."""
    step = max(1, min(CELLS // max(1, n_anchors), tx.SLICE_BYTES * 2 // (8 * max(1, dim))))
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part.column("id").to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False), _matrix(part.column("v"), dim)


def _positives(block, dim: int, kind: type, k: int):
    """Each task's k + 1 best of an anchor's label; the anchor itself, where it is among them, is marked."""

    def run(batches):
        ids, labels, vectors = block()
        vectors = vectors.astype(kind)
        best = Best(len(ids), k + 1)
        for batch in batches:
            for own_ids, own_labels, own in _parts(batch, dim, len(ids)):
                for label in np.intersect1d(own_labels, labels):
                    a, c = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
                    score = _scored(vectors[a], own[c], kind)
                    same = ids[a][:, None] == own_ids[c][None, :]
                    for i, j in zip(*np.nonzero(same)):
                        same[i, j] = np.array_equal(vectors[a[i]].astype(np.int64), own[c[j]])
                    best.add(a, score, np.ones(score.shape, bool), own_ids[c], same)
        yield pa.RecordBatch.from_arrays([pa.array(best.at), pa.array(best.id), pa.array(best.score), pa.array(best.own)], names=["anchor", "id", "score", "own"])

    return run


def _negatives(block, windows, dim: int, kind: type, k: int):
    """Each task's k best of another label inside each window."""

    def run(batches):
        ids, labels, vectors = block()
        anchor, low, high = windows()
        vectors = vectors.astype(kind)
        best = Best(len(anchor), k)
        # the windows of an anchor, slot by slot, so that one product serves all of them
        slot = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        for batch in batches:
            for own_ids, own_labels, own in _parts(batch, dim, len(ids)):
                score = _scored(vectors, own, kind)
                other = labels[:, None] != own_labels[None, :]
                for s in range(int(slot.max(initial=-1)) + 1):
                    rows = np.flatnonzero(slot == s)
                    sc = score[anchor[rows]]
                    best.add(rows, sc, other[anchor[rows]] & (sc >= low[rows, None]) & (sc <= high[rows, None]), own_ids)
        yield pa.RecordBatch.from_arrays([pa.array(best.at), pa.array(best.id), pa.array(best.score)], names=["window", "id", "score"])

    return run


def _blocks(anchors: DataFrame, dim: int):
    """The anchors' ids, labels and vectors, a block at a time, sorted by label. A partition of them at most is on the
    driver beside the block."""
    size, held = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim)))), []

    def packed():
        held.sort(key=lambda r: (r["label"], r["id"], r["v"]))
        out = np.zeros((len(held), dim), np.int64)
        for k, r in enumerate(held):
            out[k, : len(r["v"])] = r["v"]
        return np.array([r["id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), out

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield packed()
            held = []
    if held:
        yield packed()


def mined(rows: DataFrame, is_anchor, *, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), path: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: as ``quantized`` gives them;
    is_anchor: a condition on id; window: the least and the most percent of the positive's score that a negative may have;
    path: a folder below the shared one for the blocks' results, by default a new one."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    path = path or f"{shared_dir(spark)}/sylvaframe/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.max(most).alias("all"), F.max(F.when(is_anchor, most)).alias("anchors")).first()
    dim = facts["dim"] or 0
    kind = _product(dim, facts["all"] or 0, facts["anchors"] or 0)
    anchors = rows.filter(is_anchor).groupBy("id", "label", "v").agg(F.count("*").alias("copies")).drop("copies")
    k, (low, high) = 0, window
    for k, (ids, labels, vectors) in enumerate(_blocks(anchors, dim), 1):
        block = shipped(spark, (ids, labels, vectors))
        found = rows.mapInArrow(_positives(block, dim, kind, positives), "anchor long, id long, score long, own long")
        by = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
        best = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= positives + 1).toPandas()  # of one block
        best = best.sort_values(["anchor", "r"])
        # one row is the anchor itself; where it is not among the best, the last one is too many
        best = best[~((best["own"] == 1) & ~best[best["own"] == 1].duplicated("anchor").reindex(best.index, fill_value=True))]
        best = best[best.groupby("anchor").cumcount() < positives].reset_index(drop=True)
        a, p, s = (best[c].to_numpy(np.int64) for c in ("anchor", "id", "score"))
        lo, hi = (np.array([int(x) for x in v], np.int64) for v in ([-(-low * int(x) // 100) for x in s], [high * int(x) // 100 for x in s]))
        windows = shipped(spark, (a, lo, hi))
        found = rows.mapInArrow(_negatives(block, windows, dim, kind, negatives), "window long, id long, score long")
        by = W.partitionBy("window").orderBy(F.desc("score"), "id")
        best = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
        own = spark.createDataFrame([(i, int(ids[x]), int(y), int(z)) for i, (x, y, z) in enumerate(zip(a, p, s))], "w long, anchor_id long, positive_id long, positive_score long")
        out = best.join(F.broadcast(own), F.col("window") == F.col("w"))  # at most positives rows for each anchor of a block
        out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("overwrite").parquet(f"{path}/block={k}")
    if not k:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", block int").parquet(path).drop("block")
