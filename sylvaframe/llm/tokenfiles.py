"""Token files: texts to ids, ids to range-coded segments, and back.

Documents are dealt to partitions by ascending id, as many as their counted bytes ask for, and sorted there. Each partition
tokenizes its texts (see ``wordtokens``) and packs the ids into segments of whole documents (see ``rangecoder``): as many
as fit a block, or one longer document in several blocks. Segments are binary values of a Parquet data set in the shared
folder, written by Spark's committer, so a lost executor costs only its tasks. Reading decodes segments independently; a
document's start is the ids of earlier segments, a running sum over segment counts.

Defined cases: a null text counts as empty and has the end id alone; equal ids stand in the order of a hash of their texts;
a null id comes first; a very long text is tokenized in stretches and coded block by block, so that beside its own bytes
and its coded form a task holds one block; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rangecoder as rc
from . import textops as tx
from .common import shared_dir, utf8_size
from .wordtokens import WordTokenizer, stretches

#: Bytes of text that a partition is to have.
PARTITION_BYTES = 32 << 20
END = 2


def _tokenizer(path: str) -> WordTokenizer:
    """A worker keeps its tokenizer from task to task."""
    kept = sys.modules.setdefault("_sylvaframe_worker", types.ModuleType("_sylvaframe_worker")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def partitions(docs: DataFrame, text_col: str = "text") -> int:
    total = docs.agg(F.sum(utf8_size(text_col) + 64)).first()[0] or 0
    return max(1, -(-total // PARTITION_BYTES))


def write(docs: DataFrame, tokenizer: str, *, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", block: int = rc.BLOCK) -> str:
    """Write the documents' ids and return the path. tokenizer: a file that every executor can open at this path."""
    spark = docs.sparkSession

    def run(batches):
        own, part, seg = _tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        packer = rc.Packer(own.vocabulary, block)

        def out():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "n_tokens": pa.array([packer.n], pa.int64()), "segment": pa.array([packer.segment()], pa.large_binary()).cast(pa.binary())})

        for batch in batches:
            for piece in tx.slices(batch, "text"):
                ids = piece.column("id").to_pylist()
                data, offsets = tx.buffers(piece.column("text"))
                if len(data) > 2 * tx.SLICE_BYTES:  # one text, tokenized in stretches
                    if packer.ids:
                        yield out()
                        packer, seg = rc.Packer(own.vocabulary, block), seg + 1
                    packer.add(ids, [0], np.zeros(0, np.uint32))
                    for x in stretches(data):
                        packer.more(own.encode(x, np.array([0, len(x)]))[0])
                    packer.more(np.array([] if end is None else [end], np.uint32))
                    continue
                flat, size = own.encode(data, offsets, end)
                upto, i = np.cumsum(size), 0
                while i < len(ids):
                    # as many documents as the block has room for
                    done = int(upto[i - 1]) if i else 0
                    j = int(np.searchsorted(upto, done + block - packer.n, "right"))
                    if j <= i and packer.ids:
                        yield out()
                        packer, seg = rc.Packer(own.vocabulary, block), seg + 1
                        continue
                    j = max(j, i + 1)
                    packer.add(ids[i:j], size[i:j].tolist(), flat[done : int(upto[j - 1])])
                    i = j
        if packer.ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    path = f"{shared_dir(spark)}/sylvaframe/tokens-{uuid.uuid4().hex}"
    rows.repartitionByRange(partitions(docs, text_col), "id", "h").sortWithinPartitions("id", "h").select("id", "text").mapInArrow(run, "part int, seg int, n_tokens long, segment binary").write.option("compression", "none").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """Per document: id, start, n_tokens, tokens, decoded from the files."""

    def of(segment: bytes):
        ids, size, blocks = rc.unpack(segment)
        flat = np.concatenate([np.zeros(0, np.uint32), *blocks]).astype(np.int64)
        return ids, size, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))

    return _decoded(spark, path, of, "tokens array<long>")


def crcs(size: np.ndarray, blocks) -> list[int]:
    """The crc32 of each document's ids, which come a block at a time."""
    out, now, left, k = [], 0, int(size[0]) if len(size) else 0, 0
    for flat in blocks:
        raw, at = memoryview(flat.astype("<u4").tobytes()), 0
        while k < len(size) and (at < len(flat) or not left):
            n = min(left, len(flat) - at)
            now = zlib.crc32(raw[4 * at : 4 * (at + n)], now)
            at, left = at + n, left - n
            if not left:
                out.append(now)
                now, k = 0, k + 1
                left = int(size[k]) if k < len(size) else 0
    return out + [0] * (len(size) - len(out))


def digests(spark, path: str) -> DataFrame:
    """Per document: id, start, n_tokens and the unsigned crc32 of its ids as little-endian unsigned 32-bit integers."""

    def of(segment: bytes):
        ids, size, blocks = rc.unpack(segment)
        return ids, size, pa.array(crcs(size, blocks), pa.int64())

    return _decoded(spark, path, of, "ids_crc32 long")


def _decoded(spark, path: str, of, column: str) -> DataFrame:
    name = column.split(" ")[0]

    def run(batches):
        for batch in batches:
            for part, seg, segment in zip(*(batch.column(c) for c in ("part", "seg", "segment"))):
                ids, size, found = of(segment.as_py())
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seg.as_py()] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(np.cumsum(size) - size), pa.array(size), found], names=["part", "seg", "id", "at", "n_tokens", name])

    stored = spark.read.schema("part int, seg int, n_tokens long, segment binary").parquet(path)
    rows = stored.select("part", "seg", "segment").mapInArrow(run, f"part int, seg int, id long, at long, n_tokens long, {column}")
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("part").alias("__p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("__base"))
    segs = stored.select("part", "seg", "n_tokens").join(parts, F.col("part") == F.col("__p"))
    segs = segs.select(F.col("part").alias("__p"), F.col("seg").alias("__s"), (F.col("__base") + F.sum("n_tokens").over(W.partitionBy("part").orderBy("seg")) - F.col("n_tokens")).alias("__start"))
    return rows.join(segs, (F.col("part") == F.col("__p")) & (F.col("seg") == F.col("__s"))).select("id", (F.col("__start") + F.col("at")).alias("start"), "n_tokens", name)
