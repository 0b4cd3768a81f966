"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint retains every shingle hash below ``2**BITS / scale``. The fingerprint of a union is computable from the
fingerprints of its parts, and because the threshold is the same for all texts, the share of a small sketch that a large
one holds estimates containment however unequal the documents are. Texts of at most ``WHOLE`` shingles retain all their
hashes: between two of them containment is exact; against a larger text only their hashes below the threshold count, for
only of those it is known whether the larger text has them. Where there are none, the sketches say nothing: ``likeness``
is None, and ``alike`` takes sketches of equal size that retain the same for equal and others for unlike.

Written form: ``k:scale:n:`` followed by the retained hashes, ascending, five bytes each, in base64; n is the number of
distinct shingles.

Defined cases: null counts as the empty text; a text without words has an empty sketch, alike (1.0) to another such text
and to nothing else (0.0); a text of fewer words than a shingle is one shingle; very long texts are hashed in windows and
keep as many hashes as the threshold says; equal hashes in a text are one; equal texts and repeated rows have equal
fingerprints; rows with equal ids are neighbours in any order of their texts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import utf8_size

K = 5
SCALE = 4
BITS = 40
WHOLE = 32
#: Bytes of text that a partition of neighbours is to have.
PARTITION_BYTES = 32 << 20
_NULL = -(1 << 63)


class Sketch(NamedTuple):
    """Retained hashes, ascending, and the number of distinct shingles (estimated in unions)."""

    kept: np.ndarray
    n: int


def _scaled(full: np.ndarray, scale: int) -> Sketch:
    return Sketch(full if len(full) <= WHOLE else full[: np.searchsorted(full, (1 << BITS) // scale)], len(full))


def shingle_sets(col: pa.Array, k: int = K) -> list[np.ndarray]:
    """All shingle hashes of each text, distinct and ascending."""
    data, offsets = tx.buffers(col)
    starts, ends, doc = tx.words(data, offsets, tx.SPACE)
    full, owner = tx.shingles(tx.hash_words(data, starts, ends), doc, k)
    full = full >> np.uint64(64 - BITS)
    at = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(full[a:b]) for a, b in zip(at, at[1:])]


def sketches(col: pa.Array, k: int = K, scale: int = SCALE) -> list[Sketch]:
    return [_scaled(x, scale) for x in shingle_sets(col, k)]


def written(sketch: Sketch, k: int = K, scale: int = SCALE) -> str:
    raw = sketch.kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()
    return f"{k}:{scale}:{sketch.n}:{base64.b64encode(raw).decode()}"


def read(fingerprint: str) -> Sketch:
    _, _, n, raw = fingerprint.split(":")
    flat = np.frombuffer(base64.b64decode(raw), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, : BITS // 8] = flat
    return Sketch(out.reshape(-1).view("<u8").astype(np.uint64), int(n))


def merge(a: Sketch, b: Sketch, scale: int = SCALE) -> Sketch:
    """The sketch of the union of two shingle sets."""
    both = np.union1d(a.kept, b.kept)
    if len(a.kept) == a.n and len(b.kept) == b.n:
        return _scaled(both, scale)
    kept = both[: np.searchsorted(both, (1 << BITS) // scale)]
    return Sketch(kept, max(a.n, b.n, len(kept) * scale, WHOLE + 1))


def likeness(a: Sketch, b: Sketch, scale: int = SCALE) -> float | None:
    """Containment: the share of the smaller set that the larger one holds. None where the sketches can't tell."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    x, y = (a, b) if a.n <= b.n else (b, a)
    small, large = x.kept, y.kept
    if len(large) < y.n:
        small = small[: np.searchsorted(small, (1 << BITS) // scale)]
    if a.n == b.n and len(large) > len(small):
        small, large = large, small  # the same either way round
    if not len(small):
        return None
    return len(np.intersect1d(small, large, assume_unique=True)) / len(small)


def alike(a: Sketch, b: Sketch, scale: int = SCALE) -> float:
    """likeness, also where the sketches can't tell: from the sketches alone, whatever the texts were."""
    found = likeness(a, b, scale)
    return float(a.n == b.n and np.array_equal(a.kept, b.kept)) if found is None else found


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """id, n_shingles, fingerprint; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                found = sketches(part.column("text"), k, scale)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.n for s in found], pa.int64()), pa.array([written(s, k, scale) for s in found], pa.string())], names=["id", "n_shingles", "fingerprint"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, last) dealt to partitions by descending id. Each partition ends with the next one's first row,
    marked as last; the final one's is the first of all. Texts are shuffled once."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(utf8_size("text") + 64)).first()[0] or 0
    n = max(1, -(-total // PARTITION_BYTES))
    # ranges of ids, found by shuffling ids alone; the driver gets two ids a partition
    ranges = rows.select("id").repartitionByRange(n, F.desc("id")).groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    lows = np.array(sorted(r["lo"] for r in ranges), np.int64)
    heads = {r["hi"]: len(lows) - 1 - int(np.searchsorted(lows, r["lo"])) for r in ranges}  # place by descending ids
    after = {h: (p - 1) % len(lows) for h, p in heads.items()}  # who wants a head's text too
    shared = spark.sparkContext.broadcast((lows, after))

    @F.pandas_udf("array<struct<p:int,l:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        lows, after = shared.value
        own = len(lows) - np.searchsorted(lows, ids.to_numpy(), "right")
        return pd.Series([[{"p": int(p), "l": False}, {"p": after[i], "l": True}] if i in after else [{"p": int(p), "l": False}] for i, p in zip(ids, own)])

    dealt = rows.withColumn("c", F.explode(places("id"))).select("id", "text", F.col("c.p").alias("place"), F.col("c.l").alias("last"))
    return dealt.repartitionById(max(1, len(lows)), F.col("place")).sortWithinPartitions("last", F.desc("id"), "text").select("id", "text", "last")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (the last third taken from the next document's start,
    in descending order of ids) and their likeness."""

    def run(batches):
        held = None  # the last document, still without its next
        for batch in batches:
            for part in tx.slices(batch, "text"):
                ids, texts, last = (part.column(c).to_pylist() for c in ("id", "text", "last"))
                if True in last:  # what follows the first marked row repeats it
                    n = last.index(True) + 1
                    ids, texts, last = ids[:n], texts[:n], last[:n]
                if held is not None:
                    if held[2]:
                        return
                    ids, texts, last = [held[0], *ids], [held[1], *texts], [held[2], *last]
                held = ids[-1], texts[-1], last[-1]
                n = len(ids) - 1
                if not n:
                    continue
                third = [len(t) // 3 for t in texts[:n]]
                edited = [t[: len(t) - c] + x[:c] for t, x, c in zip(texts, texts[1:], third)]
                own, new = sketches(pa.array(texts, pa.string()), k, scale), sketches(pa.array(edited, pa.string()), k, scale)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i == _NULL else i for i in ids[:n]], pa.int64()),
                        pa.array([len(t) for t in texts[:n]], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array([written(x, k, scale) for x in own[:n]], pa.string()),
                        pa.array([written(x, k, scale) for x in new], pa.string()),
                        pa.array([alike(a, b, scale) for a, b in zip(own, new)], pa.float64()),
                        pa.array([alike(a, b, scale) for a, b in zip(own, own[1:])], pa.float64()),
                    ],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
