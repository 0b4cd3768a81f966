"""Ranked lexical search by best-first branch and bound over hierarchical max trees.

**Index.** A task cuts the documents that Spark's scan hands it into segments of about ``SEGMENT`` bytes and counts each
term's occurrences in each document there; the text is read once. Segments are stored; the numbers of documents and terms
are sums over them. A second job turns each segment's counts into saturated weights and builds, for each term, a tree over
the segment's document ranges: a node holds the largest weight of the ``FAN`` ranges below it, nodes without the term are
left out, and the lowest level is the documents'. A segment is one row. The segments are the children of the whole.

**Search.** Items are dealt out in blocks, whose terms, weights and thresholds travel with the tasks. The roots of all
segments give each item an upper bound for each segment. The ``OPEN`` segments of the highest bounds are searched first; the
k-th score found is a threshold, below which no other segment is opened. In a segment a heap holds nodes by the sum of
their terms' maxima: the highest is opened, its children's sums are taken, and what can't reach the threshold is left out.
Documents leave the heap in the order of their scores; nodes whose bound equals the k-th score are opened too, for
documents of equal scores and smaller ids. Tasks hand on the best k of each item, which are merged.

Scores are integers: see ``weight`` and ``saturated``. Equal words are told by a 64-bit hash, their length and first eight
bytes, and by themselves where texts meet items.

Defined cases: a null text, an empty one and one without terms count for nothing and are never found; a null document id
comes after all others among equal scores; documents of one id are documents of their own; items of equal id and text count
once, those of one id and unlike texts are ranked by themselves; an item without terms, or none that any document has,
gives no row; very long texts run whole, in a segment of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops as tx
from .common import shared_dir, shipped, stored

SEGMENT = 4 << 20
FAN = 8
#: Items, and bytes of their texts, that are searched together.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Segments that are searched before the others.
OPEN = 2
#: Items' distinct terms up to which an index made for them leaves all other terms out.
VOCABULARY = 1_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LAST = np.iinfo(np.int64).max
COUNTED = "segment long, n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<string>, count array<int>, node array<int>, tf array<int>"
INDEX = "segment long, ids array<long>, terms array<string>, top array<long>, df array<int>, levels array<struct<count: array<int>, node: array<int>, value: array<int>>>"


def weight(n_docs: int, df: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's occurrences in a document of a length are worth."""
    if len(length) and 90 * int(length.max()) * n_docs >= 1 << 63:
        length = length.astype(object)
    m = (10 + 90 * length * n_docs // max(1, n_terms)).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _same_word(h: np.ndarray, head: np.ndarray, size: np.ndarray, order: np.ndarray) -> bool:
    """Whether all words of one hash agree in length and first bytes. order: ascending by hash."""
    a, b = order[:-1], order[1:]
    return not ((h[a] == h[b]) & ((head[a] != head[b]) | (size[a] != size[b]))).any()


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of a byte buffer, A-Z lower-cased, as strings."""
    size = ends - starts
    upto = np.r_[0, np.cumsum(size)]
    raw = tx.LOWER[data[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], size)]]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def counted_segment(ids: pa.Array, col: pa.Array, segment: int, wanted: np.ndarray | None = None) -> pa.RecordBatch:
    """One row of ``COUNTED``: distinct terms, for each the number of documents that hold it, and these documents' numbers
    and counts. wanted: ascending hashes of the terms to keep."""
    data, offsets = tx.buffers(col)
    starts, ends, doc = tx.words(data, offsets, tx.PUNCT)
    length = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    h, head = tx.hash_words(data, starts, ends, heads=True)
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
        on = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, np.int64)
        starts, ends, doc, h, head = starts[on], ends[on], doc[on], h[on], head[on]
    order = np.argsort(h, kind="stable")
    if not _same_word(h, head, ends - starts, order):
        codes: dict = {}
        h = np.array([codes.setdefault(tx.LOWER[data[a:b]].tobytes(), len(codes)) for a, b in zip(starts, ends)], np.uint64)
        order = np.argsort(h, kind="stable")
    h, d = h[order], doc[order]
    term_first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[first, len(h)])
    count = np.diff(np.r_[np.searchsorted(first, term_first), len(first)])
    word = order[term_first]
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    terms = pa.ListArray.from_arrays(pa.array([0, len(word)], pa.int32()), _strings(data, starts[word], ends[word]))
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [pa.array([segment]), pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), ids, one(length, pa.int64()), terms, one(count.astype(np.int32), pa.int32()), one(d[first].astype(np.int32), pa.int32()), one(tf.astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in COUNTED.split(", ")])


def tree(count: np.ndarray, node: np.ndarray, value: np.ndarray, size: int):
    """Levels (count, node, value), the first as given, up to one of at most FAN nodes, and each term's maximum. count: the
    nodes of each term, which follow each other; size: how many nodes the first level could have."""
    levels = [(count, node, value)]
    while size > FAN:
        term = np.repeat(np.arange(len(count)), count)
        node, size = node // FAN, -(-size // FAN)
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (node[1:] != node[:-1])]) if len(node) else np.zeros(0, np.int64)
        value = np.maximum.reduceat(value, first) if len(first) else value
        node, count = node[first], np.bincount(term[first], minlength=len(count))
        levels.append((count, node, value))
    begin = np.cumsum(count) - count
    return levels, np.maximum.reduceat(value, begin) if len(count) else np.zeros(0, np.int64)


class Segment:
    """A segment's trees, cut down to the terms of a block of items."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        at = pc.index_in(vocabulary, row["terms"]).to_numpy(zero_copy_only=False)
        self.known = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
        at = at[self.known].astype(np.int64)
        self.place = np.full(len(vocabulary), -1)
        self.place[self.known] = np.arange(len(at))
        self.ids, self.levels = row["ids"], []
        size = len(self.ids)
        for count, node, value in row["levels"]:
            begin = np.cumsum(count) - count
            own = count[at]
            take = np.arange(own.sum()) + np.repeat(begin[at] - (np.cumsum(own) - own), own)
            # ascending, as nodes are within a term
            key = np.repeat(np.arange(len(at)), own) * size + node[take]
            self.levels.append((key, value[take], size))
            size = -(-size // FAN)

    def children(self, level: int, node: int, terms: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray]:
        """The first child of a node, and the summed bounds of its children, which are of the given level."""
        key, value, size = self.levels[level]
        first = node * FAN
        base = terms * size
        a, b = np.searchsorted(key, base + first), np.searchsorted(key, base + min(first + FAN, size))
        n = b - a
        take = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        out = np.zeros(FAN, np.int64)
        np.add.at(out, key[take] - np.repeat(base, n) - first, value[take] * np.repeat(weights, n))
        return first, out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, document number) of the k best documents of at least the score, with all that equal the last."""
        own = self.place[terms]
        terms, weights = own[own >= 0], weights[own >= 0]
        heap, out = [(0, len(self.levels), 0)], []
        while heap:
            bound, level, node = heapq.heappop(heap)
            if level < len(self.levels):
                if len(out) >= k and -bound < out[k - 1][0]:
                    break
                if level == 0:
                    out.append((-bound, node))
                    continue
            first, sums = self.children(level - 1, node, terms, weights)
            for i in np.flatnonzero(sums >= max(1, least)).tolist():
                heapq.heappush(heap, (-int(sums[i]), level - 1, first + i))
        return out


def _numbers(scalar, kind) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """The stored index, the number of documents with a term, and of their terms. terms: the distinct terms (column term) to
    keep, for an index that serves stated items; with more than ``VOCABULARY`` of them all terms are kept."""
    spark = docs.sparkSession
    held = None
    if terms is not None and terms.count() <= VOCABULARY:
        data, offsets = tx.buffers(pa.array([r["term"] for r in terms.collect()], pa.string()))
        held = shipped(spark, np.unique(tx.hash_words(data, offsets[:-1], offsets[1:])))

    def count(batches):
        wanted, at = held and held(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in tx.slices(batch, "text", SEGMENT):
                yield counted_segment(part.column("id"), part.column("text"), at, wanted)
                at += 1

    counted = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, COUNTED), "counted")
    total = counted.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = total["d"] or 0, total["t"] or 0

    def grow(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                count, node, tf, length = (_numbers(row[c], np.int64) for c in ("count", "node", "tf", "lengths"))
                levels, top = tree(count, node, saturated(tf, length[node], n_docs, n_terms), len(length))
                flat = [pa.array([x.astype(kind) for level in levels for x in (level[j],)], pa.list_(pa.from_numpy_dtype(kind))) for j, kind in enumerate((np.int32,) * 3)]  # weights are below a million
                grown = pa.ListArray.from_arrays(pa.array([0, len(levels)], pa.int32()), pa.StructArray.from_arrays(flat, names=["count", "node", "value"]))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("segment"), one.column("ids"), one.column("terms"), pa.array([top], pa.list_(pa.int64())), one.column("count"), grown], names=["segment", "ids", "terms", "top", "df", "levels"])

    index = counted.select("segment", "ids", "terms", "count", "node", "tf", "lengths").mapInArrow(grow, INDEX)
    return stored(index, "index"), n_docs, n_terms


def terms_of(text_col: str):
    """Column: the distinct terms of a text."""
    upper = "".join(map(chr, range(65, 91)))
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0)))


class Block:
    """Items of a block as entries (item, term), ascending by item; terms are numbers of the vocabulary."""

    def __init__(self, rows: list):
        number: dict[str, int] = {}
        self.entries = [np.array([number.setdefault(t, len(number)) for t in r["terms"]], np.int64) for r in rows]
        self.vocabulary = list(number)
        self.weights = np.zeros(len(number), np.int64)

    def weighted(self, df: dict[int, int], n_docs: int) -> None:
        """Leave the terms out that weigh nothing."""
        for t, n in df.items():
            self.weights[t] = weight(n_docs, n)
        self.entries = [e[self.weights[e] > 0] for e in self.entries]

    def bounds(self, top: np.ndarray) -> np.ndarray:
        """The items' bounds in a segment from the terms' maxima there."""
        size = np.fromiter(map(len, self.entries), np.int64, len(self.entries))
        flat = np.concatenate([*self.entries, np.zeros(0, np.int64)])
        out = np.zeros(len(size), np.int64)
        np.add.at(out, np.repeat(np.arange(len(size)), size), self.weights[flat] * top[flat])
        return out


def _at(vocabulary: pa.Array, row_terms: pa.Array, values: np.ndarray) -> np.ndarray:
    """Values of a segment's terms for each term of the vocabulary, 0 where the segment lacks it."""
    at = pc.fill_null(pc.index_in(vocabulary, row_terms), len(values)).to_numpy(zero_copy_only=False)
    return np.r_[values, 0][at]


def _segments(batch, wanted=None):
    for i in range(batch.num_rows):
        if wanted is None or batch.column("segment")[i].as_py() in wanted:
            yield batch.slice(i, 1)


def _first(batch, name: str):
    return batch.column(name)[0]


def _row(one) -> dict:
    levels = [tuple(x[c].values.to_numpy().astype(np.int64) for c in ("count", "node", "value")) for x in _first(one, "levels")]
    return {"terms": _first(one, "terms").values, "ids": _first(one, "ids").values, "levels": levels}


def ranked(index: DataFrame, n_docs: int, items: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """item id, rank, document id, score of each item's k best documents. path: a folder below the shared one for the
    blocks' results, by default a new one."""
    spark = index.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates().select("id", terms_of("text").alias("terms")).filter(F.size("terms") > 0)
    path = path or f"{shared_dir(spark)}/sylvaframe/ranked-{uuid.uuid4().hex}"
    b = 0
    for b, part in enumerate(_blocks(rows), 1):
        found = _block(index, n_docs, part, k)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(part)], f"i int, id {kind}")
        out = found.join(F.broadcast(names), F.col("item") == F.col("i"))  # at most BLOCK rows
        out.select(F.col("id").alias(id_col), "rank", F.col("doc").alias(doc_col), "score").write.mode("overwrite").parquet(f"{path}/block={b}")
    schema = f"{id_col} {kind}, rank int, {doc_col} long, score long"
    if not b:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", block int").parquet(path).drop("block")


def _blocks(rows: DataFrame):
    """Items in lists of bounded length and size; a partition of them at most is on the driver beside the list."""
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append(row)
        size += sum(map(len, row["terms"]))
        if len(held) == BLOCK or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _block(index: DataFrame, n_docs: int, part: list, k: int) -> DataFrame:
    """(item, rank, doc, score) of a block's items; item: the place in the block."""
    spark, block = index.sparkSession, Block(part)
    own = shipped(spark, block)

    def holders(batches):
        b = own()
        words, total = pa.array(b.vocabulary, pa.string()), np.zeros(len(b.vocabulary), np.int64)
        for batch in batches:
            for one in _segments(batch):
                total += _at(words, _first(one, "terms").values, _numbers(_first(one, "df"), np.int64))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    df = index.select("segment", "terms", "df").mapInArrow(holders, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    block.weighted({r["term"]: r["n"] for r in df.collect()}, n_docs)
    weighed = shipped(spark, block)

    def rooted(batches):
        b = weighed()
        words = pa.array(b.vocabulary, pa.string())
        for batch in batches:
            for one in _segments(batch):
                bound = b.bounds(_at(words, _first(one, "terms").values, _numbers(_first(one, "top"), np.int64)))
                on = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(np.full(len(on), _first(one, "segment").as_py())), pa.array(bound[on])], names=["item", "segment", "bound"])

    bounds = index.select("segment", "terms", "top").mapInArrow(rooted, "item long, segment long, bound long")
    by = W.partitionBy("item").orderBy(F.desc("bound"), "segment")
    first = bounds.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= OPEN).collect()
    chosen: dict[int, list[int]] = {}
    for r in first:
        chosen.setdefault(r["segment"], []).append(r["item"])
    begun = shipped(spark, chosen)

    def searched(batches, least: np.ndarray, only: bool):
        """The task's best of each item. only: the chosen pairs of item and segment, else all others."""
        b, pairs = weighed(), begun()
        words, best = pa.array(b.vocabulary, pa.string()), {}
        for batch in batches:
            for one in _segments(batch, pairs if only else None):
                mine = pairs.get(_first(one, "segment").as_py(), [])
                if not only:
                    bound = b.bounds(_at(words, _first(one, "terms").values, _numbers(_first(one, "top"), np.int64)))
                    bound[mine] = 0
                    mine = np.flatnonzero(bound >= np.maximum(1, least)).tolist()
                if not mine:
                    continue
                segment = Segment(_row(one), words)
                ids = pc.fill_null(segment.ids, _LAST).to_numpy(zero_copy_only=False)
                for i in mine:
                    found = segment.best(b.entries[i], b.weights[b.entries[i]], k, int(least[i]))
                    held = sorted([*best.get(i, []), *((-s, int(ids[d]), segment.ids[d].as_py()) for s, d in found)], key=lambda x: x[:2])[:k]
                    best[i] = held
                    if len(held) == k:
                        least[i] = max(int(least[i]), -held[-1][0])
            tx.returned()
        flat = [(i, d, -s) for i, held in best.items() for s, _, d in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)], names=["item", "doc", "score"])

    schema, columns, n = "item long, doc long, score long", ["segment", "ids", "terms", "top", "levels"], len(part)
    few = index.filter(F.col("segment").isin(list(chosen))).select(*columns).mapInArrow(lambda x: searched(x, np.zeros(n, np.int64), True), schema)
    by = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    few = few.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).collect()
    least = np.zeros(n, np.int64)
    for r in few:
        if r["rank"] == k:
            least[r["item"]] = r["score"]
    floor = shipped(spark, least)
    rest = index.select(*columns).mapInArrow(lambda x: searched(x, floor(), False), schema)
    known = spark.createDataFrame([(r["item"], r["doc"], r["score"]) for r in few], schema)
    return rest.unionAll(known).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rank all documents for stated items: an index of the items' terms, and the search."""
    terms = items.select(F.explode(terms_of(text_col)).alias("term")).distinct()
    index, n_docs, _ = build(docs, id_col=id_col, text_col=text_col, terms=terms)
    return ranked(index, n_docs, items, k=k, id_col=item_col, text_col=text_col, doc_col=id_col)
