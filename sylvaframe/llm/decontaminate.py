"""Benchmark decontamination by an FM-index per training shard.

Each shard (a slice of a partition's texts) is searched for the benchmark's word windows: the shard's words become
symbols, a suffix array gives the Burrows-Wheeler transform, a wavelet tree over it answers ranks, all windows are
searched backward at once, and occurrences are located by walking to sampled suffix positions. The located spans of a
text are merged; ``drop_contaminated`` drops the texts that have any, and ``removed`` cuts them out.

Only words of the benchmark can take part in an occurrence, and only inside runs of such words that are at least as
long as the shortest window. The index therefore holds exactly those runs, which loses no occurrence and keeps the
suffix sort to a small part of the corpus. Every text is read whole.

The benchmark is a stated query set. It goes to the executors in blocks of about ``block_bytes`` of text, and each shard
is searched for one block after another within the same pass over the corpus; of several blocks a worker holds one at a
time.

Defined cases: a null or empty text has no words, hits or items; a null or empty benchmark text has no window; equal
items all count; an empty benchmark leaves all texts clean; rows with equal doc_id are judged each by its own text;
columns other than the id and the text are ignored (``decontaminate``) or kept (``drop_contaminated``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textops as tx

BLOCK_BYTES = 8 << 20
SAMPLE = 8


@dataclass
class Windows:
    """Windows of a block of benchmark items as rows of symbols; symbol 0 separates, 1.. are vocabulary words."""

    vocabulary: np.ndarray
    groups: list  # (length, symbols [n, length], items of each row: list of arrays)
    shortest: int


def compile_windows(items: list[tuple], size: int) -> Windows | None:
    texts = pa.array([t for _, t in items], pa.string())
    data, offsets = tx.buffers(texts)
    starts, ends, doc = tx.words(data, offsets, tx.PUNCT)
    if not len(starts):
        return None
    h = tx.hash_words(data, starts, ends)
    vocabulary = np.unique(h)
    sym = np.searchsorted(vocabulary, h) + 1
    found: dict[int, dict[tuple, set]] = {}
    ids, first, count = np.unique(doc, return_index=True, return_counts=True)
    for d, f, c in zip(ids, first, count):
        n = min(size, c)
        for j in range(c - n + 1):
            found.setdefault(n, {}).setdefault(tuple(sym[f + j : f + j + n]), set()).add(int(d))
    groups = [(n, np.array(list(w), np.int64), [np.array(sorted(x)) for x in w.values()]) for n, w in sorted(found.items())]
    return Windows(vocabulary, groups, min(found))


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    key = seq[sa]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tied = ~(head & np.r_[head[1:], True])
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        pos = sa[at]
        group = rank[pos]
        nxt = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
        order = np.lexsort((nxt, group))
        pos, group, nxt = pos[order], group[order], nxt[order]
        sa[at] = pos
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        head[at] = new
        rank[pos] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2


class WaveletTree:
    """Ranks over a sequence of symbols: one bit plane a level, stably partitioned by the bits above."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            plane = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(plane, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(int(len(seq) - ones[-1]))
            seq = np.r_[seq[plane == 0], seq[plane == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.planes, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        """seq: symbols from 0, all below ``symbols``. A smaller one, unique, ends the indexed text."""
        seq, symbols = np.r_[seq + 1, 0], symbols + 1
        sa = suffix_array(seq)
        self.n, self.sample = len(seq), sample
        self.bwt = seq[sa - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols))]
        self.tree = WaveletTree(self.bwt, max(1, int(symbols - 1).bit_length()))
        self.kept = sa % sample == 0
        self.kept_before = np.r_[0, np.cumsum(self.kept)]
        self.positions = sa[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array range of each pattern, all stepped backward together; empty ones leave early."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j] + 1
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of suffix-array rows by steps to the last sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.kept[at]
            out[open_[hit]] = self.positions[self.kept_before[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            c = self.bwt[at]
            rows[open_] = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


def search(h: np.ndarray, doc: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a shard lie in an occurrence of a window, and the (text, item) pairs that occur."""
    none = np.zeros(len(h), bool), np.zeros((0, 2), np.int64)
    at = np.searchsorted(win.vocabulary, h)
    at[at == len(win.vocabulary)] = 0
    known = win.vocabulary[at] == h
    joined = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
    run_start = np.flatnonzero(known & ~np.r_[False, joined])
    run_end = np.flatnonzero(known & ~np.r_[joined, False]) + 1
    long = run_end - run_start >= win.shortest
    run_start, length = run_start[long], (run_end - run_start)[long]
    if not len(run_start):
        return none
    place = np.r_[0, np.cumsum(length + 1)]
    seq = np.zeros(place[-1], np.int64)
    word_at = np.full(place[-1], -1, np.int64)
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    where = np.repeat(place[:-1], length) + inner
    word_at[where] = np.repeat(run_start, length) + inner
    seq[where] = at[word_at[where]] + 1
    index = FMIndex(seq, len(win.vocabulary) + 1)
    marks, pairs = np.zeros(len(h) + 1, np.int64), [none[1]]
    for n, patterns, items in win.groups:
        if n > length.max():
            continue
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        many = (hi - lo)[hit]
        rows = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = word_at[index.locate(rows)]
        np.add.at(marks, first, 1)
        np.add.at(marks, first + n, -1)
        both = np.unique(np.stack([doc[first], np.repeat(hit, many)], 1), axis=0)
        size = np.array([len(items[p]) for p in both[:, 1]])
        pairs.append(np.stack([np.repeat(both[:, 0], size), np.concatenate([items[p] for p in both[:, 1]])], 1))
    return np.cumsum(marks[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def scan(part: pa.RecordBatch, text: str, blocks) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """Of one shard: words of each text, its merged hit spans, and for each benchmark block the (text, item) pairs."""
    data, offsets = tx.buffers(part.column(text))
    starts, ends, doc = tx.words(data, offsets, tx.PUNCT)
    n_words = np.bincount(doc, minlength=part.num_rows)
    covered, pairs = np.zeros(len(starts), bool), []
    h = tx.hash_words(data, starts, ends)
    for win in blocks:
        if win is None or not len(h):
            pairs.append(np.zeros((0, 2), np.int64))
            continue
        marks, found = search(h, doc, win)
        covered |= marks
        pairs.append(found)
    same = covered[1:] & covered[:-1] & (doc[1:] == doc[:-1])
    a = np.flatnonzero(covered & ~np.r_[False, same]) if len(covered) else np.zeros(0, np.int64)
    b = np.flatnonzero(covered & ~np.r_[same, False]) + 1 if len(covered) else a
    d, before = doc[a], np.r_[0, np.cumsum(n_words)]
    span = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a - before[d], b - before[d], starts[a] - offsets[d], ends[b - 1] - offsets[d])], ["first_word", "end_word", "first_byte", "end_byte"])
    return n_words.astype(np.int64), pa.ListArray.from_arrays(_offsets(d, part.num_rows), span), pairs


def _offsets(owner: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32))


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Benchmark rows in blocks of bounded size: the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def _found(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, keep: tuple = ()) -> DataFrame:
    """__id, __n_words, __spans, __items, and the kept columns in order as __k0, __k1, ..., the text as __text."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    kept = [c for c in keep if c not in (id_col, text_col)]
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)])
    carry = [f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + (["__text string"] if text_col in keep else [])
    schema = ", ".join([f"__id {id_type}", "__n_words long", "__spans array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>", f"__items array<{item_type}>", *carry])
    names = [c.split(" ")[0] for c in carry]

    item_type_pa = to_arrow_type(benchmark.schema[item_col].dataType)
    blocks = []
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        ids = pa.array([i for i, _ in block], item_type_pa)
        win = compile_windows(block, window)
        blocks.append(spark.sparkContext.broadcast((win and (win.vocabulary, win.groups, win.shortest), ids)))

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "__text"):
                own = []  # the items' ids of each block

                def held(own=own):
                    for b in blocks:
                        win, ids = b.value
                        own.append(ids)
                        yield win and Windows(*win)
                        if len(blocks) > 1:
                            b.__dict__.pop("_value", None)  # read again for the next slice

                n_words, spans, pairs = scan(part, "__text", held())
                owner = np.concatenate([p[:, 0] for p in pairs])
                items = pa.concat_arrays([ids.take(pa.array(p[:, 1])) for ids, p in zip(own, pairs)])
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), pa.array(n_words), spans, pa.ListArray.from_arrays(_offsets(owner, part.num_rows), items.take(pa.array(order))), *[part.column(c) for c in names]],
                    names=["__id", "__n_words", "__spans", "__items", *names],
                )

    return source.mapInArrow(run, schema)


def _kept(docs: DataFrame, keep, id_col: str, text_col: str) -> list:
    """The kept columns of ``_found`` under their own names."""
    others = [c for c in keep if c not in (id_col, text_col)]
    own = {**{c: f"__k{i}" for i, c in enumerate(others)}, id_col: "__id", text_col: "__text"}
    return [F.col(own[c]).alias(c) for c in keep]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), **options) -> DataFrame:
    """Per document: ``id_col``, n_words, spans (merged hit word ranges with their byte ranges), items; ``keep`` columns
    follow, but those with the names of these."""
    keep = [c for c in keep if c not in (id_col, "n_words", "spans", "items")]
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, keep=tuple(keep), **options)
    return found.select(F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"), *_kept(docs, keep, id_col, text_col))


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Digest columns per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    id_col = options.get("id_col", "doc_id")
    found = decontaminate(docs, benchmark, **options)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns in their own order."""
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, keep=tuple(docs.columns), **options)
    return found.filter(F.size("__spans") == 0).select(*_kept(docs, docs.columns, id_col, text_col))


def removed(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the hit spans cut out of their texts, from the first to the last hit word of each."""
    found = _found(docs, benchmark, id_col=id_col, text_col=text_col, keep=tuple(docs.columns), **options)
    raw = F.col("__text").cast("binary")
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.end_byte"))
    end = F.concat(F.col("__spans.first_byte"), F.array(F.octet_length("__text").cast("long")))
    left = F.zip_with(begin, end, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.aggregate(left, F.lit(b""), lambda x, y: F.concat(x, y)).cast("string")
    found = found.withColumn("__text", F.when(F.size("__spans") > 0, cut).otherwise(F.col("__text")))
    return found.select(*_kept(docs, docs.columns, id_col, text_col))
