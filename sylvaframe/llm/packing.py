"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

Each task packs the documents that Spark's scan hands it, as they come, without a shuffle. A document's tokens that fill
whole windows are cut off as sequences of their own; what is left, less than a window, is placed online: of the windows with
room, told apart by nothing but their fill level, it goes to the level for which the sum over all levels of the squared
number of partially filled windows becomes least, or opens a new window if that is better. A level array counts the
windows of each level. Of equal choices the fullest window wins, and of one level's windows the one filled last.

No document but those longer than a window is cut so far. At a task's end, open windows that fill each other up exactly are
joined, and those whose level is a power of two are done, as they need no padding. The others are poured together in the
order of their levels, cut where a sequence is full, and the last remainder becomes sequences of powers of two. So nothing
is ever padded, and a task's cuts beyond those of long documents are fewer than its windows that were open at its end, and
a remainder's bits.

Defined cases: a null text counts as empty and has the end id alone; null, equal and repeated ids are documents of their
own; a very long text is tokenized in stretches (beside its bytes a task holds its ids); ties as above; an empty table
gives no rows; other columns are ignored. Sequence ids are unique and start with the number of the task; a task that runs
again gives the same ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .tokenfiles import _tokenizer
from .wordtokens import stretches

WINDOW = 2048
END = 1
#: Tokens of finished sequences that a task holds before it hands them on.
HELD = 1 << 20


class Levels:
    """Open windows by fill level: how many there are, and what they hold."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list]] = {}

    def choice(self, n: int) -> int:
        """The level at which n tokens are placed; 0 is a new window."""
        count = self.count
        at = np.flatnonzero(count[1 : self.size - n + 1]) + 1
        new = 2 * int(count[n]) + 1
        if not len(at):
            return 0
        # what the sum of squares grows by; a window that is filled up leaves the array
        change = 2 * (count[at + n] - count[at]) + 2 - (at + n == self.size)
        k = len(at) - 1 - int(np.argmin(change[::-1]))
        return int(at[k]) if change[k] <= new else 0

    def place(self, piece: tuple) -> list | None:
        """Put a piece, whose last item is its tokens, into a window; the window's pieces if it is now full."""
        n = len(piece[-1])
        level = self.choice(n)
        window = []
        if level:
            window = self.windows[level].pop()
            self.count[level] -= 1
        window.append(piece)
        level += n
        if level == self.size:
            return window
        self.windows.setdefault(level, []).append(window)
        self.count[level] += 1
        return None

    def rest(self):
        """The windows that are still open, as sequences that need no padding."""
        poured = []
        for level in np.flatnonzero(self.count)[::-1].tolist():
            rest = self.windows.get(self.size - level, []) if 2 * level > self.size else []
            while self.windows[level]:
                window = self.windows[level].pop()
                if rest:
                    yield window + rest.pop()
                elif level & (level - 1):
                    poured += window
                else:
                    yield window
        left = sum(len(p[-1]) for p in poured)
        out, room = [], self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)
        for row, start, total, ids in poured:
            while len(ids):
                out.append((row, start, total, ids[:room]))
                n = min(room, len(ids))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    yield out
                    out, room = [], self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)


def _batch(kind: pa.DataType, first: int, sequences: list[list]) -> pa.RecordBatch:
    pieces = [p for s in sequences for p in s]
    each = np.fromiter(map(len, sequences), np.int64, len(sequences))
    size = np.fromiter((len(p[-1]) for p in pieces), np.int64, len(pieces))
    upto = np.cumsum(size)
    end = upto[np.cumsum(each) - 1]
    begin = np.r_[0, end[:-1]]
    fields = [pa.array([p[0] for p in pieces], kind), pa.array([p[1] for p in pieces], pa.int64()), pa.array(size), pa.array(upto - size - np.repeat(begin, each)), pa.array([p[2] for p in pieces], pa.int64())]
    held = pa.StructArray.from_arrays(fields, names=["doc", "start", "length", "offset", "doc_tokens"])
    bounds = pa.array(np.r_[0, np.cumsum(each)].astype(np.int32))
    tokens = tx.list_array(np.concatenate([p[-1] for p in pieces]).astype(np.int32), end - begin)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(sequences))), tokens, pa.ListArray.from_arrays(bounds, held)], names=["sequence_id", "tokens", "pieces"])


def packed(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, tokens array<int> and pieces array<struct<doc, start, length, offset, doc_tokens>>: the sequences.
    tokenizer: a file that every executor can open at this path."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own, levels, at = _tokenizer(tokenizer), Levels(window), TaskContext.get().partitionId() << 40
        done: list[list] = []
        held, type_ = 0, None

        def flushed(least: int):
            nonlocal done, held, at
            if done and held >= least:
                yield _batch(type_, at, done)
                at += len(done)
                done, held = [], 0

        for batch in batches:
            type_ = batch.column("id").type
            for part in tx.slices(batch, "text"):
                data, offsets = tx.buffers(part.column("text"))
                if len(data) > 2 * tx.SLICE_BYTES:  # one text
                    flat = np.concatenate([*(own.encode(x, np.array([0, len(x)]))[0] for x in stretches(data)), np.array([] if end is None else [end], np.uint32)])
                    size = np.array([len(flat)])
                else:
                    flat, size = own.encode(data, offsets, end)
                stop = np.cumsum(size)
                for row, a, b in zip(part.column("id").to_pylist(), (stop - size).tolist(), stop.tolist()):
                    total, cut = b - a, b - (b - a) % window
                    for k in range(a, cut, window):
                        done.append([(row, k - a, total, flat[k : k + window])])
                        held += window
                        yield from flushed(HELD)
                    if cut < b and (full := levels.place((row, cut - a, total, flat[cut:b].copy()))):
                        done.append(full)
                        held += window
                yield from flushed(1)
        for sequence in levels.rest():
            done.append(sequence)
            held += window
            yield from flushed(HELD)
        yield from flushed(1)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"sequence_id long, tokens array<int>, pieces array<struct<doc: {kind}, start: bigint, length: bigint, offset: bigint, doc_tokens: bigint>>")


def digests(sequences: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per piece: id, start, length, ids_crc32 (unsigned, of its ids as little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id, offset."""
    kind = sequences.schema["pieces"].dataType.elementType["doc"].dataType.simpleString()
    plain = ["doc", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            size = 4 * pc.list_value_length(ids).to_numpy()
            raw, stop = memoryview(ids.flatten().to_numpy().astype("<u4", copy=False)).cast("B"), np.cumsum(size)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((stop - size).tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(crc, pa.int64())], names=[*plain, "ids_crc32"])

    pieces = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("p"))
    pieces = pieces.select("p.doc", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset", F.slice("tokens", F.col("p.offset").cast("int") + 1, F.col("p.length").cast("int")).alias("ids"))
    out = pieces.mapInArrow(run, f"doc {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    return out.withColumnRenamed("doc", id_col)
