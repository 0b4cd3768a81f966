"""Capture sets over chunks of groups: what every split of many subproblems holds, in one pass.

Groups are stored in chunks of at most ``CHUNK``: for each column the rank of its value (how many of its thresholds the
value reaches, or which category it is), the class counts, the least price, and two hashes. A capture set is written as a
rule, a path of predicates and their signs; a task finds its members in a chunk from the rule, those of rules with a common
beginning together. A histogram of the members' ranks then gives the sums of all splits of a column at once: a suffix sum
for thresholds, the histogram itself for categories. So the work is members x columns, not members x predicates, and what is
shuffled is one array for each subproblem and task, whatever the number of groups.

Sums are exact: values are split into limbs of 31 bits, whose sums over a chunk stay below 2^53 and over all chunks below
2^63; prices of any size follow from the counts in Python integers. A capture set is named by its size and the sums of both
hashes, so equal sets meet whatever their rules are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut

CHUNK = 1 << 16
LIMB = 31
#: Bytes of sums that a task holds for a block of subproblems.
BLOCK_BYTES = 64 << 20
_LOW = (1 << LIMB) - 1
_TWO64 = (1 << 64) - 1


@dataclass(frozen=True)
class Layout:
    """sizes: predicates of each column; ordered: whether they are thresholds; cost [predicted][truth] and unit (the leaf
    penalty) as integers; count_limbs, least_limbs: how values are split."""

    sizes: tuple[int, ...]
    ordered: tuple[bool, ...]
    cost: tuple[tuple[int, ...], ...]
    unit: int
    count_limbs: int = 1
    least_limbs: int = 1
    wide: bool = False
    first: tuple[int, ...] = field(default=())

    @classmethod
    def of(cls, sizes, ordered, cost, unit: int, rows: int) -> Layout:
        """rows: of the whole table, which bound all sums."""
        most = max([abs(x) for row in cost for x in row], default=0) * rows + 4 * abs(unit) + 1
        first = tuple(int(x) for x in np.r_[0, np.cumsum(sizes)][:-1]) if len(sizes) else ()
        return cls(tuple(map(int, sizes)), tuple(map(bool, ordered)), tuple(tuple(map(int, r)) for r in cost), int(unit), 1 + (rows >= 1 << LIMB), most.bit_length() // LIMB + 1, most >= 1 << 62, first)

    @property
    def predicates(self) -> int:
        return sum(self.sizes)

    @property
    def classes(self) -> int:
        return len(self.cost)

    @property
    def width(self) -> int:
        """Limbs of a group's values: one for its own number, its counts, its least price, and both hashes."""
        return 1 + self.count_limbs * self.classes + self.least_limbs + 4

    @property
    def places(self) -> int:
        return sum(self.sizes) + len(self.sizes)

    @property
    def block(self) -> int:
        """Subproblems whose sums a task may hold at a time."""
        return max(1, min(4096, BLOCK_BYTES // (8 * self.width * max(1, self.places))))

    @property
    def kind(self) -> str:
        """The type of costs in tables."""
        return "decimal(38,0)" if self.wide else "bigint"

    def prices(self, counts: np.ndarray) -> np.ndarray:
        """[..., truth] -> [..., predicted]."""
        as_ = object if self.wide else np.int64
        return counts.astype(as_) @ np.array(self.cost, as_).reshape(self.classes, self.classes).T

    def where(self, predicate: int) -> tuple[int, int]:
        """A predicate's column and its place there."""
        c = int(np.searchsorted(self.first, predicate, "right")) - 1
        while not self.sizes[c]:  # of columns that begin at one place the last one has predicates
            c -= 1
        return c, predicate - self.first[c]


def _limbs(x: np.ndarray, n: int) -> list[np.ndarray]:
    out = []
    for _ in range(n - 1):
        out.append((x & _LOW).astype(np.int64))
        x = x >> LIMB
    return [*out, x.astype(np.int64)]


def whole(limbs: np.ndarray, wide: bool) -> np.ndarray:
    """Integers from their limbs' sums, which stand along the first axis."""
    limbs = limbs.astype(object) if wide else limbs
    out = limbs[0]
    for k in range(1, len(limbs)):
        out = out + limbs[k] * (1 << LIMB * k)
    return out


def chunked(groups: DataFrame, ranks: list[str], counts: list[str], layout: Layout) -> DataFrame:
    """(chunk, n, ranks, counts, vals), stored: the columns' ranks as 32-bit integers, one column after another, the class
    counts as 64-bit integers, group after group, and the limbs of all values, one after another. groups: one row for each
    group."""
    n_columns, n_classes = len(ranks), layout.classes

    def chunk(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            own = np.array([table.column(f"r{i}").to_numpy() for i in range(n_columns)], np.int32).reshape(n_columns, n)
            count = np.array([table.column(f"n{j}").to_numpy() for j in range(n_classes)], np.int64).reshape(n_classes, n).T
            least = layout.prices(count).min(axis=1) if n_classes else np.zeros(n, np.int64)
            values = [np.ones(n, np.int64)]
            for j in range(n_classes):
                values += _limbs(count[:, j], layout.count_limbs)
            values += _limbs(least, layout.least_limbs)
            for h in ("ha", "hb"):
                x = table.column(h).to_numpy().view(np.uint64)
                values += [(x & np.uint64(0xFFFFFFFF)).astype(np.int64), (x >> np.uint64(32)).astype(np.int64)]
            columns = {"chunk": [number], "n": pa.array([n], pa.int32()), "ranks": [own.tobytes()], "counts": [np.ascontiguousarray(count).tobytes()], "vals": [np.array(values, np.int64).tobytes()]}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CHUNK - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == CHUNK:
                    yield out()
                    held, size, number = [], 0, number + 1
        if size:
            yield out()

    names = [F.col(c).cast("int").alias(f"r{i}") for i, c in enumerate(ranks)]
    ha, hb = (F.xxhash64(*[F.col(c).cast("int") for c in ranks], F.lit(k)) for k in (1, 2))
    rows = groups.select(*names, *[F.col(c).cast("long").alias(f"n{j}") for j, c in enumerate(counts)], ha.alias("ha"), hb.alias("hb"))
    return cut(rows.mapInArrow(chunk, "chunk long, n int, ranks binary, counts binary, vals binary"), "chunks")


class Chunk:
    """A chunk in a task."""

    def __init__(self, row: dict, layout: Layout):
        n = row["n"]
        self.layout, self.n = layout, n
        self.ranks = np.frombuffer(row["ranks"], np.int32).reshape(len(layout.sizes), n)
        self.counts = np.frombuffer(row["counts"], np.int64).reshape(n, layout.classes)
        self._values = row["vals"]

    def values(self) -> np.ndarray:
        return np.frombuffer(self._values, np.int64).reshape(self.layout.width, self.n)

    def holds(self, predicate: int, at: np.ndarray | None = None) -> np.ndarray:
        c, place = self.layout.where(predicate)
        r = self.ranks[c] if at is None else self.ranks[c][at]
        return r > place if self.layout.ordered[c] else r == place + 1

    def members(self, rules: list[tuple[int, ...]]):
        """(place in the list, positions of the members) of each rule, in ascending order of rules. A rule holds f + 1 where
        predicate f is true and -(f + 1) where it is false."""
        path: list[int] = []
        held = [np.arange(self.n)]
        for k in sorted(range(len(rules)), key=lambda i: rules[i]):
            rule = rules[k]
            same = 0
            while same < min(len(path), len(rule)) and path[same] == rule[same]:
                same += 1
            del path[same:], held[same + 1 :]
            for x in rule[same:]:
                at = held[-1]
                on = self.holds(abs(x) - 1, at)
                held.append(at[on if x > 0 else ~on])
                path.append(x)
            yield k, held[-1]


def rows_of(batches, layout: Layout):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk({c: batch.column(c)[i].as_py() for c in ("n", "ranks", "counts", "vals")}, layout)


def histograms(chunk: Chunk, at: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Add the members' values by rank to out [limb, place]; a column's ranks follow those of the columns before."""
    if not len(at):
        return
    everything = len(at) == chunk.n
    own = weights if everything else weights[:, at]
    place = 0
    for c, size in enumerate(chunk.layout.sizes):
        r = chunk.ranks[c] if everything else chunk.ranks[c][at]
        for v in range(len(own)):
            out[v, place : place + size + 1] += np.bincount(r, own[v], size + 1).astype(np.int64)
        place += size + 1


def totals(chunks: DataFrame, layout: Layout) -> np.ndarray:
    """The limbs' sums over all groups."""

    def add(batches):
        total = np.zeros(layout.width, np.int64)
        for chunk in rows_of(batches, layout):
            total += chunk.values().sum(axis=1)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "x": pa.array(total)})

    out = np.zeros(layout.width, np.int64)
    for r in chunks.mapInArrow(add, "k int, x long").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


def swept(chunks: DataFrame, rules: list[tuple[int, ...]], layout: Layout, finish, schema: str) -> DataFrame:
    """The sums of all rules' members by rank, merged over tasks and handed to ``finish(place, sums)``, which yields record
    batches of the schema. rules: at most ``layout.block``; they travel with the tasks."""
    shape = (layout.width, layout.places)

    def sweep(batches):
        sums: dict[int, np.ndarray] = {}
        for chunk in rows_of(batches, layout):
            weights = chunk.values().astype(np.float64)
            for k, at in chunk.members(rules):
                if len(at):
                    if k not in sums:
                        sums[k] = np.zeros(shape, np.int64)
                    histograms(chunk, at, weights, sums[k])
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("sums")):
                x = np.frombuffer(raw.as_buffer(), np.int64).reshape(shape)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield from finish(k, x)

    return chunks.mapInArrow(sweep, "k int, sums binary").repartition("k").mapInArrow(merge, schema)


def names(chunks: DataFrame, rules: list[tuple[int, ...]], layout: Layout) -> dict[tuple[int, ...], str]:
    """The name of each rule's members, for as many rules as the driver holds."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for chunk in rows_of(batches, layout):
            values = chunk.values()
            for k, at in chunk.members(rules):
                sums[k] = sums.get(k, 0) + values[:, at].sum(axis=1)
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(x), pa.int32()), "v": pa.array(range(len(x)), pa.int32()), "x": pa.array(x)})

    total = {k: np.zeros(layout.width, np.int64) for k in range(len(rules))}
    for r in chunks.mapInArrow(add, "k int, v int, x long").groupBy("k", "v").agg(F.sum("x").alias("x")).collect():
        total[r["k"]][r["v"]] = r["x"]
    return {rules[k]: summary(x, layout)[3] for k, x in total.items()}


@dataclass
class Sides:
    """What both sides of every split hold; index 0: where the predicate is false. Arrays by predicate."""

    size: np.ndarray  # [2, predicates]
    counts: np.ndarray  # [2, predicates, classes]
    least: np.ndarray
    hashes: np.ndarray  # [2, predicates, 2]
    total: np.ndarray  # limbs of the whole


def sides(sums: np.ndarray, layout: Layout) -> Sides:
    width, k = layout.width, layout.predicates
    yes, place, done = np.zeros((width, k), np.int64), 0, 0
    total = sums[:, : layout.sizes[0] + 1].sum(axis=1) if layout.sizes else np.zeros(width, np.int64)
    for size, ordered in zip(layout.sizes, layout.ordered):
        own = sums[:, place : place + size + 1]
        yes[:, done : done + size] = np.cumsum(own[:, :0:-1], axis=1)[:, ::-1] if ordered else own[:, 1:]
        place, done = place + size + 1, done + size
    both = np.stack([total[:, None] - yes, yes], axis=1)  # [limb, side, predicate]
    n = layout.count_limbs
    counts = np.stack([whole(both[1 + n * j : 1 + n * (j + 1)], False) for j in range(layout.classes)], axis=-1) if layout.classes else np.zeros((2, k, 0), np.int64)
    at = 1 + n * layout.classes
    least = whole(both[at : at + layout.least_limbs], layout.wide)
    at += layout.least_limbs
    with np.errstate(over="ignore"):
        hashes = np.stack([both[at + 2 * i].view(np.uint64) + (both[at + 2 * i + 1].view(np.uint64) << np.uint64(32)) for i in (0, 1)], axis=-1)
    return Sides(both[0], counts, least, hashes, total)


def named(size: int, hashes) -> str:
    """The name of a capture set."""
    return f"{size}-{int(hashes[0]):016x}-{int(hashes[1]):016x}"


def summary(total: np.ndarray, layout: Layout) -> tuple[int, np.ndarray, int, str]:
    """Groups, class counts, least price and name from the limbs of a set."""
    n = layout.count_limbs
    counts = np.array([int(whole(total[1 + n * j : 1 + n * (j + 1)], True)) for j in range(layout.classes)], np.int64)
    at = 1 + n * layout.classes
    least = int(whole(total[at : at + layout.least_limbs], True))
    at += layout.least_limbs
    hashes = [(int(total[at + 2 * i]) + (int(total[at + 2 * i + 1]) << 32)) & _TWO64 for i in (0, 1)]
    return int(total[0]), counts, least, named(int(total[0]), hashes)
