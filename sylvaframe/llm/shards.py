"""Sharding by k-d tree partitioning, with DataFrame operations only.

A row is a point: dimensions, then tie-breaking keys, and a weight in bytes. A node that is to hold m leaves is split
along its widest dimension (relative to the root's extent) at the weighted quantile floor(m/2)/m. The quantile is found
by distributed histograms: each pass sums weights into ``BINS`` bins of the interval that still holds it, for all nodes
of a level in one job, and running sums over a node's bins pick the one in which the quantile lies, so the driver gets a row
for each open node and pass. The cut falls beside a value where that is within ``TOLERANCE`` of the node's weight, which
keeps rows of equal dimensions together; else the ties are cut by the next key in the same way.

A row finds its leaf by look-ups, one for each level of the tree: it carries the number of its node, and the cuts of a
level are a table of at most as many rows as leaves, broadcast up to ``BROADCAST_NODES``. So neither plans nor generated
code grow with the number of shards.

Defined cases: a null text weighs 1 byte and has the empty text's metadata; a very long text is a point like any other,
and a leaf that it fills alone may exceed the others; null ids sort before all others; rows equal in every key (repeated
rows) cannot be told apart and stay together; fewer rows than shards leave shards empty; an empty table gives no rows.
Other columns are ignored (``assign``) or kept (``with_shard``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, stored, utf8_size

BINS = 1 << 12
TOLERANCE = 0.002
ROWS_PER_BUCKET = 20_000
#: Rows of a level's cuts up to which they travel with the tasks.
BROADCAST_NODES = 1_000_000
_MIN = -(1 << 63)


@dataclass
class Node:
    """A node of the tree; leaves have no cut. cut: thresholds of (dimension, *ties); smaller goes left."""

    leaves: int
    first: int = 0
    dim: int = 0
    cut: tuple | None = None
    children: list = field(default_factory=list)


def _rows(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, as one literal in the plan."""
    one = df.sparkSession.range(1, numPartitions=1)
    out = one.select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")
    return F.broadcast(out) if len(rows) <= BROADCAST_NODES else out


class Tree:
    """The levels of cuts, the root's first."""

    def __init__(self, dims: list[str], ties: list[str], leaves: int):
        self.dims, self.ties, self.root = dims, ties, Node(leaves)
        self.levels: list[list[Node]] = []

    def step(self, df: DataFrame, level: int) -> DataFrame:
        """Rows with a column __node, moved one level down."""
        cut = [{"__n": n.first, "__d": n.dim, "__r": n.first + n.leaves // 2, **{f"__c{i}": c for i, c in enumerate(n.cut)}} for n in self.levels[level]]
        keys = len(self.ties) + 1
        held = _rows(df, cut, "__n: int, __d: int, __r: int, " + ", ".join(f"__c{i}: bigint" for i in range(keys)))
        rows = df.join(held, F.col("__node") == F.col("__n"), "left")
        key = [_pick(self.dims), *[F.col(t) for t in self.ties]]
        below = F.lit(False)
        for k, c in list(zip(key, (F.col(f"__c{i}") for i in range(keys))))[::-1]:
            below = F.coalesce((k < c) | ((k == c) & below), F.lit(False))
        node = F.when(F.col("__n").isNull() | below, F.col("__node")).otherwise(F.col("__r"))
        return rows.withColumn("__node", node).drop("__n", "__d", "__r", *[f"__c{i}" for i in range(keys)])

    def label(self, df: DataFrame) -> DataFrame:
        """Rows with the tree's columns and __node, the number of their leaf."""
        out = df.withColumn("__node", F.lit(0))
        for level in range(len(self.levels)):
            out = self.step(out, level)
        return out


def _pick(dims: list[str], at: str = "__d") -> Column:
    """The value of the node's dimension."""
    out = F.col(dims[0])
    for i, d in enumerate(dims[1:], 1):
        out = F.when(F.col(at) == i, F.col(d)).otherwise(out)
    return out


def grow(points: DataFrame, dims: list[str], ties: list[str], weight: str, leaves: int) -> tuple[Tree, DataFrame]:
    """Split until each leaf is one shard. points: a stored table with non-null long columns. Returns the points with
    __node, the number of their leaf, too."""
    tree = Tree(dims, ties, leaves)
    at, level, extent = points.withColumn("__node", F.lit(0)), [tree.root], None
    while level := [n for n in level if n.leaves > 1]:
        bounds = {r["__node"]: r for r in at.groupBy("__node").agg(F.sum(weight).alias("w"), *[f(c).alias(f"{k}_{c}") for c in [*dims, *ties] for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
        if extent is None:
            extent = {c: max(1, bounds[0][f"hi_{c}"] - bounds[0][f"lo_{c}"]) for c in dims} if bounds else {}
        open_ = []
        for n in level:
            b = bounds.get(n.first)
            if b is None:
                n.cut = (0,)
                continue
            n.dim = max(range(len(dims)), key=lambda i: ((b[f"hi_{dims[i]}"] - b[f"lo_{dims[i]}"]) / extent[dims[i]], -i))
            open_.append({"node": n, "b": b, "depth": 0, "prefix": (), "lo": b[f"lo_{dims[n.dim]}"], "hi": b[f"hi_{dims[n.dim]}"], "need": b["w"] * (n.leaves // 2) / n.leaves})
        while open_:
            found = _measure(at, tree, open_, weight)
            open_ = [s for s in open_ if not _narrow(s, found[s["node"].first], tree)]
        tree.levels.append(level)
        nxt = []
        for n in level:
            left = n.leaves // 2
            n.children = [Node(left, n.first), Node(n.leaves - left, n.first + left)]
            nxt += n.children
        at = stored(tree.step(at, len(tree.levels) - 1), "nodes")
        level = nxt
    return tree, at


def _measure(at: DataFrame, tree: Tree, open_: list[dict], weight: str) -> dict:
    """One job: for each open search, the bin in which the quantile lies, its weight and the weight below it."""
    state, wide = [], False
    for s in open_:
        s["width"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
        wide = wide or s["hi"] - s["lo"] >= 1 << 62
        state.append({"__n": s["node"].first, "__d": s["node"].dim, "__depth": s["depth"], "__lo": s["lo"], "__hi": s["hi"], "__width": s["width"], "__need": s["need"], **{f"__p{i}": p for i, p in enumerate(s["prefix"])}})
    keys = len(tree.ties) + 1
    held = _rows(at, state, "__n: int, __d: int, __depth: int, __lo: bigint, __hi: bigint, __width: bigint, __need: double, " + ", ".join(f"__p{i}: bigint" for i in range(keys)))
    key = [_pick(tree.dims), *[F.col(t) for t in tree.ties]]
    value, inside = key[0], F.lit(True)
    for i in range(1, keys):
        value = F.when(F.col("__depth") == i, key[i]).otherwise(value)
    for i in range(keys - 1):
        inside = inside & ((F.col("__depth") <= i) | (key[i] == F.col(f"__p{i}")))
    rows = at.join(held, F.col("__node") == F.col("__n")).withColumn("__v", value).filter(inside & F.col("__v").between(F.col("__lo"), F.col("__hi")))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    bin_ = F.floor((big("__v") - big("__lo")) / big("__width")).cast("long") if wide else F.expr("(__v - __lo) div __width")
    sums = rows.groupBy("__node", "__need", bin_.alias("__bin")).agg(F.sum(weight).alias("__w"))
    from pyspark.sql import Window as W

    run = F.sum("__w").over(W.partitionBy("__node").orderBy("__bin"))
    last = F.max("__bin").over(W.partitionBy("__node"))
    hit = sums.withColumn("__upto", run).withColumn("__last", last).filter((F.col("__upto") >= F.col("__need")) | (F.col("__bin") == F.col("__last")))
    top = hit.groupBy("__node").agg(F.min_by(F.struct("__bin", "__w", "__upto"), "__bin").alias("x")).select("__node", "x.*").collect()
    return {r["__node"]: (r["__bin"], r["__w"], r["__upto"] - r["__w"]) for r in top}


def _narrow(s: dict, found: tuple, tree: Tree) -> bool:
    """Move a search on by its bin; True once its node is cut."""
    node, (b, w, below) = s["node"], found
    s["need"] -= below
    lo = s["lo"] + b * s["width"]
    if s["width"] > 1:
        s["lo"], s["hi"] = lo, min(lo + s["width"] - 1, s["hi"])
        return False
    near = min(s["need"], w - s["need"])
    if near <= TOLERANCE * s["b"]["w"] or s["depth"] == len(tree.ties):
        node.cut = (*s["prefix"], lo if s["need"] <= w - s["need"] else lo + 1)
        return True
    tie = tree.ties[s["depth"]]
    s.update(prefix=(*s["prefix"], lo), depth=s["depth"] + 1, lo=s["b"][f"lo_{tie}"], hi=s["b"][f"hi_{tie}"])
    return False


def metadata(text_col: str, id_col: str) -> dict[str, Column]:
    """The metadata of a document: what its bytes, its non-ASCII share and its content hash say, then its id."""
    size = utf8_size(text_col)
    return {
        "__size": size + 1,
        "__wide": (size - F.coalesce(F.char_length(F.col(text_col)), F.lit(0))).cast("long"),
        "__crc": crc_of(text_col),
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(_MIN)),
    }


DIMS, TIES = ["__size", "__wide", "__crc"], ["__crc", "__id"]


def plan(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Tree, DataFrame]:
    """The tree, and the stored points with the number of their leaf. Give the number of shards, or the bytes that each should reach."""
    points = stored(docs.select(F.col(id_col).alias("__key"), *[c.alias(n) for n, c in metadata(text_col, id_col).items()]), "points")
    if shards is None:
        total = points.agg(F.sum("__size")).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    return grow(points, DIMS, TIES, "__size", shards)


def with_slots(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Number the rows of each group from 0 without gaps. Rows are dealt to hash buckets, and a bucket's numbers start
    after the counts of those before it, so no task sees a whole group."""
    from pyspark.sql import Window as W

    n = max(1, -(-rows.count() // ROWS_PER_BUCKET))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = dealt.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    before = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), (F.sum("__n").over(W.partitionBy(group).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy(group, "__bucket").orderBy(*order))
    numbered = dealt.withColumn("__own", own)
    return numbered.join(before, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b"))).withColumn("slot", (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__bucket", "__own", "__g", "__b", "__before")


def assign(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every document; no text is shuffled."""
    _, points = plan(docs, shards=shards, target_bytes=target_bytes, id_col=id_col, text_col=text_col)
    rows = points.withColumn("shard", F.col("__node").cast("int"))
    return with_slots(rows, "shard", ["__id", "__crc", "__size"]).select(F.col("__key").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard", "slot")


def with_shard(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """The documents with their shard. What the tree asks is an expression of the text, so no text is shuffled."""
    tree, _ = plan(docs, shards=shards, target_bytes=target_bytes, id_col=id_col, text_col=text_col)
    meta = metadata(text_col, id_col)
    carried = [c for c in docs.columns if c != name]
    rows = docs.select(*[F.col(c).alias(f"__x{i}") for i, c in enumerate(carried)], *[c.alias(n) for n, c in meta.items()])
    return tree.label(rows).select(*[F.col(f"__x{i}").alias(c) for i, c in enumerate(carried)], F.col("__node").cast("int").alias(name))
