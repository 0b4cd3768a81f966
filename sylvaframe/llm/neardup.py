"""MinHash near-deduplication by bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed once; its sketch is the ``size`` smallest hashes. Documents with equal
   sets form a class at once (two 64-bit digests of the whole set and its size), and only class representatives go on.
2. Inverted lists of the retained values generate overlaps. A list is kept for each two values that stand next to each
   other in a sketch. Similar sets have many of these in common: where both sketches are whole sets with a union of u
   values, at least 2 * ceil(t * u) - u - 1, for each value that only one set holds parts at most two neighbours, and a
   set takes the least of these over all unions that it can be part of; for larger sets the hash order spreads such
   values at random, and ``common`` lies five standard deviations below the expected number.
   A set therefore may leave its ``common - 1`` most frequent lists out, and one with fewer shared lists can have no
   partner. So lists of phrases that all texts share are left out by those that have better ones.
3. The full sets of listed documents tell which values nobody else has; what is left bounds the size of a partner, and
   sets without room for one as large as themselves never meet each other. Copies that are edited too much to be linked
   drop out here, before they form pairs.
4. First each list links its members to one of them only, so a group of any size gives as many pairs as members. Then
   lists are left that touch several components. Who shares one with a large component and is outside of it is compared
   with it block by block, and only links come out. The members of the other lists meet where they share one of their
   rarest values (see ``_crossed``), never for a value that many texts have beside much of their own; the nodes of such a
   value, if they are many, are compared in blocks, too. Pairs inside one component could not change the result and are
   never made.
5. The union sketch (the ``size`` smallest values of both) estimates the similarity and filters pairs; the full sets
   of what is left are compared exactly.
6. Links become components by star contractions.

Defined cases: a null text, an empty one and one without words have no shingle and are linked with nothing; a text of
fewer words than a shingle is one shingle; equal ids count as one document; a null id sorts before all others and stands
for itself; an empty table gives no rows; other columns are ignored (``groups``) or kept (``deduplicated``).
"""

from __future__ import annotations



import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import numbered, stored
from .graph import components

SIZE = 64
#: Neighbouring values that two sketches of similar sets share at least: 63 * .64 are expected, with a deviation of 5.2.
COMMON = 14
#: Values of the union sketch that both hold at least: 64 * .8 are expected, with a deviation of 3.2.
TAU = 32
#: Ids up to this many (16 bytes each) are broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Components of more documents are compared in blocks of this many.
LARGE, BLOCK = 32, 256
_NULL = -(1 << 63)
_SIGN = np.uint64(1 << 63)


def _sets(part: pa.RecordBatch, text: str, k: int):
    """The distinct shingle hashes of each text of a slice, ascending as signed longs."""
    data, offsets = tx.buffers(part.column(text))
    starts, ends, doc = tx.words(data, offsets, tx.SPACE)
    full, owner = tx.shingles(tx.hash_words(data, starts, ends), doc, k)
    full = (full ^ _SIGN).view(np.int64)
    bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
    return [np.unique(full[a:b]) for a, b in zip(bounds, bounds[1:])]


def _id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(_NULL))


def sketches(docs: DataFrame, *, k: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (size of the set), d1 and d2 (digests of the whole set), sketch."""

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                sets = _sets(part, "text", k)
                with np.errstate(over="ignore"):
                    digest = [[int(f(s.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for f in (lambda x: tx.mix64(x + np.uint64(1)), lambda x: tx.mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                cut = [s[:size] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(d, pa.int64()) for d in digest], tx.list_array(np.concatenate([*cut, np.zeros(0, np.int64)]), [len(s) for s in cut])],
                    names=["id", "n", "d1", "d2", "sketch"],
                )

    return docs.select(_id(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, *, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                sets = _sets(part, "text", k)
                yield pa.RecordBatch.from_arrays([part.column("id"), tx.list_array(np.concatenate([*sets, np.zeros(0, np.int64)]), [len(s) for s in sets])], names=["id", "items"])

    return docs.mapInArrow(run, "id long, items array<long>")


def _least(n: int, percent: int) -> int:
    """Lists that a set of n values and a partner share at least, both sketches being whole sets."""
    return max(1, min((2 * -(-u * percent // 100) - u - 1 for u in range(n, n * 100 // percent + 1)), default=1))


def _index(classes: DataFrame, percent: int, size: int, common: int) -> DataFrame:
    """value, node, n: the inverted lists of neighbouring retained values, the rarest of each class."""
    keys = F.transform(F.slice("sketch", 2, F.greatest(F.size("sketch") - 1, F.lit(0))), lambda x, i: F.xxhash64(F.col("sketch")[i], x))
    values = classes.select("node", "n", F.explode(keys).alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("value", "__v")
    held = values.join(shared, F.col("value") == F.col("__v")).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))
    exact = F.array(*[F.lit(_least(n, percent)) for n in range(size * percent // 100 + 1)])
    least = F.coalesce(F.get(exact, F.col("n")), F.lit(common))
    places = F.size("held") - least + 1
    return held.withColumn("places", places.cast("int")).filter("places > 0").select("node", "n", F.explode(F.slice("held", 1, F.col("places"))).alias("h")).select(F.col("h.value").alias("value"), "node", "n")


def _room(sets: DataFrame, percent: int) -> DataFrame:
    """__i, room: the largest partner that each listed set can have. Values that no other listed set holds can't be
    shared, and i shared values allow a partner of at most i * (100 + percent) / percent - n."""
    values = sets.select(F.col("id"), F.size("items").alias("n"), F.explode("items").alias("v"))
    alone = values.groupBy("v").agg(F.count("*").alias("df"), F.min("id").alias("id")).filter("df = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = sets.select(F.col("id").alias("__i"), F.size("items").alias("n"))
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    return sizes.join(alone, F.col("id") == F.col("__i"), "left").select("__i", F.floor(shared * (100 + percent) / percent - F.col("n")).alias("room"))


def _near(a: str, b: str, percent: int, room_a: str, room_b: str) -> Column:
    """Sizes and rooms that allow the similarity."""
    sizes = (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    return sizes & (F.col(a) <= F.col(room_b)) & (F.col(b) <= F.col(room_a))


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, size: int, tau: int) -> DataFrame:
    """The links (a, b) among candidate pairs: filtered by union sketches, then confirmed on the full sets."""
    side = lambda c: classes.select(F.col("node").alias(f"__{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("__a")).join(side("b"), F.col("b") == F.col("__b"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    whole = (F.col("na") <= size) & (F.col("nb") <= size)
    exact = lambda i: i * 100 >= (F.col("na") + F.col("nb") - i) * percent
    inner = F.size(F.array_intersect("sa", "sb"))
    found = stored(both.withColumn("sure", whole & exact(inner)).filter(F.when(whole, F.col("sure")).otherwise(common >= tau)).select("a", "b", "na", "nb", "sure"), "pairs")
    one, two = (sets.select(F.col("id").alias(f"__{c}"), F.col("items").alias(f"i{c}")) for c in "ab")
    met = found.filter("not sure").join(one, F.col("a") == F.col("__a")).join(two, F.col("b") == F.col("__b"))
    return found.filter("sure").select("a", "b").union(met.filter(exact(F.size(F.array_intersect("ia", "ib")))).select("a", "b"))


def _blocked(outside: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each outside node to its large component and to the other nodes outside it. Every two blocks of
    BLOCK sets are compared in one task, and of a node's links one to each component comes out, so pairs stay inside.
    outside: node, root, main, members; members: node, root, members."""
    of = lambda: sets.select(F.col("id").alias("__i"), F.col("items").alias("set"))
    many = outside.groupBy("main").agg(F.count("*").alias("guests")).select(F.col("main").alias("__m"), "guests")
    parts = lambda c: F.ceil(c / BLOCK).cast("int")
    deal = lambda c: F.pmod(F.xxhash64("node"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    guest, host = F.col("guests"), F.col("members") + F.col("guests")
    all_ = members.select("node", "root", F.col("root").alias("main"), "members").union(outside.select("node", "root", "main", "members"))
    named = lambda rows, x, y: rows.join(many, F.col("main") == F.col("__m")).select(F.col("node").alias("node"), F.col("root").alias("own"), F.col("main").alias("main"), x.alias("x"), y)
    guests = named(outside, deal(guest), every(host).alias("y"))
    hosts = named(all_, deal(host).alias("y0"), every(guest).alias("x0")).select("node", "own", "main", F.col("x0").alias("x"), F.col("x").alias("y"))
    guests, hosts = (rows.join(of(), F.col("node") == F.col("__i")).select(*[F.col(c).alias(c) for c in ("node", "own", "main", "x", "y", "set")]) for rows in (guests, hosts))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            size = np.array([len(v) for v in right["set"]])
            values, place = np.unique(np.concatenate(list(right["set"])), return_inverse=True)
            first = np.cumsum(size) - size
            nodes, roots = right["node"].to_numpy(), right["own"].to_numpy()
            for node, root, own in zip(left["node"], left["own"], left["set"]):
                at = np.searchsorted(values, own)
                at[at == len(values)] = 0
                held = np.zeros(len(values), np.int64)
                held[at[values[at] == own]] = 1
                inner = np.add.reduceat(held[place], first)
                hit = np.flatnonzero((100 * inner >= percent * (len(own) + size - inner)) & (roots != root))
                for other in nodes[hit[np.unique(roots[hit], return_index=True)[1]]]:
                    out.append((min(node, other), max(node, other)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ["main", "x", "y"]
    return guests.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def _crossed(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b) of nodes of different components: those that share one of their rarest values. And the links
    (a, b), if any, of those that share one with more than BLOCK nodes, which are compared in blocks instead. In an order of
    all values, rarest first, sets with the similarity share a value among the first n - ceil(n * t) + 1 of the larger one
    and the first m - ceil(m * 2t / (1 + t)) + 1 of the smaller one. So what many texts have in common makes no pair of those
    that differ in more than these shares. nodes: node, n, room, root."""
    nodes = stored(nodes, "crossing")
    values = nodes.join(sets, F.col("node") == F.col("id")).select("node", F.explode("items").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").select(F.col("v").alias("__v"), "df")
    held = values.join(shared, F.col("v") == F.col("__v")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    held = held.withColumnRenamed("node", "__node").join(nodes, F.col("__node") == F.col("node"))
    alone = F.col("n") - F.size("held")  # values that no other node has come first of all
    n = F.col("n")
    long = (n - F.ceil(n * percent / F.lit(100.0)) + 1 - alone).cast("int")
    short = (n - F.ceil(n * (2 * percent) / F.lit(100.0 + percent) - 1e-9) + 1 - alone).cast("int")
    rows = held.withColumn("long", long).withColumn("short", short).filter("long > 0")
    rows = stored(rows.select("node", "n", "room", "root", "short", F.posexplode(F.slice("held", 1, F.col("long"))).alias("at", "h")).select("node", "n", "room", "root", F.col("h.v").alias("v"), (F.col("at") < F.col("short")).alias("first")), "rare")
    heavy = stored(rows.groupBy("v").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select(F.col("v").alias("__v")), "heavy")
    dense = None
    if not heavy.isEmpty():
        guests = rows.join(heavy, F.col("v") == F.col("__v"), "left_semi").select("node", "root", F.col("v").alias("main"), F.lit(0).cast("long").alias("members"))
        dense = _blocked(guests, nodes.select("node", "root", F.lit(0).cast("long").alias("members")).filter("false"), sets, percent)
        rows = rows.join(heavy, F.col("v") == F.col("__v"), "left_anti")
    x, y = (part.select(F.col("v").alias(f"v{c}"), F.col("node").alias(c), F.col("n").alias(f"m{c}"), F.col("room").alias(f"u{c}"), F.col("root").alias(f"r{c}")) for c, part in (("x", rows), ("y", rows.filter("first"))))
    larger = (F.col("mx") > F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") > F.col("y")))
    met = x.join(y, (F.col("vx") == F.col("vy")) & (F.col("rx") != F.col("ry")) & larger & _near("mx", "my", percent, "ux", "uy"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), dense


def groups(docs: DataFrame, *, k: int = 5, percent: int = 80, size: int = SIZE, common: int = COMMON, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, class_id (least id with the same set), component_id (least id reachable), kept."""
    texts = docs.select(_id(id_col).alias("id"), F.col(text_col).alias("text"))
    meta = stored(sketches(docs, k=k, size=size, id_col=id_col, text_col=text_col), "sketches")
    digests = stored(meta.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("node")), "classes")
    nodes = digests.select(F.col("node").alias("__node"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2"))
    classes = meta.join(nodes, (F.col("id") == F.col("__node")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")), "left_semi").select(F.col("id").alias("node"), "n", "sketch").dropDuplicates(["node", "n"])
    classes = stored(classes, "reps")
    lists = stored(_index(classes, percent, size, common), "lists")

    listed = lists.select(F.col("node").alias("__n")).distinct()
    listed = F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed
    sets = stored(full_sets(texts.join(listed, F.col("id") == F.col("__n"), "left_semi"), k=k).dropDuplicates(["id"]), "sets")
    rooms = stored(_room(sets, percent), "rooms")
    lists = lists.join(rooms, F.col("node") == F.col("__i")).drop("__i").filter(F.col("room") * 100 >= F.col("n") * percent)
    lists = stored(lists, "open")

    # the pivot of a list is the set with the most room for its size
    pivot = F.max_by(F.struct("node", "n", "room"), F.struct(F.col("room") / F.col("n"), -F.col("node")))
    least = lists.groupBy("value").agg(pivot.alias("p")).select(F.col("value").alias("__v"), F.col("p.node").alias("p"), F.col("p.n").alias("__n"), F.col("p.room").alias("__room"))
    star = lists.join(least, F.col("value") == F.col("__v")).filter((F.col("node") != F.col("p")) & _near("n", "__n", percent, "room", "__room")).select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
    star = stored(star, "star")
    links = stored(_verified(star, classes, sets, percent, size, tau), "starlinks")
    roots = components(links)

    labelled = lists.join(roots, lists["node"] == roots["node"], "left").select(lists["value"], lists["node"], lists["n"], lists["room"], F.coalesce(roots["root"], lists["node"]).alias("root"))
    labelled = stored(labelled, "labelled")
    # lists that still touch several components: if the largest of these is large, as a whole and not only in this list,
    # whoever is outside it meets it and who else is outside in blocks; else the members meet each other
    whose = labelled.select("node", "root").distinct()
    large = whose.groupBy("root").agg(F.count("*").alias("members")).filter(F.col("members") > LARGE)
    large = stored(large, "large")
    of = large.select(F.col("root").alias("__r"), "members")
    of = F.broadcast(of) if of.count() <= BROADCAST_IDS else of
    held = labelled.groupBy("value", "root").agg(F.count("*").alias("c")).join(of, F.col("root") == F.col("__r"), "left")
    sizes = held.groupBy("value").agg(F.count("*").alias("k"), F.max(F.struct("members", "c", "root")).alias("top")).filter("k > 1")
    sizes = sizes.select(F.col("value").alias("__v"), F.col("top.root").alias("main"), F.col("top.members").alias("members"))
    open_ = stored(labelled.join(sizes, F.col("value") == F.col("__v")).drop("__v"), "open")
    outside = open_.filter("root <> main")
    blocks = _blocked(outside.filter("members is not null").select("node", "root", "main", "members").distinct(), whose.join(large, "root"), sets, percent)
    cross, dense = _crossed(open_.filter("members is null").select("node", "n", "room", "root").distinct(), sets, percent)
    tested = star.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    cross = stored(cross.join(tested, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti"), "cross")
    more = stored(_verified(cross, classes, sets, percent, size, tau), "crosslinks").union(blocks)
    more = more if dense is None else more.union(dense)
    # a document whose rows fall into several classes joins them
    joined = meta.filter("n > 0").groupBy("id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo <> hi").select(F.col("id").alias("__i"))
    same = meta.join(joined, F.col("id") == F.col("__i"), "left_semi").join(digests.withColumnsRenamed({"n": "__n", "d1": "__d1", "d2": "__d2"}), (F.col("n") == F.col("__n")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2"))).select(F.col("id").alias("a"), F.col("node").alias("b"))
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).union(same))

    named = digests.join(final.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select(F.col("n").alias("__n"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.col("node").alias("class_id"), F.coalesce("root", "node").alias("component_id"))
    rows = meta.select("id", "n", "d1", "d2").join(named, (F.col("n") == F.col("__n")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")), "left")
    back = lambda c: F.nullif(F.coalesce(F.col(c), F.col("id")), F.lit(_NULL))
    return rows.select(F.nullif("id", F.lit(_NULL)).alias(id_col), F.col("n").alias("n_shingles"), back("class_id").alias("class_id"), back("component_id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of which one of each group stays (the least id), with their own columns, whatever their names; one row
    for each id."""
    held, number = numbered(docs)
    own = number[id_col]
    found = stored(groups(held, id_col=own, text_col=number[text_col], **options).select(_id(own).alias("__i"), "kept"), "groups")
    gone = found.filter("not kept").select("__i").distinct()
    again = found.groupBy("__i").agg(F.count("*").alias("c")).filter("c > 1").select("__i")
    near = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    left = held.join(near(gone), _id(own) == F.col("__i"), "left_anti")
    if not again.isEmpty():
        again = near(again)
        left = left.join(again, _id(own) == F.col("__i"), "left_anti").union(left.join(again, _id(own) == F.col("__i"), "left_semi").dropDuplicates([own]))
    return left.toDF(*docs.columns)
