"""The steps of a search as DataFrame operators: bounds of subproblems and splits, scopes, messages, graph look-ups, and the
leaf statistics and bounds of whole-tree searches.

Subproblems are priced in rows, or in any unit in which losses add up; ``unit`` is the leaf penalty in the same unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .groups import largest


def _sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def bounded(hist: DataFrame, counts: list[str], unit: float) -> DataFrame:
    """base, lower, upper and closed of subproblems with class counts and min_loss: a leaf's cost; the least of it and of
    what the equivalence groups leave wrong with two leaves; and whether no split can pay."""
    worst = _sum(counts) - largest(counts)
    rows = hist.withColumn("base", worst + unit).withColumn("closed", (worst - F.col("min_loss") < unit) | (F.col("n") <= 1))
    lower = F.when(F.col("closed"), F.col("base")).otherwise(F.least(F.col("base"), F.col("min_loss") + 2 * unit))
    return rows.withColumn("lower", lower).withColumn("upper", F.col("base"))


def split_bounds(sides: DataFrame, by: list[str], rule_list: bool = False) -> DataFrame:
    """(by, feature, lower, upper) of splits with two sides; of a rule list's split one side is a leaf."""
    of = lambda c, b: F.max(F.when(F.col("bit") == b, F.col(c)))
    wide = sides.groupBy(*by, "feature").agg(F.count("*").alias("sides"), *[of(c, b).alias(f"{c}{b}") for c in ("base", "lower", "upper") for b in (0, 1)]).filter("sides = 2")
    pair = lambda c: F.least(F.col("base0") + F.col(f"{c}1"), F.col(f"{c}0") + F.col("base1")) if rule_list else F.col(f"{c}0") + F.col(f"{c}1")
    return wide.select(*by, "feature", pair("lower").alias("lower"), pair("upper").alias("upper"))


def merged(tasks: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """(by, lower, upper, feature) of subproblems once their splits are known: the least over the leaf and all splits; of
    equal upper bounds the first feature is the best one, null where the leaf is."""
    best = splits.groupBy(*by).agg(F.min("lower").alias("__l"), F.min(F.struct("upper", "feature")).alias("__u"))
    better = F.col("__u.upper") < F.col("base")
    rows = tasks.join(best, by, "left")
    return rows.select(*by, F.least("base", "__l").alias("lower"), F.least("base", "__u.upper").alias("upper"), F.when(better, F.col("__u.feature")).alias("feature"))


def scoped(old_low: Column, old_up: Column, new: Column) -> tuple[Column, Column]:
    """The lower and upper scope of a subproblem after a message: the least and the largest seen; 0 says nothing, and null
    stands for no scope yet."""
    says = F.when(new == 0, F.lit(None)).otherwise(F.greatest(new, F.lit(0)))
    return F.least(old_low, says), F.greatest(old_up, says)


def explorers(sides: DataFrame, splits: DataFrame, by: list[str], boundary: Column, coverage: Column) -> DataFrame:
    """(by, feature, bit, scope): the children to look into, and what each may cost: splits out of scope or covered go, and
    a child's scope is the boundary less its sibling's lower bound."""
    go = splits.filter((F.col("lower") <= boundary) & ~(F.col("upper") <= coverage)).select(*by, "feature")
    sibling = sides.select(*by, "feature", (1 - F.col("bit")).alias("bit"), F.col("lower").alias("__s"))
    return sides.join(go, [*by, "feature"], "left_semi").join(sibling, [*by, "feature", "bit"]).select(*by, "feature", "bit", (boundary - F.col("__s")).alias("scope"))


def tightened(lower: Column, upper: Column, new_lower: Column, new_upper: Column, gap: float = 0.0) -> tuple[Column, Column]:
    """Bounds after an update: they only close in, and meet where the gap is no more than the given one."""
    up = F.least(upper, new_upper)
    low = F.least(up, F.greatest(lower, new_lower))
    return F.when(up - low <= gap, up).otherwise(low), up


def similar_support(splits: DataFrame, distances: DataFrame, by: list[str]) -> DataFrame:
    """splits with bounds tightened by their neighbours in the order of features: predicates that differ on rows worth d
    can't differ by more than d. distances: (a, b, distance) with a < b."""
    w = W.partitionBy(*by).orderBy("feature")
    rows = splits.withColumn("__p", F.lag("feature").over(w)).withColumn("__n", F.lead("feature").over(w))
    for c in ("lower", "upper"):
        rows = rows.withColumn(f"__p{c}", F.lag(c).over(w)).withColumn(f"__n{c}", F.lead(c).over(w))
    before = distances.select(F.col("a").alias("__p"), F.col("b").alias("feature"), F.col("distance").alias("__dp"))
    after = distances.select(F.col("a").alias("feature"), F.col("b").alias("__n"), F.col("distance").alias("__dn"))
    rows = rows.join(F.broadcast(before), ["__p", "feature"], "left").join(F.broadcast(after), ["feature", "__n"], "left")
    low = F.greatest("lower", F.col("__plower") - F.col("__dp"), F.col("__nlower") - F.col("__dn"))
    up = F.least("upper", F.col("__pupper") + F.col("__dp"), F.col("__nupper") + F.col("__dn"))
    return rows.select(*by, "feature", low.alias("lower"), up.alias("upper"))


def merged_messages(messages: DataFrame) -> DataFrame:
    """Messages to one subproblem from one sender count once, with all their features and the largest scope and priority.
    messages: sender, capture, features (bits), scope, priority."""
    return messages.groupBy("sender", "capture").agg(F.bit_or("features").alias("features"), F.max("scope").alias("scope"), F.max("priority").alias("priority"))


def children(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each link (tid, feature, bit, child) with its child's bounds; null where the child isn't known."""
    return edges.join(tasks.select(F.col("tid").alias("child"), F.col("lower"), F.col("upper")), "child", "left")


def parents(edges: DataFrame) -> DataFrame:
    """(child, parents): the subproblems that wait for each child, in order."""
    return edges.groupBy("child").agg(F.array_sort(F.collect_set("tid")).alias("parents"))


def unknown_children(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(child): children that are no subproblem yet."""
    return edges.select("child").distinct().join(tasks.select(F.col("tid").alias("child")), "child", "left_anti")


# Whole-tree searches: leaves of two classes


def leaf_stats(rows: DataFrame, by: list[str], features: list[str], label: str) -> DataFrame:
    """Per leaf: p, n, rate, prediction (ties predict 1), fp, fn, and what its equivalence groups would leave: equiv_fp and
    equiv_fn."""
    cells = rows.groupBy(*dict.fromkeys([*by, *features])).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    one = cells.withColumn("efp", F.when(F.col("p") < F.col("n"), 0).otherwise(F.col("n"))).withColumn("efn", F.when(F.col("p") < F.col("n"), F.col("p")).otherwise(0))
    agg = one.groupBy(*by).agg(*[F.sum(c).alias(x) for c, x in (("p", "p"), ("n", "n"), ("efp", "equiv_fp"), ("efn", "equiv_fn"))])
    zero = F.col("p") < F.col("n")
    return agg.select(*by, "p", "n", (F.col("p") / (F.col("p") + F.col("n"))).alias("rate"), F.when(zero, 0).otherwise(1).alias("prediction"), F.when(zero, 0).otherwise(F.col("n")).alias("fp"), F.when(zero, F.col("p")).otherwise(0).alias("fn"), "equiv_fp", "equiv_fn")


def rates(objective: str, fp: Column, fn: Column, P: Column, N: Column, w: float = 1.0) -> Column:
    """The loss of summed false positives and negatives."""
    if objective == "acc":
        return (fp + fn) / (P + N)
    if objective == "bacc":
        return 0.5 * (fn / P + fp / N)
    if objective == "wacc":
        return (fp + w * fn) / (w * P + N)
    if objective == "f1":
        return (fp + fn) / (2 * P + fp - fn)
    raise ValueError(f"{objective} is no sum over leaves")


def leaf_splits(leaves: DataFrame, rows: DataFrame, by: list[str], features: list[str], label: str) -> DataFrame:
    """Every leaf split by every other predicate: (by, feature, bit, p, n). One pass over the rows: each gives a record for
    each predicate, summed before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bit")) for f in features])
    out = rows.select(*by, label, F.explode(pairs).alias("x")).groupBy(*by, F.col("x.feature").alias("feature"), F.col("x.bit").alias("bit")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    return out.join(leaves.select(*by), by, "left_semi")


def incremental_accuracy(leaves: DataFrame, splits: DataFrame, by: list[str], objective: str, penalty: float, P: Column, N: Column, w: float = 1.0) -> DataFrame:
    """(by, feature, gain, forced): how much each split of a leaf lessens the loss; where it is no more than the penalty one
    of the two new leaves has to be split again."""
    zero = F.col("p") < F.col("n")
    new = splits.groupBy(*by, "feature").agg(F.sum(F.when(zero, 0).otherwise(F.col("n"))).alias("__fp"), F.sum(F.when(zero, F.col("p")).otherwise(0)).alias("__fn"), F.count("*").alias("sides")).filter("sides = 2")
    gain = rates(objective, F.col("fp") - F.col("__fp"), F.col("fn") - F.col("__fn"), P, N, w)
    rows = leaves.join(new, by).withColumn("gain", gain)
    return rows.select(*by, "feature", "gain", (F.col("gain") <= penalty).alias("forced"))


def leaf_support(leaves: DataFrame, objective: str, penalty: float, P: Column, N: Column, w: float = 1.0) -> DataFrame:
    """leaves with tau, all that a split of the leaf could gain, and settled: whether that is less than the penalty."""
    tau = rates(objective, F.col("fp"), F.col("fn"), P, N, w)
    return leaves.withColumn("tau", tau).withColumn("settled", tau < penalty)


def lower_bounds(leaves: DataFrame, objective: str, penalty: float, P: Column, N: Column, split: Column, w: float = 1.0) -> DataFrame:
    """One row: loss and risk of the leaves as they are, the bound in which leaves that will be split (``split``) cost
    nothing, and the one in which they cost what their equivalence groups leave, with one leaf more for each."""
    pick = lambda c: F.sum(F.when(split, 0).otherwise(F.col(c)))
    equal = lambda c, e: F.sum(F.when(split, F.col(e)).otherwise(F.col(c)))
    agg = leaves.agg(*[f(F.col(c)).alias(c) for c, f in (("fp", F.sum), ("fn", F.sum))], pick("fp").alias("__fp"), pick("fn").alias("__fn"), equal("fp", "equiv_fp").alias("__efp"), equal("fn", "equiv_fn").alias("__efn"), F.count("*").alias("leaves"), F.sum(F.when(split, 1).otherwise(0)).alias("splits"))
    r = lambda a, b: rates(objective, F.col(a), F.col(b), P, N, w)
    return agg.select(r("fp", "fn").alias("loss"), (r("fp", "fn") + penalty * F.col("leaves")).alias("risk"), (r("__fp", "__fn") + penalty * F.col("leaves")).alias("bound"), (r("__efp", "__efn") + penalty * (F.col("leaves") + F.col("splits"))).alias("equivalent_bound"))


def leaf_limit(leaves: Column, best: Column, lower: Column, penalty: float, predicates: int) -> Column:
    """The most leaves that a tree which grows out of this one can have and still win."""
    return F.least(leaves + F.floor((best - lower) / penalty), F.lit(2**predicates)).cast("long")


def priorities(leaves: DataFrame, state: list[str], bound: Column, risk: Column, split: Column) -> DataFrame:
    """Per state (a set of leaves): the queue's measures: objective, bound, curiosity (the bound by the share of rows in
    leaves that stay), and entropy and gini of those leaves."""
    rows, q = F.col("p") + F.col("n"), F.col("rate")
    stay = lambda c: F.sum(F.when(split, 0.0).otherwise(c))
    h = F.when((q > 0) & (q < 1), -q * F.log2(q) - (1 - q) * F.log2(1 - q)).otherwise(0.0)
    agg = leaves.groupBy(*state).agg(F.max(bound).alias("bound"), F.max(risk).alias("objective"), F.sum(rows).alias("__all"), stay(rows).alias("__stay"), stay(h * rows).alias("__h"), stay(2 * q * (1 - q) * rows).alias("__g"))
    share = F.when(F.col("__stay") > 0, F.col("__stay") / F.col("__all")).otherwise(0.01 / F.col("__all"))
    over = F.when(F.col("__stay") > 0, F.col("__stay")).otherwise(0.01)
    return agg.select(*state, "objective", "bound", (F.col("bound") / share).alias("curiosity"), (F.col("__h") / over).alias("entropy"), (F.col("__g") / over).alias("gini"))


def cart(groups: DataFrame, features: list[str], counts: list[str], depth: int, gain: float = 0.0) -> DataFrame:
    """A greedy tree by gini gain, level by level: (path, feature, n, errors) of every node, feature null where it is a leaf;
    of equal gains the first predicate. A split must lessen the impurity of all rows by more than ``gain``."""
    from .splits import histogram

    rows, done = groups.withColumn("path", F.lit("")), []
    total = F.broadcast(groups.agg(F.sum("n").alias("__all")))
    w = W.partitionBy("path")
    for level in range(depth + 1):
        nodes = rows.groupBy("path").agg(F.sum("n").alias("n"), (F.sum("n") - F.greatest(*[F.sum(c) for c in counts])).cast("long").alias("errors"))
        if level == depth:
            done.append(nodes.withColumn("feature", F.lit(None).cast("string")))
            break
        impure = lambda n: F.col(n) - _squares(counts) / F.col(n)
        hist = histogram(rows, features, counts, ["path"]).withColumn("__i", impure("n"))
        each = hist.groupBy("path", "feature").agg(F.count("*").alias("sides"), F.sum("__i").alias("__in"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in counts]).filter("sides = 2").withColumn("gain", impure("n") - F.col("__in"))
        top = each.withColumn("__r", F.row_number().over(w.orderBy(F.desc(F.round("gain", 9)), "feature"))).filter("__r = 1").crossJoin(total)
        chosen = top.filter(F.col("gain") / F.col("__all") > gain + 1e-12).select("path", "feature")
        done.append(nodes.join(chosen, "path", "left"))
        bit = reduce(lambda a, f: F.when(F.col("feature") == f, F.col(f)).otherwise(a), features, F.lit(None).cast("int"))
        rows = rows.join(F.broadcast(chosen), "path").withColumn("path", F.concat("path", "feature", bit.cast("string"), F.lit(" "))).drop("feature")
    return reduce(lambda a, b: a.unionByName(b), done).select("path", "feature", "n", "errors")


def _squares(counts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in counts])


def nearest(thresholds: DataFrame, references: DataFrame) -> DataFrame:
    """(reference, pos): the predicate of a column whose threshold is nearest to each reference; of equals the first.
    thresholds: (pos, threshold), those of one column of a codex, whose number is bounded."""
    pairs = references.select("reference").distinct().crossJoin(F.broadcast(thresholds))
    return pairs.groupBy("reference").agg(F.min(F.struct(F.abs(F.col("threshold") - F.col("reference")).alias("d"), "pos")).alias("x")).select("reference", F.col("x.pos").alias("pos"))


def partition_signatures(models: list[tuple[str, Column]], groups: DataFrame, key: str) -> DataFrame:
    """(model, leaf_signature): the partition of the groups by each model's leaf column, whatever the order of its tests."""
    named = F.array(*[F.struct(F.lit(name).alias("model"), leaf.cast("string").alias("leaf")) for name, leaf in models])
    held = groups.select(key, F.explode(named).alias("m")).groupBy("m.model", "m.leaf").agg(F.min(key).alias("first"), F.sum(F.xxhash64(key).cast("decimal(20,0)")).alias("d"), F.count("*").alias("c"))
    return held.groupBy("model").agg(F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws(":", "first", "c", "d")))).alias("leaf_signature"))
