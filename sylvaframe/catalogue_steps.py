"""Registered queries of the search's steps, of whole searches with their optimum in SQL, and of sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from . import sources
from .catalogue import COUNTS, FEATURES, GROUPS, LONG, TREE, bits, grouped, hist, query, read
from .operators import bitmaps, book, captures, costs, diagnosis, encode, profile, splits, steps
from .plans import levels
from .plans.config import Config
from .plans.estimator import OptimalTree, OptimalTreeModel
from .plans.tree import Leaf, Split, TreeModel
from .store import cut, shared_folder

#: The leaf penalty of the step queries, in rows.
UNIT = 20


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/sylvaframe/{name}-{uuid.uuid4().hex}"


# Subproblems and splits below the root: the sides of o, each split by d, q and t

_TOP = "greatest(sum(n_a), sum(n_n), sum(n_r))"
_SIDE = f"sum(n)::BIGINT AS n, (sum(n) - {_TOP} + {UNIT})::BIGINT AS base, sum(minority)::BIGINT AS min_loss"
_BOUND = f"CASE WHEN base - {UNIT} - min_loss < {UNIT} OR n <= 1 THEN base ELSE least(base, min_loss + 2 * {UNIT}) END::BIGINT AS lower, base AS upper"
_BELOW = (
    f"{GROUPS}, tk0 AS (SELECT o, {_SIDE} FROM g GROUP BY o), tk AS (SELECT *, {_BOUND} FROM tk0), sd0 AS ("
    + " UNION ALL ".join(f"SELECT o, '{f}' AS feature, {f} AS bit, {_SIDE} FROM g GROUP BY o, {f}" for f in "dqt")
    + f"), sd AS (SELECT *, {_BOUND} FROM sd0), sp AS (SELECT o, feature, sum(lower)::BIGINT AS lower, sum(upper)::BIGINT AS upper FROM sd GROUP BY o, feature HAVING count(*) = 2), "
    "sl AS (SELECT a.o, a.feature, least(a.base + b.lower, a.lower + b.base)::BIGINT AS lower, least(a.base + b.upper, a.upper + b.base)::BIGINT AS upper FROM sd a JOIN sd b USING (o, feature) WHERE a.bit = 0 AND b.bit = 1)"
)


def _tasks(spark, sf):
    rows = grouped(spark, sf).groupBy("o").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in COUNTS], F.sum("minority").alias("min_loss"))
    return steps.bounded(rows, COUNTS, UNIT)


def _sides(spark, sf):
    return steps.bounded(splits.histogram(grouped(spark, sf), ["d", "q", "t"], COUNTS, ["o"]), COUNTS, UNIT)


@query(f"WITH {_BELOW} SELECT o, feature, bit, n, base, min_loss, lower, upper FROM sd")
def subproblem_bounds(spark, sf):
    return _sides(spark, sf).select("o", "feature", "bit", "n", "base", "min_loss", "lower", "upper")


@query(f"WITH {_BELOW} SELECT * FROM sp")
def split_bounds(spark, sf):
    return steps.split_bounds(_sides(spark, sf), ["o"])


@query(
    f"""WITH {_BELOW}, {LONG.removeprefix(GROUPS + ", ")}, r0 AS (SELECT feature, bit, n, (n - greatest(n_a, n_n, n_r) + {UNIT})::BIGINT AS base, min_loss FROM hist), r AS (SELECT *, {_BOUND} FROM r0)
SELECT '' AS path, feature, sum(lower)::BIGINT AS lower, sum(upper)::BIGINT AS upper FROM r GROUP BY feature HAVING count(*) = 2
UNION ALL SELECT CASE o WHEN 1 THEN 'o' ELSE 'not o' END, feature, lower, upper FROM sp"""
)
def path_rivals(spark, sf):
    """The bounds of all splits at the root and below both sides of o."""
    names = ["o", "d", "q", "t"]
    rows = grouped(spark, sf)
    n = rows.agg(F.sum("n")).first()[0] or 0
    layout = captures.Layout.of([1] * 4, [False] * 4, [[int(i != j) for j in range(3)] for i in range(3)], UNIT, n)
    found = levels.rivals(captures.chunked(rows, names, COUNTS, layout), layout, [(), (1,), (-1,)])
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)
    return found.select(pick(["", "o", "not o"], "node").alias("path"), pick(names, "predicate").alias("feature"), "lower", "upper")


@query(f"WITH {_BELOW} SELECT * FROM sl")
def split_bounds_rule_list(spark, sf):
    return steps.split_bounds(_sides(spark, sf), ["o"], rule_list=True)


@query(f"WITH {_BELOW}, b AS (SELECT o, min(lower) AS l, min(upper) AS u, arg_min(feature, upper * 10 + CASE feature WHEN 'd' THEN 0 WHEN 'q' THEN 1 ELSE 2 END) AS f FROM sp GROUP BY o) SELECT tk.o, least(base, l) AS lower, least(base, u) AS upper, CASE WHEN u < base THEN f END AS feature FROM tk LEFT JOIN b ON b.o = tk.o")
def merged_bounds(spark, sf):
    return steps.merged(_tasks(spark, sf), steps.split_bounds(_sides(spark, sf), ["o"]), ["o"])


@query(f"WITH {_BELOW}, go AS (SELECT sp.o, sp.feature, tk.base FROM sp JOIN tk USING (o) WHERE sp.lower <= tk.base AND NOT sp.upper <= {UNIT}) SELECT a.o, a.feature, a.bit, (go.base - b.lower)::BIGINT AS scope FROM go JOIN sd a USING (o, feature) JOIN sd b USING (o, feature) WHERE b.bit = 1 - a.bit")
def explorer_scopes(spark, sf):
    base = F.broadcast(_tasks(spark, sf).select("o", F.col("base").alias("boundary")))
    sides = _sides(spark, sf).join(base, "o")
    found = steps.split_bounds(sides, ["o"]).join(base, "o")
    return steps.explorers(sides, found, ["o"], F.col("boundary"), F.lit(UNIT))


@query(f"WITH {_BELOW} SELECT feature, bit, min(lower) AS lower_scope, max(lower) AS upper_scope FROM sd GROUP BY feature, bit")
def scope_updates(spark, sf):
    """Two messages to each side: 0 says nothing, then the two sides of o tell their bounds."""
    s = _sides(spark, sf)
    one, two = (s.filter(f"o = {b}").select("feature", "bit", F.col("lower").alias(f"m{b}")) for b in (0, 1))
    low, up = steps.scoped(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0).cast("long"))
    rows = one.join(two, ["feature", "bit"]).withColumns({"l": low, "u": up})
    for m in ("m0", "m1"):
        low, up = steps.scoped(F.col("l"), F.col("u"), F.col(m))
        rows = rows.withColumns({"l": low, "u": up})
    return rows.select("feature", "bit", F.col("l").alias("lower_scope"), F.col("u").alias("upper_scope"))


@query(f"WITH {_BELOW}, x AS (SELECT sd.o, feature, bit, sd.lower, sd.upper, tk.lower AS nl, tk.upper // 2 AS nu FROM sd JOIN tk USING (o)), y AS (SELECT *, least(upper, nu) AS u FROM x) SELECT o, feature, bit, CASE WHEN u - least(u, greatest(lower, nl)) <= {UNIT} THEN u ELSE least(u, greatest(lower, nl)) END AS lower, u AS upper FROM y")
def bound_updates(spark, sf):
    news = F.broadcast(_tasks(spark, sf).select("o", F.col("lower").alias("nl"), F.expr("upper div 2").alias("nu")))
    low, up = steps.tightened(F.col("lower"), F.col("upper"), F.col("nl"), F.col("nu"), UNIT)
    return _sides(spark, sf).join(news, "o").select("o", "feature", "bit", low.alias("lower"), up.alias("upper"))


_DIST = (
    "di AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, least(sum(CASE WHEN {a} <> {b} THEN n ELSE 0 END), sum(CASE WHEN {a} = {b} THEN n ELSE 0 END))::BIGINT AS distance FROM g" for a, b in (("d", "q"), ("d", "t"), ("q", "t")))
    + ")"
)


@query(
    f"""WITH {_BELOW}, {_DIST}, w AS (SELECT *, lag(feature) OVER x AS p, lead(feature) OVER x AS s, lag(lower) OVER x AS pl, lag(upper) OVER x AS pu, lead(lower) OVER x AS sl_, lead(upper) OVER x AS su FROM sp WINDOW x AS (PARTITION BY o ORDER BY feature))
SELECT o, feature, greatest(lower, pl - a.distance, sl_ - b.distance) AS lower, least(upper, pu + a.distance, su + b.distance) AS upper FROM w LEFT JOIN di a ON a.a = p AND a.b = feature LEFT JOIN di b ON b.a = feature AND b.b = s"""
)
def similar_support_bounds(spark, sf):
    d = splits.distances(grouped(spark, sf), ["d", "q", "t"])
    return steps.similar_support(steps.split_bounds(_sides(spark, sf), ["o"]), d, ["o"])


@query(
    f"WITH {GROUPS} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, least(sum(CASE WHEN {a} <> {b} THEN n - minority ELSE 0 END), sum(CASE WHEN {a} = {b} THEN n - minority ELSE 0 END))::BIGINT AS distance FROM g" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])
)
def feature_distance_weighted(spark, sf):
    """Distances in what a row of the group can cost."""
    return splits.distances(grouped(spark, sf).withColumn("span", F.col("n") - F.col("minority")), FEATURES, "span")


_CELL = "d::VARCHAR || o::VARCHAR"


@query(f"WITH {GROUPS} SELECT q AS sender, {_CELL} AS capture, bit_or(1::BIGINT << (t * 2)) AS features, max(n)::BIGINT AS scope, max(minority)::BIGINT AS priority FROM g GROUP BY 1, 2")
def message_merge(spark, sf):
    g = grouped(spark, sf).select(F.col("q").alias("sender"), F.concat(F.col("d").cast("string"), F.col("o").cast("string")).alias("capture"), F.expr("shiftleft(1L, t * 2)").alias("features"), F.col("n").alias("scope"), F.col("minority").alias("priority"))
    return steps.merged_messages(g)


# The subproblem graph: paths of up to two tests are tids, links lead from a path to the longer one

_EDGE = (
    "ed AS ("
    + " UNION ALL ".join(f"SELECT 'o' || o AS tid, '{f}' AS feature, {f} AS bit, 'o' || o || {f!r} || {f} AS child FROM g GROUP BY o, {f}" for f in "dqt")
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}' || {f} AS tid, 'o' AS feature, o AS bit, 'o' || o || {f!r} || {f} AS child FROM g GROUP BY o, {f}" for f in "dqt")
    + "), no AS (SELECT 'o' || o || feature || bit AS tid, lower, upper, base AS leaf FROM sd WHERE feature <> 't')"
)


def _graph(spark, sf):
    s = _sides(spark, sf)
    child = F.concat(F.lit("o"), "o", "feature", "bit")
    down = s.select(F.concat(F.lit("o"), "o").alias("tid"), "feature", "bit", child.alias("child"))
    across = s.select(F.concat("feature", "bit").alias("tid"), F.lit("o").alias("feature"), F.col("o").alias("bit"), child.alias("child"))
    known = s.filter("feature <> 't'").select(child.alias("tid"), "lower", "upper", F.col("base").alias("leaf"))
    return down.union(across), known


@query(f"WITH {_BELOW}, {_EDGE} SELECT ed.*, coalesce(lower, -1)::BIGINT AS lower, coalesce(upper, -1)::BIGINT AS upper FROM ed LEFT JOIN no ON no.tid = ed.child")
def child_lookup(spark, sf):
    edges, known = _graph(spark, sf)
    return steps.children(edges, known).na.fill(-1, ["lower", "upper"])


@query(f"WITH {_BELOW}, {_EDGE} SELECT child, string_agg(DISTINCT tid, ',' ORDER BY tid) AS parents FROM ed GROUP BY child")
def parent_lookup(spark, sf):
    return steps.parents(_graph(spark, sf)[0]).select("child", F.concat_ws(",", "parents").alias("parents"))


@query(f"WITH {_BELOW}, {_EDGE} SELECT DISTINCT child FROM ed WHERE child NOT IN (SELECT tid FROM no)")
def new_subproblems(spark, sf):
    return steps.unknown_children(*_graph(spark, sf))


_OPEN = "op AS (SELECT tid, lower, upper, leaf FROM no UNION ALL SELECT 'o' || o, lower, upper, base FROM tk)"


def _diagnosed(spark, sf):
    edges, known = _graph(spark, sf)
    return known.union(_tasks(spark, sf).select(F.concat(F.lit("o"), "o").alias("tid"), "lower", "upper", "base")), edges.filter("feature <> 't'")


@query(f"WITH {_BELOW}, {_EDGE}, {_OPEN} SELECT tid, lower, upper, leaf FROM op WHERE lower < upper AND tid NOT IN (SELECT tid FROM ed WHERE feature <> 't')")
def diagnose_unresolved(spark, sf):
    return diagnosis.unresolved(*_diagnosed(spark, sf))


@query(f"WITH {_BELOW}, {_EDGE}, {_OPEN} SELECT tid, feature, child FROM ed WHERE feature <> 't' AND tid IN (SELECT tid FROM op WHERE lower < upper) AND child IN (SELECT tid FROM op WHERE lower < upper)")
def diagnose_blocking(spark, sf):
    return diagnosis.blocking(*_diagnosed(spark, sf))


@query(
    f"""WITH {_BELOW}, {_EDGE}, {_OPEN}, cl AS (SELECT tid, leaf, upper // 2 AS upper FROM op), s AS (SELECT ed.tid, feature, count(*) AS k, sum(cl.upper) AS v FROM ed JOIN cl ON cl.tid = ed.child WHERE feature <> 't' GROUP BY ALL), b AS (SELECT tid, min(v)::BIGINT AS v FROM s WHERE k = 2 GROUP BY tid)
SELECT cl.tid, leaf, coalesce(v, -1)::BIGINT AS v, upper FROM cl LEFT JOIN b ON b.tid = cl.tid WHERE least(leaf, coalesce(v, leaf)) <> upper"""
)
def diagnose_unfounded(spark, sf):
    """Subproblems closed at half their bound, which nothing supports."""
    tasks, edges = _diagnosed(spark, sf)
    return diagnosis.unfounded(tasks.withColumn("upper", F.expr("upper div 2")).withColumn("lower", F.col("upper")), edges).na.fill(-1, ["v"])


# Leaves of two classes: R or not

_TWO = f"bits AS (SELECT *, CASE WHEN y = 'R' THEN 1 ELSE 0 END AS lab FROM ({GROUPS.split('bits AS (')[1].split('), grp')[0]})), tot AS (SELECT sum(lab)::DOUBLE AS p_, sum(1 - lab)::DOUBLE AS n_ FROM bits)"
_LEAF = f"{_TWO}, cl AS (SELECT d, o, q, t, sum(lab) AS p, sum(1 - lab) AS n FROM bits GROUP BY d, o, q, t), lf AS (SELECT o, q, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n, sum(CASE WHEN p < n THEN 0 ELSE n END)::BIGINT AS equiv_fp, sum(CASE WHEN p < n THEN p ELSE 0 END)::BIGINT AS equiv_fn FROM cl GROUP BY o, q), st AS (SELECT o, q, p, n, p::DOUBLE / (p + n) AS rate, CASE WHEN p < n THEN 0 ELSE 1 END AS prediction, CASE WHEN p < n THEN 0 ELSE n END::BIGINT AS fp, CASE WHEN p < n THEN p ELSE 0 END::BIGINT AS fn, equiv_fp, equiv_fn FROM lf)"
_RATE = {"acc": "(({fp}) + ({fn})) / (p_ + n_)", "bacc": "0.5 * (({fn}) / p_ + ({fp}) / n_)", "wacc": "(({fp}) + 2 * ({fn})) / (2 * p_ + n_)"}
_PEN = 0.002


def _two(spark, sf):
    return bits(spark, sf, ()).select(*FEATURES, F.when(F.col("y") == "R", 1).otherwise(0).alias("label"))


def _stats(spark, sf):
    """The leaves of o and q with the totals of both classes beside them."""
    rows = _two(spark, sf)
    total = rows.agg(F.sum("label").cast("double").alias("positives"), F.sum(1 - F.col("label")).cast("double").alias("negatives"))
    return steps.leaf_stats(rows, ["o", "q"], FEATURES, "label").crossJoin(F.broadcast(total))


@query(f"WITH {_LEAF} SELECT o, q, p, n, round(rate, 9) AS rate, prediction, fp, fn, equiv_fp, equiv_fn FROM st")
def leaf_statistics(spark, sf):
    return _stats(spark, sf).withColumn("rate", F.round("rate", 9)).drop("positives", "negatives")


_NEW = f"{_LEAF}, ch AS (" + " UNION ALL ".join(f"SELECT o, q, '{f}' AS feature, {f} AS bit, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n FROM cl GROUP BY o, q, {f}" for f in "dt") + ")"


@query(f"WITH {_NEW} SELECT * FROM ch")
def leaf_times_rules(spark, sf):
    return steps.leaf_splits(_stats(spark, sf), _two(spark, sf), ["o", "q"], ["d", "t"], "label")


@query(
    f"WITH {_NEW}, nw AS (SELECT o, q, feature, sum(CASE WHEN p < n THEN 0 ELSE n END) AS nfp, sum(CASE WHEN p < n THEN p ELSE 0 END) AS nfn FROM ch GROUP BY o, q, feature HAVING count(*) = 2), ga AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS objective, o, q, feature, {v.format(fp='fp - nfp', fn='fn - nfn')} AS gain FROM st JOIN nw USING (o, q), tot" for k, v in _RATE.items())
    + f") SELECT objective, o, q, feature, round(gain, 9) AS gain, gain <= {_PEN} AS forced FROM ga"
)
def incremental_accuracy_bound(spark, sf):
    st = _stats(spark, sf)
    new = steps.leaf_splits(st, _two(spark, sf), ["o", "q"], ["d", "t"], "label")
    out = [steps.incremental_accuracy(st, new, ["o", "q"], k, _PEN, F.col("positives"), F.col("negatives"), 2.0).select(F.lit(k).alias("objective"), "o", "q", "feature", F.round("gain", 9).alias("gain"), "forced") for k in _RATE]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {_LEAF}, ta AS (" + " UNION ALL ".join(f"SELECT '{k}' AS objective, o, q, {v.format(fp='fp', fn='fn')} AS tau FROM st, tot" for k, v in _RATE.items()) + ") SELECT objective, o, q, round(tau, 9) AS tau, tau < 0.1 AS settled FROM ta")
def leaf_support_bound(spark, sf):
    out = [steps.leaf_support(_stats(spark, sf), k, 0.1, F.col("positives"), F.col("negatives"), 2.0).select(F.lit(k).alias("objective"), "o", "q", F.round("tau", 9).alias("tau"), "settled") for k in _RATE]
    return out[0].union(out[1]).union(out[2])


_SPLIT = "o = 1"
_LBS = (
    f"{_LEAF}, sm AS (SELECT sum(fp) AS a, sum(fn) AS b, sum(CASE WHEN {_SPLIT} THEN 0 ELSE fp END) AS c, sum(CASE WHEN {_SPLIT} THEN 0 ELSE fn END) AS e, sum(CASE WHEN {_SPLIT} THEN equiv_fp ELSE fp END) AS h, sum(CASE WHEN {_SPLIT} THEN equiv_fn ELSE fn END) AS i, count(*) AS k, sum(CASE WHEN {_SPLIT} THEN 1 ELSE 0 END) AS s FROM st), lb AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS objective, {v.format(fp='a', fn='b')} AS loss, {v.format(fp='a', fn='b')} + {_PEN} * k AS risk, {v.format(fp='c', fn='e')} + {_PEN} * k AS bound, {v.format(fp='h', fn='i')} + {_PEN} * (k + s) AS equivalent_bound, k FROM sm, tot" for x, v in _RATE.items())
    + ")"
)


def _lower(spark, sf, objective):
    st = _stats(spark, sf)
    total = st.select("positives", "negatives").first()
    return steps.lower_bounds(st, objective, _PEN, F.lit(total["positives"]), F.lit(total["negatives"]), F.expr(_SPLIT), 2.0).withColumn("objective", F.lit(objective))


@query(f"WITH {_LBS} SELECT objective, round(loss, 9) AS loss, round(risk, 9) AS risk, round(bound, 9) AS bound, round(equivalent_bound, 9) AS equivalent_bound FROM lb")
def whole_tree_bounds(spark, sf):
    a, b, c = (_lower(spark, sf, k) for k in _RATE)
    return a.unionByName(b).unionByName(c).select("objective", *[F.round(x, 9).alias(x) for x in ("loss", "risk", "bound", "equivalent_bound")])


@query(f"WITH {_LBS} SELECT objective, least(k + floor((risk - bound) / {_PEN} + 1e-9), 16)::BIGINT AS most_leaves FROM lb")
def leaf_count_bound(spark, sf):
    a, b, c = (_lower(spark, sf, k) for k in _RATE)
    rows = a.unionByName(b).unionByName(c)
    return rows.select("objective", steps.leaf_limit(F.lit(4), F.col("risk") + 1e-9 * _PEN, F.col("bound"), _PEN, 4).alias("most_leaves"))


_HQ = "CASE WHEN rate > 0 AND rate < 1 THEN -rate * log2(rate) - (1 - rate) * log2(1 - rate) ELSE 0 END"


@query(
    f"""WITH {_LBS}, pr AS (SELECT sum(p + n)::DOUBLE AS al, sum(CASE WHEN {_SPLIT} THEN 0 ELSE p + n END)::DOUBLE AS sy, sum(CASE WHEN {_SPLIT} THEN 0 ELSE ({_HQ}) * (p + n) END) AS h, sum(CASE WHEN {_SPLIT} THEN 0 ELSE 2 * rate * (1 - rate) * (p + n) END) AS gi FROM st)
SELECT 'o=1 splits' AS state, round(risk, 9) AS objective, round(bound, 9) AS bound, round(bound / (sy / al), 9) AS curiosity, round(h / sy, 9) AS entropy, round(gi / sy, 9) AS gini FROM lb, pr WHERE objective = 'acc'"""
)
def queue_priorities(spark, sf):
    low = _lower(spark, sf, "acc").first()
    rows = _stats(spark, sf).withColumn("state", F.lit("o=1 splits"))
    out = steps.priorities(rows, ["state"], F.lit(low["bound"]), F.lit(low["risk"]), F.expr(_SPLIT))
    return out.select("state", *[F.round(c, 9).alias(c) for c in ("objective", "bound", "curiosity", "entropy", "gini")])


@query(
    f"""WITH {_LEAF}, pd AS (SELECT lab, prediction, p::DOUBLE / (p + n) AS rate FROM bits JOIN st USING (o, q)), cf AS (SELECT sum(CASE WHEN lab = 0 AND prediction = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN lab = 1 AND prediction = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM pd),
cu AS (SELECT rate, sum(p) AS p, sum(n) AS n FROM st GROUP BY rate), ar AS (SELECT p, n, sum(p) OVER (ORDER BY rate DESC) AS up FROM cu), au AS (SELECT sum(n * (up - p / 2.0)) AS a FROM ar)
SELECT fp, fn, round((fp + fn) / (p_ + n_), 9) AS acc, round(0.5 * (fn / p_ + fp / n_), 9) AS bacc, round((fp + 2 * fn) / (2 * p_ + n_), 9) AS wacc, round((fp + fn) / (2 * p_ + fp - fn), 9) AS f1, round(1 - a / (p_ * n_), 9) AS auc FROM cf, tot, au"""
)
def metric_report(spark, sf):
    """All losses of one tree's predictions on a table."""
    from .operators import metrics

    st = _stats(spark, sf)
    pred = _two(spark, sf).join(F.broadcast(st.select("o", "q", "prediction", "rate", "positives", "negatives")), ["o", "q"])
    miss = lambda truth, said: F.sum(F.when((F.col("label") == truth) & (F.col("prediction") == said), 1).otherwise(0))
    agg = pred.groupBy("positives", "negatives").agg(miss(0, 1).alias("fp"), miss(1, 0).alias("fn"))
    kinds = [F.round(steps.rates(k, F.col("fp"), F.col("fn"), F.col("positives"), F.col("negatives"), 2.0), 9).alias(k) for k in ("acc", "bacc", "wacc", "f1")]
    area = metrics.roc(st.select(F.col("p").alias("pos"), F.col("n").alias("neg")))
    return agg.select("fp", "fn", *kinds).crossJoin(F.broadcast(_area(area)))


def _area(points):
    from pyspark.sql import Window as W

    w = W.orderBy(F.desc("rate"))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    return points.select(((F.col("fpr") - before("fpr")) * (F.col("tpr") + before("tpr")) / 2).alias("a")).agg(F.round(1 - F.sum("a"), 9).alias("auc"))


_GI = "sum(n) - (sum(n_a) ** 2 + sum(n_n) ** 2 + sum(n_r) ** 2) / sum(n)"


def _cart_sql() -> str:
    err = f"(sum(n) - {_TOP})::BIGINT AS errors"
    pick = lambda by, name, src: (
        f"{name}i AS (" + " UNION ALL ".join(f"SELECT {by}'{f}' AS feature, {f} AS bit, {_GI} AS i FROM {src} GROUP BY {by}{f}" for f in FEATURES) + f"), {name}w AS (SELECT {by}{_GI} AS i FROM {src} {'GROUP BY ' + by.rstrip(', ') if by else ''}), "
        f"{name} AS (SELECT {'x.path, ' if by else ''}feature FROM (SELECT {by}feature, sum(i) AS i, count(*) AS k FROM {name}i GROUP BY {by}feature) x, {name}w w WHERE k = 2 {'AND w.path = x.path' if by else ''} AND (w.i - x.i) / (SELECT sum(n) FROM g) > 1e-12 QUALIFY row_number() OVER ({'PARTITION BY x.path ' if by else ''}ORDER BY round(w.i - x.i, 9) DESC, feature) = 1)"
    )
    bit = "CASE feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES) + " END"
    return f"""WITH {GROUPS}, {pick('', 'r0', 'g')}, g1 AS (SELECT feature || {bit} || ' ' AS path, g.* FROM g, r0), {pick('path, ', 'r1', 'g1')}, g2 AS (SELECT g1.path || feature || {bit} || ' ' AS path, g1.* EXCLUDE (path) FROM g1 JOIN r1 ON r1.path = g1.path)
SELECT '' AS path, (SELECT feature FROM r0) AS feature, sum(n)::BIGINT AS n, {err} FROM g UNION ALL SELECT g1.path, any_value(r1.feature), sum(n)::BIGINT, {err} FROM g1 LEFT JOIN r1 ON r1.path = g1.path GROUP BY g1.path UNION ALL SELECT path, NULL, sum(n)::BIGINT, {err} FROM g2 GROUP BY path"""


@query(_cart_sql())
def cart_tree(spark, sf):
    return steps.cart(grouped(spark, sf), FEATURES, COUNTS, 2)


# Codex look-ups, decoding and bit sets

_CODEX = "cx AS (SELECT (row_number() OVER (ORDER BY k, v, s) - 1)::INTEGER AS pos, col, \"type\", relation, reference, v FROM (SELECT 0 AS k, p_size AS v, '' AS s, 'p_size' AS col, 'Integral' AS \"type\", '>=' AS relation, p_size::VARCHAR AS reference FROM (SELECT DISTINCT p_size FROM part) WHERE p_size > (SELECT min(p_size) FROM part) UNION ALL SELECT 1, 0, p_brand, 'p_brand', 'Categorical', '==', p_brand FROM (SELECT DISTINCT p_brand FROM part)))"


def _part(spark, sf):
    return profile.codex(read(spark, sf, "part").select("p_size", "p_brand", "p_type"), "p_type")


@query(f"WITH {_CODEX} SELECT pos, col, \"type\", relation, reference FROM cx")
def codex_predicates(spark, sf):
    return _part(spark, sf).frame(spark)


@query(f"WITH {_CODEX} SELECT (p_retailprice / 40)::INTEGER::DOUBLE AS reference, arg_min(pos, abs(v - (p_retailprice / 40)::INTEGER) * 1000 + pos) AS pos FROM part, cx WHERE col = 'p_size' GROUP BY 1")
def codex_nearest(spark, sf):
    book = _part(spark, sf)
    refs = read(spark, sf, "part").select(F.expr("cast(rint(p_retailprice / 40) as double)").alias("reference"))
    return steps.nearest(book.frame(spark).filter("col = 'p_size'").select("pos", F.col("reference").cast("double").alias("threshold")), refs)


@query("SELECT p_partkey, CASE WHEN p_size > (SELECT min(p_size) FROM part) THEN p_size ELSE -1 END AS at_least, p_brand AS brand FROM part")
def decode_rows(spark, sf):
    """Rows encoded to words of bits and read back: the highest threshold reached and the category."""
    book = _part(spark, sf)
    words = encode.packed(book, ranked=True)
    rows = read(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type").withColumns(encode.ranks(book)).select("p_partkey", *words)
    on = lambda p: F.shiftright(F.col(f"w{p.pos // encode.WORD}"), p.pos % encode.WORD).bitwiseAND(F.lit(1).cast("long")) == 1
    held = lambda c, cast: F.array_max(F.array_compact(F.array(*[F.when(on(p), F.lit(p.reference).cast(cast)) for p in book.of(c)])))
    return rows.select("p_partkey", F.coalesce(held("p_size", "int"), F.lit(-1)).alias("at_least"), held("p_brand", "string").alias("brand"))


@query("WITH v AS (SELECT p_size::VARCHAR AS x FROM part UNION SELECT (p_size / 4.0)::VARCHAR FROM part UNION SELECT p_brand FROM part) SELECT x, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN 'int' WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind FROM v WHERE NOT regexp_full_match(x, '[0-9]+[.]0')")
def literal_typing(spark, sf):
    """What a JSON literal becomes: an integer, else a float, else text."""
    p = read(spark, sf, "part")
    texts = p.select(F.col("p_size").cast("string").alias("x")).union(p.select((F.col("p_size") / 4).cast("string"))).union(p.select("p_brand")).distinct().filter("not x rlike '^[0-9]+[.]0$'")
    kind = F.when(F.col("x").rlike("^[+-]?[0-9]+$"), "int").when(F.col("x").try_cast("double").isNotNull(), "float").otherwise("str")
    return texts.select("x", kind.alias("kind"))


_ORDER = "x AS (SELECT o_orderkey, (o_orderkey % 65536)::BIGINT AS x, (o_custkey % 16)::INTEGER AS i FROM orders)"


@query(f"WITH {_ORDER} SELECT o_orderkey, (x >> i) & 1 = 1 AS bit_get, x | (1::BIGINT << i) AS bit_set, x & (65535 - (1::BIGINT << i)) AS bit_clear, 65535 - x AS bits_not, lpad(bin(x), 16, '0') AS bits_text, bit_count(x)::BIGINT AS ones, x < 65535 - x AS less FROM x")
def bitmap_bits(spark, sf):
    """Single bits of a set of 16: read, set, cleared; its complement, text, size, and order by value."""
    x, i = F.col("x"), F.col("i")
    rows = read(spark, sf, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(65536)).cast("long").alias("x"), F.pmod("o_custkey", F.lit(16)).cast("int").alias("i"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in bitmaps.single_bits(x, i, 16).items()])


@query(f"WITH {GROUPS}, v AS (SELECT *, d * 8 + o * 4 + q * 2 + t AS x FROM g) SELECT a.x AS a, b.x AS b, a.x = b.x AS same, sign(a.x - b.x)::INTEGER AS compared FROM v a, v b")
def bitmap_compare(spark, sf):
    """Equality by hash and order by value of all pairs of the table's 16 groups."""
    v = grouped(spark, sf).select((F.col("d") * 8 + F.col("o") * 4 + F.col("q") * 2 + F.col("t")).alias("x"))
    pairs = v.select(F.col("x").alias("a")).crossJoin(F.broadcast(v.select(F.col("x").alias("b"))))
    return pairs.select("a", "b", (F.xxhash64("a") == F.xxhash64("b")).alias("same"), F.signum(F.col("a") - F.col("b")).cast("int").alias("compared"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 25 AND l_linestatus = 'O'")
def leaf_capture(spark, sf):
    """The rows of one leaf as a conjunction of its path's tests."""
    return read(spark, sf, "lineitem").filter(TREE.captures()[2]).select("l_orderkey", "l_linenumber")


# Models as tables over data


@query(
    f"""WITH {GROUPS}, m AS (SELECT 'oq' AS model, 'o' || o || 'q' || q AS leaf, d * 8 + o * 4 + q * 2 + t AS x FROM g UNION ALL SELECT 'qo', 'q' || q || 'o' || o, d * 8 + o * 4 + q * 2 + t FROM g UNION ALL SELECT 'o', 'o' || o, d * 8 + o * 4 + q * 2 + t FROM g),
l AS (SELECT model, leaf, string_agg(x, ',' ORDER BY x) AS rows_ FROM m GROUP BY model, leaf), s AS (SELECT model, string_agg(rows_, ';' ORDER BY rows_) AS sign, count(*) AS leaves FROM l GROUP BY model) SELECT min(model) AS model, any_value(leaves)::BIGINT AS leaves FROM s GROUP BY sign"""
)
def distinct_model_partitions(spark, sf):
    """Trees that ask the same tests in another order partition the table alike and count once."""
    split = lambda f, a, b: Split(f, ">=", 1, a, b)
    four = lambda f, g: TreeModel(split(f, *[split(g, *[Leaf("x", 0.0, 0.0)] * 2)] * 2))
    models = {"oq": four("o", "q"), "qo": four("q", "o"), "o": TreeModel(split("o", *[Leaf("x", 0.0, 0.0)] * 2))}
    g = grouped(spark, sf).withColumn("x", F.col("d") * 8 + F.col("o") * 4 + F.col("q") * 2 + F.col("t"))
    signs = steps.partition_signatures([(k, m.leaf_id()) for k, m in models.items()], g, "x")
    one = signs.groupBy("leaf_signature").agg(F.min("model").alias("model"))
    return one.select("model", F.size(F.split("leaf_signature", ";")).cast("long").alias("leaves"))


_CASE = "CASE WHEN l_quantity >= 25 THEN CASE WHEN l_discount >= 0.05 THEN 0 ELSE 1 END WHEN l_linestatus = 'O' THEN 2 ELSE 3 END"


@query(
    f"""WITH r(leaf, rule, prediction) AS (VALUES (0, 'l_discount >= 0.05 and l_quantity >= 25', 'R'), (1, 'l_discount < 0.05 and l_quantity >= 25', 'A'), (2, 'l_linestatus == O and l_quantity < 25', 'N'), (3, 'l_linestatus != O and l_quantity < 25', 'R')),
c AS (SELECT {_CASE} AS leaf, l_returnflag AS y FROM lineitem) SELECT leaf, rule, prediction, count(*)::BIGINT AS n, sum(CASE WHEN y <> prediction THEN 1 ELSE 0 END)::BIGINT AS wrong FROM c JOIN r USING (leaf) GROUP BY ALL"""
)
def rules_with_support(spark, sf):
    """Each leaf's folded rule with the rows it captures and gets wrong."""
    rows = TREE.transform(read(spark, sf, "lineitem")).groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") != F.col("prediction"), 1).otherwise(0)).alias("wrong"))
    return rows.join(F.broadcast(TREE.rules_frame(spark).drop("loss")), "leaf").select("leaf", "rule", "prediction", "n", "wrong")


@query("SELECT CASE WHEN l_quantity >= 40 THEN '[40, )' WHEN l_quantity >= 25 THEN '[25, 40)' ELSE '( , 25)' END AS interval_, count(*)::BIGINT AS n, sum(CASE WHEN l_returnflag = CASE WHEN l_quantity >= 40 THEN 'R' WHEN l_quantity >= 25 THEN 'A' ELSE 'N' END THEN 1 ELSE 0 END)::BIGINT AS right_ FROM lineitem GROUP BY 1")
def nary_support(spark, sf):
    """A tree's run of thresholds as one node with an interval for each child, and the rows of each."""
    tree = TreeModel(Split("l_quantity", ">=", 25, Split("l_quantity", ">=", 40, Leaf("R", 0.1, 0.01), Leaf("A", 0.1, 0.01)), Leaf("N", 0.1, 0.01)))
    said, name, v = F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("l_quantity")
    for child in tree.nary()["children"]:
        low, high = child["in"]
        inside = (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v < high)
        name = F.when(inside, f"{'( ' if low is None else f'[{low}'}, {'' if high is None else high})").otherwise(name)
        said = F.when(inside, child["then"]["prediction"]).otherwise(said)
    rows = read(spark, sf, "lineitem").select(name.alias("interval_"), (F.col("l_returnflag") == said).alias("hit"))
    return rows.groupBy("interval_").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("right_"))


# Whole searches, whose optimum SQL finds over all subcubes of the four predicates


def optimum_sql(penalty: float, rule_list: bool = False) -> str:
    """(cost): the least share of errors plus penalty a leaf, by dynamic programming over the 81 subcubes."""
    dims = FEATURES
    val = "(VALUES (0), (1), (2))"
    cells = "ce AS (SELECT " + ", ".join(f"c{f}.v AS {f}" for f in dims) + " FROM " + ", ".join(f"{val} AS c{f}(v)" for f in dims) + ")"
    match = " AND ".join(f"(ce.{f} = 2 OR ce.{f} = g.{f})" for f in dims)
    free = " + ".join(f"CASE WHEN ce.{f} = 2 THEN 1 ELSE 0 END" for f in dims)
    sub = f"su AS (SELECT {', '.join(f'ce.{f}' for f in dims)}, any_value({free}) AS k, (sum(n) - {_TOP})::DOUBLE / (SELECT sum(n) FROM g) + {penalty} AS leaf FROM ce JOIN g ON {match} GROUP BY {', '.join(f'ce.{f}' for f in dims)})"
    parts = ["v0 AS (SELECT *, leaf AS cost FROM su WHERE k = 0)"]
    pair = "least(a.leaf + b.cost, a.cost + b.leaf)" if rule_list else "a.cost + b.cost"
    for k in range(1, 5):
        prev = " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(k))
        each = " UNION ALL ".join("SELECT " + ", ".join("2 AS " + f if f == x else f"a.{f}" for f in dims) + f", {pair} AS c FROM p{k} a JOIN p{k} b ON a.{x} = 0 AND b.{x} = 1 AND " + " AND ".join(f"a.{f} = b.{f}" for f in dims if f != x) for x in dims)
        parts.append(f"p{k} AS ({prev}), s{k} AS (SELECT {', '.join(dims)}, min(c) AS c FROM ({each}) GROUP BY {', '.join(dims)})")
        parts.append(f"v{k} AS (SELECT su.*, least(leaf, coalesce(s{k}.c, leaf)) AS cost FROM su LEFT JOIN s{k} ON " + " AND ".join(f"s{k}.{f} = su.{f}" for f in dims) + f" WHERE su.k = {k})")
    return f"WITH {GROUPS}, {cells}, {sub}, {', '.join(parts)} SELECT cost FROM v4"


#: At this penalty lineitem's random flags make a tree of several leaves.
FINE = 0.0005


def _fit(spark, sf, **settings):
    rows = bits(spark, sf, ()).select(*FEATURES, "y")
    model = OptimalTree({"regularization": FINE, **settings}).fit(rows, "y")
    return model, model.error(rows, "y") + FINE * model.leaves()


@query(f"SELECT round(cost, 6) AS objective, true AS proven FROM ({optimum_sql(FINE)})")
def optimal_tree_objective(spark, sf):
    model, cost = _fit(spark, sf)
    return spark.createDataFrame([(round(cost, 6), bool(model.summary["proven"]))], "objective double, proven boolean")


@query(f"SELECT round(cost, 6) AS objective, true AS proven FROM ({optimum_sql(FINE, True)})")
def optimal_rule_list_objective(spark, sf):
    model, cost = _fit(spark, sf, rule_list=True)
    return spark.createDataFrame([(round(cost, 6), bool(model.summary["proven"]))], "objective double, proven boolean")


@query(f"SELECT round(cost, 6) AS objective, true AS proven FROM ({optimum_sql(FINE)})")
def fit_tree_levels(spark, sf):
    """The same search as DataFrames, level by level."""
    model, cost = _fit(spark, sf, local_cells=0, task_cells=0)
    return spark.createDataFrame([(round(cost, 6), bool(model.summary["proven"]))], "objective double, proven boolean")


@query(f"SELECT round(cost, 6) AS objective, true AS proven FROM ({optimum_sql(FINE, True)})")
def fit_rule_list_levels(spark, sf):
    """A rule list by levels, its last levels solved in tasks."""
    model, cost = _fit(spark, sf, local_cells=0, rule_list=True)
    return spark.createDataFrame([(round(cost, 6), bool(model.summary["proven"]))], "objective double, proven boolean")


@query(f"SELECT round(cost, 6) AS least, round(cost, 6) AS most, true AS differ FROM ({optimum_sql(FINE)})")
def optimal_models(spark, sf):
    """Several trees of the optimal cost, none twice."""
    model, _ = _fit(spark, sf, model_limit=4)
    costs_ = [t.objective() for t in model.trees]
    differ = len({t.signature() for t in model.trees}) == len(model.trees)
    return spark.createDataFrame([(round(min(costs_), 6), round(max(costs_), 6), differ)], "least double, most double, differ boolean")


@query(f"SELECT round(cost, 6) AS objective, true AS closed, true AS ordered, 8 AS columns_ FROM ({optimum_sql(FINE)})")
def search_profile(spark, sf):
    """The profile a search writes: its bounds close at the optimum, and its rows go on in time."""
    path = folder(spark, "profile")
    _fit(spark, sf, profile=path)
    rows = spark.read.csv(path, header=True, inferSchema=True)
    last = rows.orderBy("iterations", "time").collect()
    ordered = all(a["time"] <= b["time"] for a, b in zip(last, last[1:]))
    return spark.createDataFrame([(round(float(last[-1]["upperbound"]), 6), last[-1]["lowerbound"] == last[-1]["upperbound"], ordered, len(rows.columns))], "objective double, closed boolean, ordered boolean, columns_ int")


@query(f"SELECT round(cost, 6) AS objective, 0::BIGINT AS loose, 0::BIGINT AS unfounded FROM ({optimum_sql(FINE)})")
def search_trace(spark, sf):
    """The subproblems and links a search writes: the whole table's value, links without a subproblem, and closed
    subproblems whose value nothing supports."""
    path = folder(spark, "trace")
    model, _ = _fit(spark, sf, trace=path)
    nodes, links = sources.read_graph(spark, path)
    whole = nodes.orderBy(F.desc("size")).first()
    loose = links.join(nodes.select("tid"), "tid", "left_anti").count()
    lost = diagnosis.unfounded(nodes.filter("lower = upper"), links).count()
    upper = float(whole["upper"])
    scale = model.summary["upperbound"] / upper
    return spark.createDataFrame([(round(upper * scale, 6), loose, lost)], "objective double, loose long, unfounded long")


@query(f"SELECT round(cost, 6) AS objective, true AS resumed FROM ({optimum_sql(FINE)})")
def resume_search(spark, sf):
    """A search goes on from what an earlier one saved: the same optimum, without a subproblem solved again."""
    path = folder(spark, "checkpoint")
    first, _ = _fit(spark, sf, checkpoint=path)
    again, cost = _fit(spark, sf, checkpoint=path)
    return spark.createDataFrame([(round(cost, 6), again.iterations() < first.iterations() or first.iterations() == 0)], "objective double, resumed boolean")


def _special_sql(dims: list[str]) -> str:
    """Every tree over the predicates, listed by recursion over their subcubes, priced under six objectives."""
    keys_, all_ = ", ".join(dims), len(dims)
    val = "(VALUES (0), (1), (2))"
    cells = "ce AS (SELECT " + ", ".join(f"c{f}.v AS {f}" for f in dims) + " FROM " + ", ".join(f"{val} AS c{f}(v)" for f in dims) + ")"
    match = " AND ".join(f"(ce.{f} = 2 OR ce.{f} = cl.{f})" for f in dims)
    free = " + ".join(f"CASE WHEN ce.{f} = 2 THEN 1 ELSE 0 END" for f in dims)
    keys = ", ".join(f"ce.{f}" for f in dims)
    parts = [cells, f"su AS (SELECT {keys}, any_value({free}) AS k, sum(cl.p)::DOUBLE AS p, sum(cl.n)::DOUBLE AS n FROM ce JOIN cl ON {match} GROUP BY {keys})"]
    for k in range(all_ + 1):
        one = f"SELECT {keys_}, [{{'p': p, 'n': n}}] AS ls FROM su WHERE k = {k}"
        if k:
            prev = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(k))
            parts.append(f"a{k} AS ({prev})")
            one += " UNION ALL " + " UNION ALL ".join(
                "SELECT " + ", ".join("2" if f == x else f"a.{f}" for f in dims) + f", list_concat(a.ls, b.ls) FROM a{k} a JOIN a{k} b ON a.{x} = 0 AND b.{x} = 1 AND " + " AND ".join(f"a.{f} = b.{f}" for f in dims if f != x) + " WHERE " + " + ".join(f"CASE WHEN a.{f} = 2 THEN 1 ELSE 0 END" for f in dims) + f" = {k - 1}"
                for x in dims
            )
        parts.append(f"r{k} AS ({one})")
    parts.append("tr AS (SELECT row_number() OVER () AS id, ls FROM r3), lv AS (SELECT id, l.p AS p, l.n AS n, p_, n_ FROM (SELECT id, unnest(ls) AS l FROM tr), tot)".replace("r3", f"r{all_}"))
    zero = {"acc": "p < n", "bacc": "p * n_ <= n * p_", "wacc": "2 * p <= n", "f1": "2 * p <= n"}
    rate = {**_RATE, "f1": "(({fp}) + ({fn})) / (2 * p_ + ({fp}) - ({fn}))"}
    said = []
    for k in ("acc", "bacc", "wacc", "f1"):
        fp, fn = f"sum(CASE WHEN {zero[k]} THEN 0 ELSE n END)", f"sum(CASE WHEN {zero[k]} THEN p ELSE 0 END)"
        loss = rate[k].replace("p_", "any_value(p_)").replace("n_", "any_value(n_)").format(fp=fp, fn=fn)
        said.append(f"SELECT '{k}' AS objective, {loss} + 0.005 * count(*) AS risk FROM lv GROUP BY id")
    parts.append("cu AS (SELECT id, p_, n_, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM lv WINDOW w AS (PARTITION BY id ORDER BY p / (p + n) DESC, p, n ROWS UNBOUNDED PRECEDING)), cw AS (SELECT id, (fp - n) / n_ AS x0, fp / n_ AS x1, (tp - p) / p_ AS y0, tp / p_ AS y1 FROM cu)")
    said.append("SELECT 'auc' AS objective, 1 - sum((x1 - x0) * (y0 + y1) / 2) + 0.005 * count(*) AS risk FROM cw GROUP BY id")
    said.append("SELECT 'pauc' AS objective, 1 - sum(CASE WHEN x0 >= 0.5 THEN 0 WHEN x1 > 0.5 THEN (0.5 - x0) * (2 * y0 + (y1 - y0) * (0.5 - x0) / (x1 - x0)) / 2 ELSE (x1 - x0) * (y0 + y1) / 2 END) + 0.005 * count(*) AS risk FROM cw GROUP BY id")
    base = f"{_TWO}, cl AS (SELECT {keys_}, sum(lab) AS p, sum(1 - lab) AS n FROM bits GROUP BY {keys_})"
    return f"WITH {base}, {', '.join(parts)}, al AS ({' UNION ALL '.join(said)}) SELECT objective, round(min(risk), 6) AS risk, true AS proven FROM al GROUP BY objective"


@query(_special_sql(FEATURES))
def fit_special_objective(spark, sf):
    """The best tree over all four predicates under each objective. The table is encoded once; the searches share it."""
    b = cut(_two(spark, sf), "bits")
    rows = []
    for objective in ("acc", "bacc", "wacc", "f1", "auc", "pauc"):
        m = OptimalTree({"regularization": 0.005, "objective": objective, "w": 2.0, "theta": 0.5}).fit(b, "label")
        rows.append((objective, round(float(m.summary["risk"]), 6), bool(m.summary["proven"])))
    return spark.createDataFrame(rows, "objective string, risk double, proven boolean")


@query(_special_sql(["d", "o", "q"]))
def special_search_priorities(spark, sf):
    """Queue orders, a greedy start and limits change the way and not the optimum."""
    b = cut(_two(spark, sf).select("d", "o", "q", "label"), "bits")
    ways = {"acc": {"priority": "curiosity"}, "bacc": {"priority": "objective"}, "wacc": {"init_cart": True}, "f1": {"priority": "fifo"}, "auc": {"priority": "gini", "max_depth": 3}, "pauc": {"priority": "entropy", "max_leaves": 8}}
    rows = []
    for objective, way in ways.items():
        m = OptimalTree({"regularization": 0.005, "objective": objective, "w": 2.0, "theta": 0.5, **way}).fit(b, "label")
        rows.append((objective, round(float(m.summary["risk"]), 6), bool(m.summary["proven"])))
    return spark.createDataFrame(rows, "objective string, risk double, proven boolean")


# Sources and sinks: written below the shared folder and read again


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_scan(spark, sf):
    path = folder(spark, "nation") + ".csv"
    read(spark, sf, "nation").write.csv(path, header=True)
    return sources.read_table(spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def orc_and_json_scan(spark, sf):
    """Through ORC and then through JSON lines."""
    path = folder(spark, "supplier")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    s.write.orc(path + ".orc")
    sources.read_table(spark, path + ".orc").write.json(path + ".json")
    out = sources.read_table(spark, path + ".json")
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in s.schema.fields])


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def text_scan(spark, sf):
    """CSV text in memory, as standard input gives it."""
    rows = read(spark, sf, "region").select("r_regionkey", "r_name").collect()
    return sources.table_from_text(spark, "r_regionkey,r_name\n" + "\n".join(f"{r[0]},{r[1]}" for r in rows))


@query("SELECT n_nationkey, n_name, n_regionkey AS class FROM nation")
def pandas_bridge(spark, sf):
    pdf = read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").toPandas()
    return sources.table_from_pandas(spark, pdf[["n_nationkey", "n_name"]], pdf["n_regionkey"])


_COSTS = "A,N,R\n0,1.5,2\n1,0,4\n3,0.5,0\n"


@query("WITH c(pred, truth, cost) AS (VALUES ('A', 'A', 0.0), ('A', 'N', 1.5), ('A', 'R', 2.0), ('N', 'A', 1.0), ('N', 'N', 0.0), ('N', 'R', 4.0), ('R', 'A', 3.0), ('R', 'N', 0.5), ('R', 'R', 0.0)), n AS (SELECT l_returnflag AS truth, count(*) AS k FROM lineitem GROUP BY 1) SELECT pred, round(sum(cost::DOUBLE * k), 6) AS total FROM c JOIN n USING (truth) GROUP BY pred")
def cost_matrix_file(spark, sf):
    """A cost matrix from a file, applied to the class counts of a table."""
    path = folder(spark, "costs")
    sources.write_text(spark, _COSTS.rstrip("\n"), path)
    matrix = costs.completed(sources.read_costs(spark, path, ["A", "N", "R"]), ["A", "N", "R"])
    n = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("truth")).agg(F.count("*").alias("k"))
    return matrix.join(n, "truth").groupBy("pred").agg(F.round(F.sum(F.col("cost") * F.col("k")), 6).alias("total"))


@query(f"WITH {GROUPS}, v AS (SELECT *, CASE WHEN n_r = greatest(n_a, n_n, n_r) THEN 1 ELSE 0 END AS lab FROM g) " + " UNION ALL ".join(f"SELECT '{{{f}:=1}}' AS name, sum({f})::BIGINT AS n, sum({f} * lab)::BIGINT AS correct FROM v" for f in FEATURES))
def rule_file(spark, sf):
    """Rules and labels as files of a name and its bits in each line, read and counted."""
    g = grouped(spark, sf).withColumn("lab", F.when(F.col("n_r") == F.greatest(*COUNTS), 1).otherwise(0)).orderBy(*FEATURES).collect()
    line = lambda name, c: name + " " + " ".join(str(r[c]) for r in g)
    x, y = folder(spark, "rules"), folder(spark, "labels")
    sources.write_text(spark, "\n".join(line("{" + f + ":=1}", f) for f in FEATURES), x)
    sources.write_text(spark, "\n".join([" ".join(["{label=0}", *[str(1 - r["lab"]) for r in g]]), line("{label=1}", "lab")]), y)
    return sources.rules_with_labels(sources.read_rules(spark, y), sources.read_rules(spark, x)).select("name", "n", "correct")


@query(f"SELECT l_orderkey, l_linenumber, {_CASE} AS leaf, CASE {_CASE} WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS prediction FROM lineitem")
def model_file(spark, sf):
    """A model written as JSON, read again, and applied."""
    path = folder(spark, "model")
    sources.write_models(OptimalTreeModel([TREE]), spark, path)
    return sources.read_models(spark, path).transform(read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "leaf", "prediction")


@query(
    f"""WITH {GROUPS}, w AS (SELECT sum(n)::DOUBLE AS n FROM g), l AS (SELECT o, greatest(sum(n_a), sum(n_n), sum(n_r)) AS top, sum(n) AS k, CASE WHEN sum(n_r) = {_TOP} THEN 'R' WHEN sum(n_n) = {_TOP} THEN 'N' ELSE 'A' END AS c FROM g GROUP BY o), x AS (SELECT o, c, (k - top) / n AS loss FROM l, w)
SELECT 'if o >= 1 then:\n    predicted class: ' || a.c || '\n    misclassification penalty: ' || printf('%.6f', a.loss) || '\n    complexity penalty: 0.010000\nelse if o < 1 then:\n    predicted class: ' || b.c || '\n    misclassification penalty: ' || printf('%.6f', b.loss) || '\n    complexity penalty: 0.010000' AS pseudocode, '[ $o \\ge 1$ [ $' || a.c || '$ ] [ $' || b.c || '$ ] ]' AS latex, 2 AS leaves, 3 AS nodes, 2 AS depth, round(a.loss + b.loss, 6) AS loss, round(a.loss + b.loss + 0.02, 6) AS objective FROM x a, x b WHERE a.o = 1 AND b.o = 0"""
)
def model_texts(spark, sf):
    """A stump over o with the losses of its leaves from the table, as pseudocode, LaTeX and sizes."""
    rows = grouped(spark, sf).groupBy("o").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in COUNTS]).collect()
    total, leaf = sum(r["n"] for r in rows), {}
    for r in rows:
        top = max(r[c] for c in COUNTS)
        leaf[r["o"]] = Leaf([c[2:].upper() for c in COUNTS if r[c] == top][-1], (r["n"] - top) / total, 0.01)
    m = OptimalTreeModel([TreeModel(Split("o", ">=", 1, leaf[1], leaf[0]))])
    again = OptimalTreeModel.load(m.json())
    return spark.createDataFrame([(str(again), again.latex(), again.leaves(), again.nodes(), again.max_depth(), round(again.tree.loss(), 6), round(again.tree.objective(), 6))], "pseudocode string, latex string, leaves int, nodes int, depth int, loss double, objective double")


@query("SELECT count(*)::BIGINT AS fits, true AS positive, true AS equal_ FROM (VALUES (1), (2)) AS t(x)")
def timing_file(spark, sf):
    """Two fits append their seconds to one file; the model file holds what the fit returned."""
    path, model = folder(spark, "timing"), folder(spark, "model")
    a, _ = _fit(spark, sf, timing=path, model=model)
    _fit(spark, sf, timing=path)
    rows = spark.read.csv(path, schema="seconds double")
    equal = json.loads(sources.read_text(spark, model)) == json.loads(a.json())
    return rows.agg(F.count("*").alias("fits"), (F.min("seconds") > 0).alias("positive")).withColumn("equal_", F.lit(equal))


@query("SELECT * FROM (VALUES ('regularization', '0.01'), ('rule_list', 'true'), ('unknown key', 'error'), ('worker_limit', '0')) AS t(name, value)")
def settings_file(spark, sf):
    """Settings read from a JSON file; those it doesn't name keep their defaults, and unknown ones are errors."""
    path = folder(spark, "settings")
    sources.write_text(spark, '{"regularization": 0.01, "rule_list": true}', path)
    c = Config.of(sources.read_config(spark, path))
    try:
        Config.of({"regularisation": 1})
        wrong = "none"
    except ValueError:
        wrong = "error"
    return spark.createDataFrame([("regularization", json.dumps(c.regularization)), ("rule_list", json.dumps(c.rule_list)), ("worker_limit", json.dumps(c.worker_limit)), ("unknown key", wrong)], "name string, value string")


_WIDE = "SELECT o_totalprice * 1000000 AS big, o_totalprice / 10000000000 AS tiny, o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS key_text FROM orders"


@query(f"WITH w AS ({_WIDE}) SELECT 'big' AS col, 'Rational' AS \"type\", count(DISTINCT big)::BIGINT AS cardinality, false AS has_null FROM w UNION ALL SELECT 'tiny', 'Rational', count(DISTINCT tiny)::BIGINT, false FROM w UNION ALL SELECT 'o_orderkey', 'Integral', count(DISTINCT o_orderkey)::BIGINT, false FROM w UNION ALL SELECT 'o_orderstatus', 'Categorical', count(DISTINCT o_orderstatus)::BIGINT, false FROM w UNION ALL SELECT 'key_text', 'Integral', count(DISTINCT key_text)::BIGINT, false FROM w")
def type_profile_numbers(spark, sf):
    """Large and tiny doubles, which print with exponents, are numbers by their schema; text is typed by its pattern."""
    o = read(spark, sf, "orders")
    return profile.profile(o.select((F.col("o_totalprice") * 1000000).alias("big"), (F.col("o_totalprice") / F.lit(10000000000).cast("double")).alias("tiny"), "o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("key_text")))


@query("WITH e AS (SELECT DISTINCT round(value, 1) AS v FROM events) SELECT count(*)::BIGINT AS predicates, round(min(m), 6) AS least, round(max(m), 6) AS most FROM (SELECT round(0.5 * (v + lag(v) OVER (ORDER BY v)), 6) AS m FROM e) WHERE m IS NOT NULL")
def codex_thresholds(spark, sf):
    """The thresholds a codex makes of a column of doubles."""
    rows = read(spark, sf, "events").select(F.round("value", 1).alias("v"), "event_type")
    return profile.codex(rows, "event_type").frame(spark).agg(F.count("*").alias("predicates"), F.round(F.min(F.col("reference").cast("double")), 6).alias("least"), F.round(F.max(F.col("reference").cast("double")), 6).alias("most"))


@query(f"WITH {LONG}, pr AS (SELECT feature, sum(n - greatest(n_a, n_n, n_r)) AS loss FROM hist GROUP BY feature) SELECT feature, (row_number() OVER (ORDER BY loss, feature))::INTEGER AS pos FROM pr")
def reordered_predicates(spark, sf):
    """Predicates by the loss of their one-step split, the best first."""
    from pyspark.sql import Window as W

    s = splits.priced(hist(spark, sf), COUNTS)
    return s.select("feature", F.row_number().over(W.orderBy("loss", "feature")).alias("pos"))



# The codex as tables, and searches above the bound of the driver's


def _orders_book(spark, sf):
    return book.book(read(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), "o_orderstatus")


_BOOK = """c AS (SELECT DISTINCT o_custkey AS v FROM orders), t AS (SELECT DISTINCT o_totalprice AS v FROM orders), s AS (SELECT DISTINCT o_orderpriority AS v FROM orders),
n AS (SELECT (SELECT count(*) - 1 FROM c) AS nc, (SELECT count(*) - 1 FROM t) AS nt)"""


@query(
    f"""WITH {_BOOK} SELECT row_number() OVER (ORDER BY v) - 1 AS pos, 'o_custkey' AS col, '>=' AS relation, v::DOUBLE AS threshold, NULL::VARCHAR AS category FROM c WHERE v > (SELECT min(v) FROM c)
UNION ALL SELECT nc + i, 'o_totalprice', '>=', round(0.5 * (v + p), 6), NULL FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p, row_number() OVER (ORDER BY v) - 2 AS i FROM t), n WHERE p IS NOT NULL
UNION ALL SELECT nc + nt + row_number() OVER (ORDER BY v) - 1, 'o_orderpriority', '==', NULL, v FROM s, n"""
)
def codex_table(spark, sf):
    """All predicates of a table, with dense positions found over range partitions."""
    rows = _orders_book(spark, sf).frame()
    number = F.col("relation") == ">="
    return rows.select("pos", "col", "relation", F.when(number, F.col("reference").cast("double")).alias("threshold"), F.when(~number, F.col("reference")).alias("category"))


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_custkey) - 1)::INTEGER AS custkey_rank, (dense_rank() OVER (ORDER BY o_totalprice) - 1)::INTEGER AS totalprice_rank, (dense_rank() OVER (ORDER BY o_orderpriority))::INTEGER AS priority_rank FROM orders")
def codex_ranks(spark, sf):
    """Rows as the ranks of their values: how many thresholds each reaches, or which category it is."""
    rows = _orders_book(spark, sf).encoded(read(spark, sf, "orders"), ["o_orderkey"])
    return rows.select("o_orderkey", F.col("r0").alias("custkey_rank"), F.col("r1").alias("totalprice_rank"), F.col("r2").alias("priority_rank"))


@query(f"SELECT * FROM ({_special_sql(['d', 'o', 'q'])}) WHERE objective IN ('f1', 'auc')")
def fit_special_states(spark, sf):
    """Special objectives over whole trees as tables of states, proven without the driver's search."""
    b = cut(_two(spark, sf).select("d", "o", "q", "label"), "bits")
    rows = []
    for objective in ("f1", "auc"):
        m = OptimalTree({"regularization": 0.005, "objective": objective, "w": 2.0, "theta": 0.5, "local_cells": 0}).fit(b, "label")
        rows.append((objective, round(float(m.summary["risk"]), 6), bool(m.summary["proven"])))
    return spark.createDataFrame(rows, "objective string, risk double, proven boolean")
