"""The registered queries, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import support_information
from .operators import bitmaps, costs, encode, groups, metrics, profile, splits
from .plans.estimator import OptimalTree
from .plans.tree import Leaf, Split, TreeModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The base binarisation of lineitem, and what both languages say of it

FEATURES = ["d", "o", "q", "t"]
CLASSES = ["A", "N", "R"]
COUNTS = ["n_a", "n_n", "n_r"]
TESTS = {"q": "l_quantity >= 25", "d": "l_discount >= 0.05", "t": "l_tax >= 0.04", "o": "l_linestatus = 'O'"}
BITS = "SELECT l_orderkey, l_linenumber, l_returnflag AS y, " + ", ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END AS {n}" for n, t in TESTS.items()) + " FROM lineitem"
GROUPS = f"bits AS ({BITS}), grp AS (SELECT d, o, q, t, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE y = '{c}') AS n_{c.lower()}" for c in CLASSES) + " FROM bits GROUP BY d, o, q, t), g AS (SELECT *, n - greatest(n_a, n_n, n_r) AS minority FROM grp)"
LONG = GROUPS + ", h AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS bit, n, n_a, n_n, n_r, minority FROM g" for f in FEATURES) + "), hist AS (SELECT feature, bit, sum(n)::BIGINT AS n, sum(n_a)::BIGINT AS n_a, sum(n_n)::BIGINT AS n_n, sum(n_r)::BIGINT AS n_r, sum(minority)::BIGINT AS min_loss FROM h GROUP BY feature, bit)"
LABEL = "CASE WHEN n_r = greatest(n_a, n_n, n_r) THEN 'R' WHEN n_n = greatest(n_a, n_n, n_r) THEN 'N' ELSE 'A' END"


def bits(spark: SparkSession, sf: str, keep: tuple = ("l_orderkey", "l_linenumber")) -> DataFrame:
    return encode.encode(read(spark, sf, "lineitem").withColumn("y", F.col("l_returnflag")), {n: F.expr(t) for n, t in TESTS.items()}, [*keep, "y"])


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    return groups.with_minority(groups.compress(bits(spark, sf, ()), FEATURES, "y", CLASSES), COUNTS)


def hist(spark: SparkSession, sf: str) -> DataFrame:
    return splits.histogram(grouped(spark, sf), FEATURES, COUNTS)


# Profiling and predicates

_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS raw FROM part" for c in _PART)
    + """), k AS (SELECT col, CASE WHEN raw IN ('', 'NULL', 'null', 'Null', 'NA', 'na', 'NaN') THEN NULL ELSE raw END AS value FROM v),
a AS (SELECT col, count(DISTINCT value)::BIGINT AS cardinality, bool_or(value IS NULL) AS has_null, bool_and(regexp_full_match(value, '[+-]?[0-9]+')) AS ints,
bool_and(regexp_full_match(value, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]*)')) AS numbers FROM k GROUP BY col)
SELECT col, CASE WHEN cardinality <= 1 THEN 'Redundant' WHEN cardinality = 2 AND NOT has_null THEN 'Binary' WHEN ints THEN 'Integral' WHEN numbers THEN 'Rational' ELSE 'Categorical' END AS "type", cardinality, has_null FROM a"""
)
def type_profile(spark, sf):
    return profile.profile(read(spark, sf, "part"), _PART)


@query("SELECT threshold FROM (SELECT round(0.5 * (v + lag(v) OVER (ORDER BY v)), 6) AS threshold FROM (SELECT DISTINCT l_discount AS v FROM lineitem)) WHERE threshold IS NOT NULL")
def thresholds_rational_discount(spark, sf):
    return profile.midpoints(read(spark, sf, "lineitem"), "l_discount")


@query("SELECT DISTINCT p_size::BIGINT AS threshold FROM part WHERE p_size > (SELECT min(p_size) FROM part)")
def thresholds_integral_size(spark, sf):
    return profile.integral_thresholds(read(spark, sf, "part"), "p_size")


_SIG = "round(round(p_retailprice / pow(10.0, floor(log10(p_retailprice)) - 1)) * pow(10.0, floor(log10(p_retailprice)) - 1), 6)"


@query(f"SELECT DISTINCT {_SIG} AS threshold FROM part WHERE p_retailprice > 0")
def precision_limit_values(spark, sf):
    return profile.limited(read(spark, sf, "part").filter("p_retailprice > 0"), "p_retailprice", 2)


@query(
    """WITH v AS (SELECT p_size AS v, min((p_size // 10) % 2) AS lo, max((p_size // 10) % 2) AS hi FROM part GROUP BY p_size),
w AS (SELECT round(0.5 * (v + lag(v) OVER (ORDER BY v)), 6) AS threshold, lo, hi, lag(lo) OVER (ORDER BY v) AS plo, lag(hi) OVER (ORDER BY v) AS phi FROM v)
SELECT threshold FROM w WHERE threshold IS NOT NULL AND least(lo, plo) <> greatest(hi, phi)"""
)
def bucketize_thresholds(spark, sf):
    return profile.bucketized(read(spark, sf, "part").withColumn("y", F.expr("(p_size div 10) % 2")), "p_size", "y")


@query(BITS)
def encode_binary_rows(spark, sf):
    return bits(spark, sf)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS is_{s.lower()}" for s in _SEGMENTS) + " FROM customer")
def encode_categorical_onehot(spark, sf):
    return encode.one_hot(read(spark, sf, "customer"), "c_mktsegment", _SEGMENTS, ["c_custkey"])


@query(
    """WITH v AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN -p_size ELSE p_size END AS s, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS b FROM part)
SELECT p_partkey, CASE WHEN coalesce(s, 0) >= 0 THEN 1 ELSE 0 END AS as_zero, CASE WHEN coalesce(s >= 0, false) THEN 1 ELSE 0 END AS as_false, CASE WHEN coalesce(b = 'Brand#11', false) THEN 1 ELSE 0 END AS brand FROM v"""
)
def encode_null_policy(spark, sf):
    v = read(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN -p_size ELSE p_size END AS s", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS b")
    size, brand = profile.Predicate(0, "s", "Integral", ">=", 0), profile.Predicate(1, "b", "Categorical", "==", "Brand#11")
    return encode.encode(v, {"as_zero": size.column("reference"), "as_false": size.column("sql"), "brand": brand.column()}, ["p_partkey"])


@query("SELECT p_partkey, " + ", ".join(f"CAST((p_partkey // {10**k}) % 10 AS INTEGER) AS d{k}" for k in range(4)) + " FROM part")
def radix_digits(spark, sf):
    return encode.radix(read(spark, sf, "part"), "p_partkey", 4, ["p_partkey"])


# Groups, bounds and costs


@query(f"WITH {GROUPS} SELECT d, o, q, t, n, n_a, n_n, n_r, minority FROM g")
def equivalence_groups(spark, sf):
    return grouped(spark, sf)


@query(f"WITH {GROUPS} SELECT count(*)::BIGINT AS n_groups, sum(n)::BIGINT AS n, sum(minority)::BIGINT AS min_loss FROM g")
def equivalent_points_bound(spark, sf):
    return grouped(spark, sf).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), F.sum("minority").alias("min_loss"))


@query(
    f"WITH {GROUPS}, b AS (SELECT d, o, q, t, CASE WHEN n_a = greatest(n_a, n_n, n_r) THEN 'A' WHEN n_n = greatest(n_a, n_n, n_r) THEN 'N' ELSE 'R' END AS best FROM g) SELECT l_orderkey, l_linenumber, best, y = best AS majority FROM bits JOIN b USING (d, o, q, t)"
)
def majority_flag(spark, sf):
    return groups.majority_rows(bits(spark, sf), FEATURES, "y", CLASSES).select("l_orderkey", "l_linenumber", "best", "majority")


@query(
    f"WITH {GROUPS}, s AS (SELECT o, q, sum(n)::BIGINT AS n, sum(n_a)::BIGINT AS n_a, sum(n_n)::BIGINT AS n_n, sum(n_r)::BIGINT AS n_r, sum(minority)::BIGINT AS min_loss FROM g GROUP BY o, q) SELECT *, {LABEL} AS label, n - greatest(n_a, n_n, n_r) AS max_loss, n - greatest(n_a, n_n, n_r) - min_loss AS potential FROM s"
)
def leaf_summary(spark, sf):
    return groups.leaf_summary(grouped(spark, sf), ["o", "q"], CLASSES)


@query(
    f"""WITH {GROUPS}, s AS (SELECT o, q, sum(n)::BIGINT AS n, sum(n_a) AS n_a, sum(n_n) AS n_n, sum(n_r) AS n_r, sum(minority) AS min_loss FROM g GROUP BY o, q), a AS (SELECT sum(n) AS total FROM s),
b AS (SELECT o, q, (n - greatest(n_a, n_n, n_r)) / total + 0.01 AS base, min_loss / total AS ml, (n - greatest(n_a, n_n, n_r) - min_loss) / total AS pot, n FROM s, a)
SELECT o, q, round(base, 6) AS base, round(CASE WHEN pot < 0.01 OR n <= 1 THEN base ELSE least(base, ml + 0.02) END, 6) AS lower, pot < 0.01 OR n <= 1 AS closed FROM b"""
)
def task_bounds(spark, sf):
    s = groups.leaf_summary(grouped(spark, sf), ["o", "q"], CLASSES)
    n = s.agg(F.sum("n")).first()[0]
    return groups.bounds(s, n, 0.01).select("o", "q", F.round("base", 6).alias("base"), F.round("lower", 6).alias("lower"), "closed")


_CNT = "cnt AS (SELECT o_orderstatus AS label, count(*) AS cnt FROM orders GROUP BY 1), tot AS (SELECT sum(cnt) AS n, count(*) AS k FROM cnt)"


def _order_counts(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("cnt"))


@query(f"WITH {_CNT} SELECT p.label AS pred, t.label AS truth, round(CASE WHEN p.label = t.label THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (k * t.cnt) END, 12) AS cost FROM cnt p, cnt t, tot")
def class_balance_costs(spark, sf):
    return costs.default_costs(_order_counts(spark, sf), "label", balance=True).withColumn("cost", F.round("cost", 12))


@query(
    f"WITH {_CNT} SELECT t.label AS truth, 0.0::DOUBLE AS match, round(1.0::DOUBLE / any_value(n), 12) AS mismatch, round(1.0::DOUBLE / any_value(n), 12) AS max_cost, 0.0::DOUBLE AS min_cost, round(1.0::DOUBLE / any_value(n), 12) AS diff FROM cnt t, tot GROUP BY t.label"
)
def cost_aggregates(spark, sf):
    a = costs.aggregates(costs.default_costs(_order_counts(spark, sf), "label"))
    return a.select("truth", *[F.round(c, 12).alias(c) for c in ("match", "mismatch", "max_cost", "min_cost", "diff")])


_COSTS = [("F", "O", 2.0), ("F", "P", 1.0), ("O", "F", 1.0), ("O", "P", 3.0), ("P", "F", 0.5), ("P", "O", 0.5), ("F", "F", 0.0), ("O", "O", 0.0), ("P", "P", 0.0)]
_VALUES = ", ".join(f"('{p}', '{t}', {c}::DOUBLE)" for p, t, c in _COSTS)


@query(
    f"""WITH c(pred, truth, cost) AS (VALUES {_VALUES}), n AS (SELECT o_orderpriority, o_orderstatus AS truth, count(*) AS cnt FROM orders GROUP BY ALL),
p AS (SELECT o_orderpriority, pred, sum(cnt * cost) AS cost FROM n JOIN c USING (truth) GROUP BY ALL) SELECT o_orderpriority, pred, round(cost, 6) AS cost FROM p QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY cost, pred DESC) = 1"""
)
def cost_matrix_risk(spark, sf):
    counts = read(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("truth")).agg(F.count("*").alias("cnt"))
    cells = costs.completed(spark.createDataFrame(_COSTS, "pred string, truth string, cost double"), ["F", "O", "P"])
    return costs.best_prediction(costs.prediction_costs(counts, cells, ["o_orderpriority"]), ["o_orderpriority"]).withColumn("cost", F.round("cost", 6))


# Splits


@query(f"WITH {LONG} SELECT feature, bit, n, n_a, n_n, n_r, min_loss FROM hist")
def split_histogram(spark, sf):
    return hist(spark, sf)


def _impurity(of: str) -> str:
    if of == "gini":
        term = "1 - " + " - ".join(f"({c} / {{t}}) * ({c} / {{t}})" for c in COUNTS)
    else:
        term = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {{t}}) * ln({c} / {{t}}) ELSE 0 END" for c in COUNTS)
    return (
        f"WITH {LONG}, x AS (SELECT feature, n::DOUBLE AS n, n_a, n_n, n_r, {term.format(t='n')} AS h FROM hist), a AS (SELECT feature, sum(n) AS n, sum(n * h) AS inside, sum(n_a) AS n_a, sum(n_n) AS n_n, sum(n_r) AS n_r FROM x GROUP BY feature), "
        f'r AS (SELECT feature, round({term.format(t="n")} - inside / n, 6) AS gain FROM a) SELECT feature, gain, CAST(row_number() OVER (ORDER BY gain DESC, feature) AS INTEGER) AS "rank" FROM r'
    )


@query(_impurity("entropy"))
def split_entropy_gain(spark, sf):
    return splits.gains(hist(spark, sf), COUNTS)


@query(_impurity("gini"))
def split_gini_rank(spark, sf):
    return splits.gains(hist(spark, sf), COUNTS, "gini")


_INFO = " + ".join(f"CASE WHEN {c} > 0 THEN (n / total) * {c} * (ln({c}) - ln(n / total)) ELSE 0 END" for c in COUNTS)


@query(f"WITH {LONG}, a AS (SELECT sum(n)::DOUBLE AS total FROM g) SELECT feature, bit, round({_INFO}, 4) AS information FROM hist, a")
def split_information(spark, sf):
    h = hist(spark, sf)
    n = grouped(spark, sf).agg(F.sum("n")).first()[0]
    return h.select("feature", "bit", F.round(support_information([F.col(c) for c in COUNTS], F.col("n"), F.lit(float(n))), 4).alias("information"))


_PRICED = f"{LONG}, pr AS (SELECT feature, sum(n - greatest(n_a, n_n, n_r))::BIGINT AS loss FROM hist GROUP BY feature HAVING count(*) = 2)"


@query(f"WITH {_PRICED} SELECT feature, loss FROM pr ORDER BY loss, feature LIMIT 1")
def optimal_stump(spark, sf):
    return splits.best_split(splits.priced(hist(spark, sf), COUNTS))


_TWO = (
    f"{GROUPS}, kid AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS root, {a} AS side, '{b}' AS feature, {b} AS bit, n, n_a, n_n, n_r FROM g" for a in FEATURES for b in FEATURES if a != b)
    + "), kids AS (SELECT root, side, feature, bit, sum(n) - greatest(sum(n_a), sum(n_n), sum(n_r)) AS loss FROM kid GROUP BY root, side, feature, bit), pair AS (SELECT root, side, feature, sum(loss) AS loss FROM kids GROUP BY root, side, feature HAVING count(*) = 2), "
    + "lf AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS root, {a} AS side, sum(n) - greatest(sum(n_a), sum(n_n), sum(n_r)) AS loss FROM g GROUP BY {a}" for a in FEATURES)
    + "), best AS (SELECT root, side, min(loss) AS loss FROM pair GROUP BY root, side)"
)


def _two_levels(spark, sf):
    """(root, side, feature, loss) of second splits, and (root, side, loss) of the sides as leaves."""
    g = grouped(spark, sf)
    sides = F.array(*[F.struct(F.lit(a).alias("root"), F.col(a).alias("side")) for a in FEATURES])
    rows = g.select("*", F.explode(sides).alias("s")).select(*g.columns, "s.root", "s.side")
    pair = splits.priced(splits.histogram(rows, FEATURES, COUNTS, ["root", "side"]), COUNTS, ["root", "side"]).filter("feature <> root")
    leaf = groups.leaf_summary(rows, ["root", "side"], CLASSES).select("root", "side", F.col("max_loss").alias("loss"))
    return pair, leaf


@query(f"WITH {_TWO} SELECT root, sum(loss)::BIGINT AS loss FROM best GROUP BY root ORDER BY loss, root LIMIT 1")
def optimal_depth2_tree(spark, sf):
    pair, _ = _two_levels(spark, sf)
    best = splits.best_split(pair, ["root", "side"]).groupBy("root").agg(F.sum("loss").alias("loss"))
    return best.agg(F.min(F.struct("loss", "root")).alias("b")).select("b.root", "b.loss")


@query(f"WITH {_TWO} SELECT best.root, min(best.loss + lf.loss)::BIGINT AS loss FROM best JOIN lf ON best.root = lf.root AND best.side <> lf.side GROUP BY best.root")
def rule_list_depth2(spark, sf):
    pair, leaf = _two_levels(spark, sf)
    best = splits.best_split(pair, ["root", "side"]).select("root", "side", F.col("loss").alias("deep"))
    other = leaf.select("root", (1 - F.col("side")).alias("side"), F.col("loss").alias("flat"))
    return best.join(other, ["root", "side"]).groupBy("root").agg(F.min(F.col("deep") + F.col("flat")).alias("loss"))


# Narrow predicates of one column, for rules about implied and adjacent predicates

_NEAR = {"q10": "l_quantity >= 10", "q25": "l_quantity >= 25", "q40": "l_quantity >= 40", "d5": "l_discount >= 0.05"}
_NB = "SELECT l_returnflag AS y, " + ", ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END AS {n}" for n, t in _NEAR.items()) + " FROM lineitem"
_NF = sorted(_NEAR)
_NG = f"nb AS ({_NB}), ng AS (SELECT {', '.join(_NF)}, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE y = '{c}') AS n_{c.lower()}" for c in CLASSES) + f" FROM nb GROUP BY {', '.join(_NF)})"
_PAIRS = "pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE {a} = {x} AND {b} = {y}), 0)::BIGINT AS n{x}{y}" for x, y in ((1, 1), (1, 0), (0, 1), (0, 0))) + " FROM ng" for i, a in enumerate(_NF) for b in _NF[i + 1 :]) + ")"


def _near_groups(spark, sf):
    b = encode.encode(read(spark, sf, "lineitem").withColumn("y", F.col("l_returnflag")), {n: F.expr(t) for n, t in _NEAR.items()}, ["y"])
    return groups.with_minority(groups.compress(b, _NF, "y", CLASSES), COUNTS)


@query(f"WITH {_NG}, {_PAIRS} SELECT a, b, 'a->b' AS implies FROM pr WHERE n10 = 0 UNION ALL SELECT a, b, 'a->!b' FROM pr WHERE n11 = 0 UNION ALL SELECT a, b, '!a->b' FROM pr WHERE n00 = 0 UNION ALL SELECT a, b, '!a->!b' FROM pr WHERE n01 = 0")
def feature_subset_pairs(spark, sf):
    return splits.subset_pairs(_near_groups(spark, sf), _NF)


@query(f"WITH {_NG}, {_PAIRS} SELECT a, b, least(n10 + n01, n11 + n00) AS distance FROM pr")
def feature_distance(spark, sf):
    return splits.distances(_near_groups(spark, sf), _NF)


_NH = "nm AS (SELECT *, n - greatest(n_a, n_n, n_r) AS minority FROM ng), nh AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {int(f[1:])} AS threshold, {f} AS bit, sum(minority) AS lb, sum(n) - greatest(sum(n_a), sum(n_n), sum(n_r)) AS ub FROM nm GROUP BY {f}" for f in ("q10", "q25", "q40")) + ")"


@query(
    f"""WITH {_NG}, {_NH}, s AS (SELECT feature, threshold, max(CASE WHEN bit = 0 THEN lb END) AS lb0, max(CASE WHEN bit = 0 THEN ub END) AS ub0, max(CASE WHEN bit = 1 THEN lb END) AS lb1, max(CASE WHEN bit = 1 THEN ub END) AS ub1 FROM nh GROUP BY ALL),
w AS (SELECT feature, lead(feature) OVER (ORDER BY threshold) AS next_feature, lb0 >= lead(ub0) OVER (ORDER BY threshold) AS prune_left, lead(lb1) OVER (ORDER BY threshold) >= ub1 AS prune_right FROM s) SELECT * FROM w WHERE next_feature IS NOT NULL"""
)
def continuous_exchange_candidates(spark, sf):
    h = splits.histogram(_near_groups(spark, sf), ["q10", "q25", "q40"], COUNTS)
    known = spark.createDataFrame([("q10", "l_quantity", 10.0), ("q25", "l_quantity", 25.0), ("q40", "l_quantity", 40.0)], "feature string, source string, threshold double")
    return splits.exchange_candidates(h, known, COUNTS)


# Bitmaps

_MASKS = "SELECT p_partkey, (p_partkey * 37 % 256)::BIGINT AS a, (p_partkey * 91 % 256)::BIGINT AS b FROM part"


@query(f"SELECT p_partkey, a & b AS bits_and, a | b AS bits_or, xor(a, b) AS bits_xor, a & (255 - b) AS bits_andnot, 255 - xor(a, b) AS bits_xnor, bit_count(a)::BIGINT AS ones, a = 0 AS is_empty, a = 255 AS is_full, (a & (255 - b)) = 0 AS is_subset FROM ({_MASKS})")
def bitmap_algebra(spark, sf):
    v = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).alias("a"), (F.col("p_partkey") * 91 % 256).alias("b"))
    return v.select("p_partkey", *[c.alias(n) for n, c in bitmaps.algebra(F.col("a"), F.col("b"), 8).items()])


@query("SELECT ((o_orderkey - 1) // 32768 + 1)::BIGINT AS bucket, count(DISTINCT o_orderkey)::BIGINT AS ones FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 0 GROUP BY 1")
def bitmap_count(spark, sf):
    return bitmaps.constructed(read(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_orderkey > 0"), "o_orderkey").select("bucket", "ones")


_RUNS = "x AS (SELECT c_nationkey, c_custkey AS pos, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_acctbal >= 5000 AS bit FROM customer), k AS (SELECT c_nationkey, i, i - row_number() OVER (PARTITION BY c_nationkey ORDER BY i) AS island FROM x WHERE bit)"


def _numbered(spark, sf):
    return read(spark, sf, "customer").select("c_nationkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("i"), (F.col("c_acctbal") >= 5000).alias("bit"))


@query(f"WITH {_RUNS} SELECT c_nationkey, min(i)::INTEGER AS start, count(*)::BIGINT AS length FROM k GROUP BY c_nationkey, island")
def bitmap_runs(spark, sf):
    return bitmaps.runs(_numbered(spark, sf), "c_nationkey", "i", F.col("bit"))


@query(f"WITH {_RUNS} SELECT c_nationkey, coalesce(min(i) FILTER (WHERE i >= 10), -1)::INTEGER AS following, coalesce(max(i) FILTER (WHERE i <= 10), -1)::INTEGER AS preceding FROM x WHERE bit GROUP BY c_nationkey")
def bitmap_scan(spark, sf):
    return bitmaps.scans(_numbered(spark, sf), "c_nationkey", "i", F.col("bit"), 10)


@query(f"SELECT l_orderkey, l_linenumber, y FROM ({BITS}) WHERE d = 1 AND o = 0 AND q = 1")
def capture_filter(spark, sf):
    return bitmaps.partition(bits(spark, sf), ["d", "o", "q"], [True, False, True]).select("l_orderkey", "l_linenumber", "y")


@query(f"SELECT q, count(*)::BIGINT AS n FROM ({BITS}) GROUP BY q")
def capture_partition(spark, sf):
    return bits(spark, sf).groupBy("q").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, round(sum(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal ELSE 0 END) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING), 2) AS prefix FROM customer")
def masked_prefix_sum(spark, sf):
    c = read(spark, sf, "customer")
    out = groups.running_sums(c, ["c_custkey"], "c_acctbal", F.col("c_nationkey") % 2 == 0, F.floor(F.col("c_custkey") / 1000))
    return out.select("c_custkey", F.round("prefix", 2).alias("prefix"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'plain' END AS label FROM orders")
def ordered_rules(spark, sf):
    rules = [(F.col("o_totalprice") >= 300000, "large"), (F.col("o_orderpriority") == "1-URGENT", "urgent")]
    return read(spark, sf, "orders").select("o_orderkey", groups.first_match(rules, "plain").alias("label"))


@query("SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM (SELECT n_regionkey AS a, n_nationkey % 5 AS b FROM nation)")
def distinct_models(spark, sf):
    m = read(spark, sf, "nation").select(F.least("n_regionkey", F.col("n_nationkey") % 5).alias("x"), F.greatest("n_regionkey", F.col("n_nationkey") % 5).alias("y"))
    return groups.distinct_by_leaves(m.withColumn("leaf_signature", F.concat_ws("|", "x", "y"))).drop("leaf_signature")


# A fixed tree and its scores

TREE = TreeModel(Split("l_quantity", ">=", 25, Split("l_discount", ">=", 0.05, Leaf("R", 0.125, 0.01), Leaf("A", 0.25, 0.01)), Split("l_linestatus", "==", "O", Leaf("N", 0.0625, 0.01), Leaf("R", 0.25, 0.01))))
_CASE = "CASE WHEN l_quantity >= 25 THEN CASE WHEN l_discount >= 0.05 THEN {0} ELSE {1} END WHEN l_linestatus = 'O' THEN {2} ELSE {3} END"
_PRED = _CASE.format("'R'", "'A'", "'N'", "'R'")
_SCORED = f"s AS (SELECT l_returnflag AS y, {_PRED} AS p, l_quantity AS w FROM lineitem)"


def _scored(spark, sf):
    return TREE.transform(read(spark, sf, "lineitem")).select(F.col("l_returnflag").alias("y"), F.col("prediction").alias("p"), F.col("l_quantity").alias("w"))


@query(f"SELECT l_orderkey, l_linenumber, {_PRED} AS prediction, CAST({_CASE.format(0.875, 0.75, 0.9375, 0.75)} AS DOUBLE) AS confidence, CAST({_CASE.format(0, 1, 2, 3)} AS INTEGER) AS leaf FROM lineitem")
def tree_predict(spark, sf):
    return TREE.transform(read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "prediction", "confidence", "leaf")


@query(f"WITH s AS (SELECT CAST({_CASE.format(0, 1, 2, 3)} AS INTEGER) AS leaf, {_PRED} <> l_returnflag AS miss FROM lineitem) SELECT leaf, round(count(*) FILTER (WHERE miss) / (SELECT count(*)::DOUBLE FROM lineitem), 6) AS loss FROM s GROUP BY leaf")
def tree_leaf_loss(spark, sf):
    return TREE.training_loss(read(spark, sf, "lineitem"), "l_returnflag").withColumn("loss", F.round("loss", 6))


@query(f"WITH {_SCORED} SELECT y AS truth, " + ", ".join(f"coalesce(sum(w) FILTER (WHERE p = '{c}'), 0.0)::DOUBLE AS {c}" for c in CLASSES) + " FROM s GROUP BY y")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_scored(spark, sf), "y", "p", CLASSES, "w")


@query(f"WITH {_SCORED} SELECT round(avg((y = p)::INT), 6) AS accuracy, round(1 - avg((y = p)::INT), 6) AS error FROM s")
def accuracy(spark, sf):
    return metrics.accuracy(_scored(spark, sf), "y", "p").select(F.round("accuracy", 6).alias("accuracy"), F.round("error", 6).alias("error"))


@query(f"WITH {_SCORED} SELECT round(sum(CASE WHEN y = p THEN w ELSE 0 END) / sum(w), 6) AS accuracy, round(1 - sum(CASE WHEN y = p THEN w ELSE 0 END) / sum(w), 6) AS error FROM s")
def weighted_accuracy(spark, sf):
    return metrics.accuracy(_scored(spark, sf), "y", "p", "w").select(F.round("accuracy", 6).alias("accuracy"), F.round("error", 6).alias("error"))


@query(f"WITH {_SCORED}, r AS (SELECT y, avg((y = p)::INT) AS recall FROM s GROUP BY y) SELECT round(avg(recall), 6) AS balanced_accuracy FROM r")
def balanced_accuracy(spark, sf):
    return metrics.balanced_accuracy(_scored(spark, sf), "y", "p").withColumn("balanced_accuracy", F.round("balanced_accuracy", 6))


# Special objectives over the leaves that the base predicates make, with R against the rest

_LEAVES = f"{GROUPS}, lv AS (SELECT n_r AS pos, n_a + n_n AS neg FROM g), tt AS (SELECT sum(pos) AS ap, sum(neg) AS an FROM lv)"


def _leaves(spark, sf):
    return grouped(spark, sf).select(F.col("n_r").alias("pos"), (F.col("n_a") + F.col("n_n")).alias("neg"))


def _loss_sql(rule: str, loss: str) -> str:
    return f"WITH {_LEAVES}, e AS (SELECT sum(CASE WHEN {rule} THEN 0 ELSE neg END)::DOUBLE AS fp, sum(CASE WHEN {rule} THEN pos ELSE 0 END)::DOUBLE AS fn, any_value(ap)::DOUBLE AS p, any_value(an)::DOUBLE AS n FROM lv, tt) SELECT round({loss}, 6) AS loss FROM e"


def _loss(spark, sf, objective, w=1.0, theta=1.0):
    return metrics.loss(_leaves(spark, sf), objective, w, theta).select(F.round("loss", 6).alias("loss"))


@query(_loss_sql("pos < neg", "(fp + fn) / (p + n)"))
def loss_acc(spark, sf):
    return _loss(spark, sf, "acc")


@query(_loss_sql("pos * an <= neg * ap", "0.5 * (fn / p + fp / n)"))
def loss_bacc(spark, sf):
    return _loss(spark, sf, "bacc")


@query(_loss_sql("2 * pos <= neg", "(fp + 2 * fn) / (2 * p + n)"))
def loss_wacc(spark, sf):
    return _loss(spark, sf, "wacc", 2.0)


@query(_loss_sql("2 * pos <= neg", "(fp + fn) / (2 * p + fp - fn)"))
def loss_f1(spark, sf):
    return _loss(spark, sf, "f1", 2.0)


_CURVE = f"{_LEAVES}, st AS (SELECT pos::DOUBLE / (pos + neg) AS rate, sum(pos) AS pos, sum(neg) AS neg FROM lv GROUP BY 1), cu AS (SELECT rate, pos, neg, sum(pos) OVER (ORDER BY rate DESC) / ap::DOUBLE AS tpr, sum(neg) OVER (ORDER BY rate DESC) / an::DOUBLE AS fpr, (sum(pos) OVER (ORDER BY rate DESC) - pos) / ap::DOUBLE AS tpr0, (sum(neg) OVER (ORDER BY rate DESC) - neg) / an::DOUBLE AS fpr0 FROM st, tt)"


@query(f"WITH {_CURVE} SELECT round(rate, 6) AS rate, pos::BIGINT AS pos, neg::BIGINT AS neg, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM cu")
def roc_points(spark, sf):
    r = metrics.roc(_leaves(spark, sf))
    return r.select(F.round("rate", 6).alias("rate"), "pos", "neg", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"WITH {_CURVE} SELECT round(1 - sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS loss FROM cu")
def auc(spark, sf):
    return _loss(spark, sf, "auc")


@query(f"WITH {_CURVE} SELECT round(1 - sum(CASE WHEN fpr0 < 0.3 THEN (least(fpr, 0.3) - fpr0) * (tpr0 + CASE WHEN fpr > fpr0 THEN tpr0 + (tpr - tpr0) * (least(fpr, 0.3) - fpr0) / (fpr - fpr0) ELSE tpr END) / 2 ELSE 0 END), 6) AS loss FROM cu")
def pauc(spark, sf):
    return _loss(spark, sf, "pauc", theta=0.3)


# Trees as tables, and fits


@query(f"WITH {_PRICED}, b AS (SELECT min(loss) AS loss FROM pr), whole AS (SELECT sum(n) - greatest(sum(n_a), sum(n_n), sum(n_r)) AS loss, sum(n) AS n FROM g) SELECT round(least(whole.loss / n + 0.5, b.loss / n + 1.0), 6) AS objective, CASE WHEN whole.loss / n + 0.5 <= b.loss / n + 1.0 THEN 1 ELSE 2 END AS leaves FROM b, whole")
def fit_tree_lineitem(spark, sf):
    """A penalty at which only a leaf or a stump can pay, so SQL can say the optimum."""
    b = bits(spark, sf, ()).select(*FEATURES, "y")
    m = OptimalTree({"regularization": 0.5}).fit(b, "y")
    return spark.createDataFrame([(round(m.tree.objective(), 6), m.leaves())], "objective double, leaves int")


_PAY = "l_quantity * (1 - l_discount) >= 28 AND l_linestatus = 'O'"


@query()
def fit_tree_price(spark, sf):
    """The flagship: an optimal tree for open lines of a large net quantity, over thresholds of quantity and discount, scored by leaf."""
    rows = read(spark, sf, "lineitem").select((F.floor(F.col("l_quantity") / 5) * 5).cast("int").alias("quantity"), "l_linestatus", F.round("l_discount", 1).alias("discount"), F.expr(f"CAST({_PAY} AS INT)").alias("expensive"))
    model = OptimalTree({"regularization": 0.005}).fit(rows, "expensive")
    return model.transform(rows).groupBy("leaf", "prediction").agg(F.count("*").alias("n"), F.sum(F.when(F.col("prediction") == F.col("expensive").cast("string"), 0).otherwise(1)).alias("wrong"))


@query()
def fit_tree_events(spark, sf):
    rows = read(spark, sf, "events").select((F.floor(F.col("value") / 20) * 20).cast("int").alias("level"), (F.col("user_id") % 3).cast("string").alias("cohort"), "event_type")
    model = OptimalTree({"regularization": 0.01}).fit(rows, "event_type")
    return model.confusion(rows, "event_type")


@query("SELECT date_trunc('day', ts) AS day, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS prediction, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def prediction_drift(spark, sf):
    from .streaming import drift

    model = TreeModel(Split("value", ">=", 50, Leaf("high", 0.0, 0.01), Leaf("low", 0.0, 0.01)))
    return drift(read(spark, sf, "events"), model, "ts").select(F.col("window.start").alias("day"), "prediction", "n")


from . import catalogue_steps  # noqa: E402, F401  registers its queries
