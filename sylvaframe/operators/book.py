"""The codex as tables, for any number of distinct values.

Thresholds and categories get dense ranks by range partitions with carried offsets, so no task and no driver holds them:
``references`` has one row for each predicate. Rows are encoded by the rank of their value, which is how many thresholds of
its column the value reaches (or which category it is): values and thresholds are ordered together once, and ``ranks`` has
one row for each distinct value. What reaches the driver is one row for each column, the classes, and the predicates of a
finished tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import cut
from . import ordered
from .profile import Predicate, profile, shortened, values_long

#: Distinct values of the target up to which it is one.
CLASSES = 10_000


@dataclass
class Book:
    """sizes: predicates of each column that has any, in the table's order; references (col, type, at, relation, reference,
    i, d); ranks (col, raw, rank); zero: the rank of a null where nulls compare as 0."""

    target: str
    classes: tuple[str, ...]
    source: tuple[str, ...]
    sizes: dict[str, int]
    kinds: dict[str, str]
    references: DataFrame
    ranks: DataFrame
    zero: dict[str, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return sum(self.sizes.values())

    @property
    def first(self) -> dict[str, int]:
        out, at = {}, 0
        for c, n in self.sizes.items():
            out[c], at = at, at + n
        return out

    def is_ordered(self, column: str) -> bool:
        return self.kinds[column] in ("Integral", "Rational")

    def frame(self) -> DataFrame:
        """(pos, col, type, relation, reference) of all predicates."""
        first = F.create_map(*[x for c, n in self.first.items() for x in (F.lit(c), F.lit(n))]) if self.sizes else F.create_map().cast("map<string,int>")
        return self.references.select((F.element_at(first, F.col("col")) + F.col("at")).cast("long").alias("pos"), "col", "type", "relation", "reference")

    def predicates(self, positions: list[int]) -> dict[int, Predicate]:
        """The predicates at some positions, those of a tree."""
        out = {}
        for r in self.frame().filter(F.col("pos").isin([int(x) for x in positions])).collect():
            value = int(r["reference"]) if r["type"] == "Integral" else float(r["reference"]) if r["type"] == "Rational" else r["reference"]
            out[r["pos"]] = Predicate(r["pos"], r["col"], r["type"], r["relation"], value)
        return out

    def encoded(self, df: DataFrame, keep: list[str | Column] = (), policy: str = "reference") -> DataFrame:
        """df's rows as ranks r0, r1, ... of the columns that have predicates, with further columns. Of each column the
        distinct values are joined, so a column costs a broadcast, or a shuffle where it has too many of them."""
        rows = df
        for i, c in enumerate(self.sizes):
            own = self.ranks.filter(F.col("col") == c).select(F.col("raw").alias(f"__raw{i}"), F.col("rank").alias(f"__rank{i}"))
            rows = rows.join(own, F.col(c).cast("string") == F.col(f"__raw{i}"), "left")
        null = {c: 0 if policy == "sql" or not self.is_ordered(c) else self.zero.get(c, 0) for c in self.sizes}
        nothing = lambda c: F.coalesce(F.col(c).cast("string") == "NaN", F.lit(False))
        return rows.select(*[F.when(nothing(c), F.lit(0)).otherwise(F.coalesce(f"__rank{i}", F.lit(null[c]))).cast("int").alias(f"r{i}") for i, c in enumerate(self.sizes)], *keep)


def book(df: DataFrame, target: str, columns: list[str] | None = None, precision: int = 0, found: DataFrame | None = None) -> Book:
    """found: the stored distinct values of the columns and the target, if at hand."""
    columns = [c for c in (columns or df.columns) if c != target]
    if found is None:
        found = cut(values_long(df, [*columns, target]), "values")
    profiled = {r["col"]: r for r in profile(df, [*columns, target], target, found).collect()}
    wanted = [c for c in columns if c in profiled and profiled[c]["type"] != "Redundant"]
    kinds = {c: profiled[c]["type"] for c in wanted}
    classes = [r["value"] for r in found.filter((F.col("col") == target) & F.col("value").isNotNull()).select("value").limit(CLASSES + 1).collect()]
    if len(classes) > CLASSES:
        raise ValueError(f"the target has more than {CLASSES} distinct values")
    of = lambda *types: F.col("col").isin([c for c in wanted if kinds[c] in types])
    values = found.filter(F.col("value").isNotNull()).select("col", F.col("value").alias("raw"))
    # numbers
    i, d = F.when(of("Integral"), F.col("x").try_cast("bigint")), F.when(of("Rational"), F.col("x").try_cast("double"))
    numeric = values.filter(of("Integral", "Rational"))
    points = numeric.withColumn("x", shortened("raw", precision) if precision else F.col("raw")).select("col", i.alias("i"), d.alias("d")).filter("i is not null or (d is not null and not isnan(d))").distinct()
    pairs = ordered.previous(ordered.ranged(points, ["col", "i", "d"], "points"), ["i", "d"], ["i", "d"], ["col"])
    holes = F.col("col").isin([c for c in wanted if profiled[c]["has_null"]])
    mid = 0.5 * (F.col("d") + F.col("prev_d"))
    near = F.round(mid, 6)
    mid = F.when((F.col("prev_d") < near) & (near <= F.col("d")), near).otherwise(mid)
    has = F.col("prev_i").isNotNull() | F.col("prev_d").isNotNull() | (F.col("i").isNotNull() & holes)
    tests = pairs.filter(has).select("col", F.lit(">=").alias("relation"), F.coalesce(F.col("i").cast("string"), mid.cast("string")).alias("reference"), "i", F.when(F.col("i").isNull(), mid).alias("d"))
    # categories
    names = values.filter(of("Categorical") & (F.col("col") != target)).unionByName(values.filter(of("Binary")).groupBy("col").agg(F.max("raw").alias("raw")))
    tests = tests.unionByName(names.select("col", F.lit("==").alias("relation"), F.col("raw").alias("reference"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d")))
    order = ["i", "d", "reference"]
    numbered = ordered.running(ordered.ranged(tests, ["col", *order], "tests"), order, F.lit(1), "upto", ["col"])
    kind = F.coalesce(*[F.when(F.col("col") == c, F.lit(k)) for c, k in kinds.items()]) if kinds else F.lit("")
    references = cut(numbered.select("col", kind.alias("type"), (F.col("upto") - 1).cast("int").alias("at"), "relation", "reference", "i", "d"), "references")
    facts = {r["col"]: r for r in references.groupBy("col").agg(F.count("*").alias("n"), F.count_if((F.col("i") <= 0) | (F.col("d") <= 0)).alias("zero")).collect()}
    # values and thresholds in one order: a value reaches the thresholds up to it
    marks = references.filter("relation = '>='").select("col", "i", "d", F.lit(0).alias("after"), F.lit(None).cast("string").alias("raw"))
    held = numeric.withColumn("x", F.col("raw")).select("col", i.alias("i"), d.alias("d"), F.lit(1).alias("after"), "raw").filter("i is not null or d is not null")
    order = ["i", "d", "after", "raw"]
    reached = ordered.running(ordered.ranged(marks.unionByName(held), ["col", *order], "reached"), order, F.when(F.col("after") == 0, 1).otherwise(0), "rank", ["col"])
    ranks = reached.filter("after = 1").select("col", "raw", F.col("rank").cast("int").alias("rank"))
    ranks = ranks.unionByName(references.filter("relation = '=='").select("col", F.col("reference").alias("raw"), (F.col("at") + 1).cast("int").alias("rank")))
    sizes = {c: facts[c]["n"] for c in wanted if c in facts}
    return Book(target, tuple(sorted(classes)), tuple(columns), sizes, kinds, references, cut(ranks, "ranks"), {c: facts[c]["zero"] for c in sizes})
