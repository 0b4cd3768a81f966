"""Column profiles, type inference, and the dictionary of predicates ("codex").

One aggregation finds the distinct values of all columns; types follow from what every value satisfies, so the result
doesn't depend on row order. Columns that the schema says are numbers are numbers, however their values are written; text
is tested by pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_integral, is_null_token, is_rational, significant
from . import ordered


def values_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, n): distinct text values of each column and how often they occur; null tokens become null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("raw")) for c in columns])
    rows = df.select(F.explode(pairs).alias("p")).select("p.col", F.when(~is_null_token("p.raw"), F.col("p.raw")).alias("value"))
    return rows.groupBy("col", "value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None, target: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """(col, type, cardinality, has_null): Redundant, Binary, Integral, Rational or Categorical; the target is Categorical.
    values: values_long of the columns, if it is at hand."""
    columns = columns or df.columns
    v = values_long(df, columns) if values is None else values
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = F.col("col").isin([c for c in columns if isinstance(kinds[c], T.IntegralType)])
    number = F.col("col").isin([c for c in columns if isinstance(kinds[c], (T.FractionalType, T.DecimalType))])
    agg = v.groupBy("col").agg(
        F.count("value").alias("cardinality"),
        F.coalesce(F.bool_or(F.col("value").isNull()), F.lit(False)).alias("has_null"),
        F.bool_and(is_integral("value")).alias("ints"),
        F.bool_and(is_integral("value") | is_rational("value")).alias("numbers"),
    )
    kind = F.when(F.col("cardinality") <= 1, "Redundant").when((F.col("cardinality") == 2) & ~F.col("has_null"), "Binary")
    kind = kind.when(whole, "Integral").when(number, "Rational").when(F.col("ints"), "Integral").when(F.col("numbers"), "Rational").otherwise("Categorical")
    if target is not None:
        kind = F.when(F.col("col") == target, "Categorical").otherwise(kind)
    return agg.select("col", kind.alias("type"), "cardinality", "has_null")


def midpoints(df: DataFrame, column: str) -> DataFrame:
    """(threshold): halfway between consecutive distinct values, to 6 decimals. Values are ordered over range partitions."""
    v = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).distinct()
    pairs = ordered.previous(ordered.ranged(v, ["v"], "midpoints"), ["v"], ["v"])
    return pairs.select(F.round(0.5 * (F.col("v") + F.col("prev_v")), 6).alias("threshold")).filter("threshold is not null")


def integral_thresholds(df: DataFrame, column: str) -> DataFrame:
    """(threshold): the distinct integers but the least, which every row satisfies; kept where nulls may fall below it."""
    v = df.select(F.col(column).cast("long").alias("threshold"))
    least = v.agg(F.min("threshold").alias("least"), F.coalesce(F.bool_or(F.col("threshold").isNull()), F.lit(False)).alias("holes"))
    return v.filter("threshold is not null").distinct().crossJoin(F.broadcast(least)).filter("holes or threshold > least").select("threshold")


def bucketized(df: DataFrame, column: str, label: str) -> DataFrame:
    """(threshold): midpoints but those whose neighbours carry one and the same label. The labels of a value count as its
    least, its greatest and whether there are others, so a value holds two of them at most."""
    v = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.min(label).alias("least"), F.max(label).alias("most"))
    pairs = ordered.previous(ordered.ranged(v, ["v"], "buckets"), ["v"], ["v", "least", "most"])
    # null labels count for nothing
    pairs = pairs.filter(F.col("prev_v").isNotNull() & (F.least("least", "prev_least") < F.greatest("most", "prev_most")))
    return pairs.select(F.round(0.5 * (F.col("v") + F.col("prev_v")), 6).alias("threshold"))


def limited(df: DataFrame, column: str, digits: int) -> DataFrame:
    """(threshold): distinct values of a column at a limited precision."""
    return df.filter(F.col(column).isNotNull()).select(F.round(significant(column, digits), 6).alias("threshold")).distinct()


@dataclass(frozen=True)
class Predicate:
    """One boolean test of a source column."""

    pos: int
    col: str
    type: str
    relation: str
    reference: object

    def column(self, policy: str = "reference") -> Column:
        """The test. Policy ``reference`` compares a null number as 0 (text NaN never holds); ``sql`` makes null false."""
        c = F.col(self.col)
        if self.relation == "==":
            return F.coalesce(c.cast("string") == F.lit(str(self.reference)), F.lit(False))
        kind = "long" if self.type == "Integral" else "double"
        number = c.try_cast(kind)
        if policy == "sql":
            return F.coalesce(~F.isnan(number.cast("double")) & (number >= F.lit(self.reference)), F.lit(False))
        undefined = c.cast("string") == F.lit("NaN")
        as_zero = F.coalesce(F.when(undefined, F.lit(None)).otherwise(number), F.lit(0).cast(kind))
        return F.when(undefined & F.lit(kind == "double"), F.lit(False)).otherwise(as_zero >= F.lit(self.reference))

    def __str__(self) -> str:
        return f"{self.col} {self.relation} {self.reference}"


@dataclass(frozen=True)
class Codex:
    """The predicates of a table in order, and its classes."""

    predicates: tuple[Predicate, ...]
    target: str
    classes: tuple[str, ...]
    source: tuple[str, ...]

    def __len__(self) -> int:
        return len(self.predicates)

    def of(self, column: str) -> list[Predicate]:
        return [p for p in self.predicates if p.col == column]

    def nearest(self, column: str, reference: float) -> Predicate:
        """The predicate of a numeric column whose reference is nearest."""
        return min(self.of(column), key=lambda p: (abs(float(p.reference) - reference), p.pos))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(p.pos, p.col, p.type, p.relation, str(p.reference)) for p in self.predicates], "pos int, col string, type string, relation string, reference string")


def _limit(x: Fraction | int, digits: int):
    if not digits or x == 0:
        return x
    from math import floor, log10

    step = Fraction(10) ** (floor(log10(abs(float(x)))) - digits + 1)
    q = abs(Fraction(x)) / step
    r = int(q + Fraction(1, 2)) * step * (1 if x > 0 else -1)
    return int(r) if isinstance(x, int) and r.denominator == 1 else r


def _number(text: str) -> Fraction | None:
    """The exact value of a number's text; a lone point is 0, and what isn't finite has none."""
    try:
        return Fraction(text)
    except ValueError:
        return Fraction(0) if text.strip("+-") == "." else None


class TooManyValues(ValueError):
    """A codex that the driver should not hold; ``book.book`` makes it a table."""


def shortened(column: str, precision: int) -> Column:
    """The text of a number at so many significant digits."""

    @F.pandas_udf("string")
    def short(value: pd.Series) -> pd.Series:
        numbers = [_number(v) for v in value]
        cut = (None if x is None else _limit(int(x) if x.denominator == 1 else x, precision) for x in numbers)
        return pd.Series([v if x is None else str(x) if isinstance(x, int) else repr(float(x)) for v, x in zip(value, cut)], dtype=object)

    return short(column)


def codex(df: DataFrame, target: str, columns: list[str] | None = None, precision: int = 0, limit: int = 100_000) -> Codex:
    """Predicates of all columns in order. The distinct values are found once and stored; numbers are brought to the wanted
    precision by the executors; and the driver gets the values, of which the predicates are made, only after they have
    been counted: more than ``limit`` are an error."""
    from ..store import cut

    columns = [c for c in (columns or df.columns) if c != target]
    found = cut(values_long(df, [*columns, target]), "values")
    kinds = {r["col"]: r for r in profile(df, [*columns, target], target, found).collect()}
    wanted = [c for c in columns if c in kinds and kinds[c]["type"] != "Redundant"]
    values = found.filter(F.col("value").isNotNull() & F.col("col").isin([*wanted, target])).select("col", "value")
    if precision:
        numeric = F.col("col").isin([c for c in wanted if kinds[c]["type"] in ("Integral", "Rational")])
        values = cut(values.select("col", F.when(numeric, shortened("value", precision)).otherwise(F.col("value")).alias("value")).distinct(), "short")
    n = values.count()
    if n > limit:
        raise TooManyValues(f"{n} distinct values would make as many predicates; set precision_limit, drop columns or raise predicate_limit ({limit})")
    held: dict[str, list[str]] = {}
    for r in values.collect():
        held.setdefault(r["col"], []).append(r["value"])
    out: list[Predicate] = []
    for c in wanted:
        kind, own = kinds[c]["type"], held.get(c, [])
        if kind == "Binary":
            tests = [("==", max(own))]
        elif kind == "Categorical":
            tests = [("==", v) for v in sorted(own)]
        else:
            numbers = sorted({x for v in own if (x := _number(v)) is not None})
            if kind == "Integral":
                tests = [(">=", int(v)) for v in (numbers if kinds[c]["has_null"] else numbers[1:])]
            else:
                points = sorted({float(x) for x in numbers})
                tests = list(dict.fromkeys((">=", midpoint(a, b)) for a, b in zip(points, points[1:])))
        for relation, reference in tests:
            out.append(Predicate(len(out), c, kind, relation, reference))
    return Codex(tuple(out), target, tuple(sorted(held.get(target, []))), tuple(columns))


def midpoint(a: float, b: float) -> float:
    """Halfway between two neighbours, to 6 decimals where that still parts them."""
    mid = 0.5 * (a + b)
    return round(mid, 6) if a < round(mid, 6) <= b else mid
