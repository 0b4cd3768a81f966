"""Column expressions: type tests on text, significant digits, impurities, digits of a radix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings that count as null.
NULL_TOKENS = ("", "NULL", "null", "Null", "NA", "na", "NaN")
INTEGRAL = r"^[+-]?[0-9]+$"
RATIONAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]*)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_null_token(c: Column | str) -> Column:
    return col(c).isNull() | col(c).isin(*NULL_TOKENS)


def is_integral(c: Column | str) -> Column:
    return col(c).rlike(INTEGRAL)


def is_rational(c: Column | str) -> Column:
    return col(c).rlike(RATIONAL)


def significant(c: Column | str, digits: int) -> Column:
    """Round to the given number of significant digits, half away from zero; zero stays."""
    v = col(c).cast("double")
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - digits + 1)
    return F.when(v == 0, v).otherwise(F.round(v / step) * step)


def digit(c: Column | str, place: int, base: int = 10) -> Column:
    """The digit of an integer at a place of a radix."""
    return F.pmod(F.floor(col(c) / F.lit(base**place)), F.lit(base)).cast("int")


def entropy(counts: list[Column], total: Column) -> Column:
    """Entropy in nats of class counts."""
    part = lambda c: F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(0.0)
    return reduce(lambda a, b: a + b, [part(c) for c in counts])


def gini(counts: list[Column], total: Column) -> Column:
    return F.lit(1.0) - reduce(lambda a, b: a + b, [(c / total) * (c / total) for c in counts])


def support_information(counts: list[Column], total: Column, n: Column) -> Column:
    """The information term support * c * (ln c - ln support), summed over classes; c counts rows, support is a share."""
    support = total / n
    part = lambda c: F.when(c > 0, support * c * (F.ln(c.cast("double")) - F.ln(support))).otherwise(0.0)
    return reduce(lambda a, b: a + b, [part(c) for c in counts])
