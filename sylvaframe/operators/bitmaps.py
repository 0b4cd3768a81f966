"""Sets of rows as bitmaps: algebra on packed integers and aggregated bitmaps, scans and runs as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def algebra(a: Column, b: Column, width: int) -> dict[str, Column]:
    """and, or, xor, andnot, xnor and counts of two bit sets of a width."""
    full = F.lit((1 << width) - 1).cast("long")
    a, b = a.cast("long"), b.cast("long")
    return {
        "bits_and": a.bitwiseAND(b),
        "bits_or": a.bitwiseOR(b),
        "bits_xor": a.bitwiseXOR(b),
        "bits_andnot": a.bitwiseAND(F.bitwise_not(b)),
        "bits_xnor": F.bitwise_not(a.bitwiseXOR(b)).bitwiseAND(full),
        "ones": F.bit_count(a).cast("long"),
        "is_empty": a == 0,
        "is_full": a == full,
        "is_subset": a.bitwiseAND(F.bitwise_not(b)) == 0,
    }


def single_bits(x: Column, at: Column, width: int) -> dict[str, Column]:
    """Bit ``at`` of a set read, set and cleared; the complement, its text, its size, and whether it is the smaller number."""
    full, one = F.lit((1 << width) - 1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), at)
    inverse = full.bitwiseXOR(x)
    return {
        "bit_get": x.bitwiseAND(one) != 0,
        "bit_set": x.bitwiseOR(one),
        "bit_clear": x.bitwiseAND(full.bitwiseXOR(one)),
        "bits_not": inverse,
        "bits_text": F.lpad(F.bin(x), width, "0"),
        "ones": F.bit_count(x).cast("long"),
        "less": x < inverse,
    }


def constructed(df: DataFrame, position: str) -> DataFrame:
    """(bucket, bitmap, ones): positions from 1 as bitmaps of 32768 bits, any number of them."""
    agg = df.groupBy(F.bitmap_bucket_number(position).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bitmap"))
    return agg.withColumn("ones", F.bitmap_count("bitmap"))


def runs(df: DataFrame, by: str, position: str, bit: Column) -> DataFrame:
    """(by, start, length): maximal runs of consecutive positions whose bit is set."""
    on = df.filter(bit).withColumn("__island", F.col(position) - F.row_number().over(W.partitionBy(by).orderBy(position)))
    return on.groupBy(by, "__island").agg(F.min(position).alias("start"), F.count("*").alias("length")).drop("__island")


def scans(df: DataFrame, by: str, position: str, bit: Column, at: int) -> DataFrame:
    """(by, following, preceding): the first set position from ``at`` on, and the last up to it; -1 where there is none."""
    on = df.filter(bit)
    return on.groupBy(by).agg(F.coalesce(F.min(F.when(F.col(position) >= at, F.col(position))), F.lit(-1)).alias("following"), F.coalesce(F.max(F.when(F.col(position) <= at, F.col(position))), F.lit(-1)).alias("preceding"))


def partition(df: DataFrame, tests: list[str], positive: list[bool]) -> DataFrame:
    """The rows of a capture set: a conjunction of predicates or their negations."""
    for t, yes in zip(tests, positive):
        df = df.filter(F.col(t) == (1 if yes else 0))
    return df


class Bits:
    """Sets of group numbers as Python integers, for searches on the driver."""

    @staticmethod
    def of(positions) -> int:
        out = 0
        for p in positions:
            out |= 1 << p
        return out

    @staticmethod
    def ones(n: int) -> int:
        return (1 << n) - 1

    @staticmethod
    def positions(x: int) -> list[int]:
        out = []
        while x:
            low = x & -x
            out.append(low.bit_length() - 1)
            x ^= low
        return out

    @staticmethod
    def following(x: int, at: int) -> int:
        """The first set position from at on, or -1."""
        y = x >> at
        return at + (y & -y).bit_length() - 1 if y else -1

    @staticmethod
    def preceding(x: int, at: int) -> int:
        return (x & ((1 << (at + 1)) - 1)).bit_length() - 1

    @staticmethod
    def runs(x: int) -> int:
        return (x & ~(x << 1)).bit_count()
