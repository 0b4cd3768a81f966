"""Encoders: rows to bits, one-hot columns, radix digits, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digit
from .profile import Codex

WORD = 62


def bit(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def encode(df: DataFrame, tests: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """One 0/1 column for each named test: a projection inside whole-stage codegen."""
    return df.select(*keep, *[bit(t).alias(n) for n, t in tests.items()])


#: A column of more predicates than this is packed by the rank of its value among them, not by a test for each.
TESTED = 32


def _long_runs(book: Codex) -> dict[str, list]:
    held: dict[str, list] = {}
    for p in book.predicates:
        held.setdefault(p.col, []).append(p)
    return {c: ps for c, ps in held.items() if len(ps) > TESTED}


def ranks(book: Codex, policy: str = "reference") -> dict[str, Column]:
    """For columns of many predicates, how many thresholds a value reaches, or which category it is (from 1; 0: none)."""
    out = {}
    for k, (col, ps) in enumerate(_long_runs(book).items()):
        c = F.col(col)
        if ps[0].relation == "==":
            out[f"__rank{k}"] = F.coalesce(F.array_position(F.lit([str(p.reference) for p in ps]), c.cast("string")), F.lit(0)).cast("int")
            continue
        kind = "long" if ps[0].type == "Integral" else "double"
        number = c.try_cast(kind)
        nothing = F.isnan(number.cast("double")) | (c.cast("string") == F.lit("NaN"))
        if policy != "sql":
            number = F.coalesce(number, F.lit(0).cast(kind))
        edges = F.lit([p.reference for p in ps]).cast(f"array<{'bigint' if kind == 'long' else 'double'}>")
        reached = F.size(F.filter(edges, lambda e: e <= number))
        out[f"__rank{k}"] = F.when(F.coalesce(nothing, F.lit(False)) & (F.lit(kind == "double") | F.lit(policy == "sql")), F.lit(0)).otherwise(F.when(number.isNull(), F.lit(0)).otherwise(reached)).cast("int")
    return out


def packed(book: Codex, policy: str = "reference", ranked: bool = False) -> list[Column]:
    """The predicates as words of 62 bits, predicate 62 * w + b in bit b of word w. Columns of many predicates are read
    from their ranks; ranked: the table has these as columns already (``ranks``), so no word finds them anew."""
    found = {n: F.col(n) if ranked else c for n, c in ranks(book, policy).items()}
    runs = {c: (f"__rank{k}", ps) for k, (c, ps) in enumerate(_long_runs(book).items())}
    zero, out = F.lit(0).cast("long"), []
    for w in range(0, len(book), WORD):
        word, here = zero, book.predicates[w : w + WORD]
        for c in dict.fromkeys(p.col for p in here):
            own = [p for p in here if p.col == c]
            if c not in runs:
                for p in own:
                    word = word.bitwiseOR(F.when(p.column(policy), F.lit(1 << (p.pos - w)).cast("long")).otherwise(zero))
                continue
            name, ps = runs[c]
            first, at = own[0].pos - ps[0].pos, own[0].pos - w
            r = found[name] - first  # within this word's part of the run
            if own[0].relation == "==":
                word = word.bitwiseOR(F.when(r.between(1, len(own)), F.call_function("shiftleft", F.lit(1).cast("long"), r - 1 + at)).otherwise(zero))
            else:
                size = F.greatest(F.lit(0), F.least(r, F.lit(len(own))))
                ones = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1
                word = word.bitwiseOR(F.call_function("shiftleft", ones, F.lit(at)))
        out.append(word.alias(f"w{w // WORD}"))
    return out


def ranks_of_words(book: Codex, names: list[str]) -> list[tuple[Column, int, bool]]:
    """(rank, predicates, whether they are thresholds) of each column that has predicates, from the packed words: how many
    thresholds are reached, or which category holds (from 1; 0: none)."""
    held: dict[str, list] = {}
    for p in book.predicates:
        held.setdefault(p.col, []).append(p)
    out = []
    for ps in held.values():
        rank, ordered = F.lit(0), ps[0].relation == ">="
        for w in dict.fromkeys(p.pos // WORD for p in ps):
            own = [p.pos % WORD for p in ps if p.pos // WORD == w]
            bits = F.shiftright(F.col(names[w]), own[0]).bitwiseAND(F.lit((1 << len(own)) - 1).cast("long"))
            before = w * WORD + own[0] - ps[0].pos
            # of a category, the one bit that is set has as many zeros below it as there are categories before
            rank = rank + (F.bit_count(bits) if ordered else F.when(bits != 0, F.bit_count(bits - 1) + before + 1).otherwise(0))
        out.append((rank.cast("int"), len(ps), ordered))
    return out


def one_hot(df: DataFrame, column: str, values: list[str], keep: list[str] = ()) -> DataFrame:
    return encode(df, {f"is_{v.lower()}": F.coalesce(F.col(column) == v, F.lit(False)) for v in values}, keep)


def radix(df: DataFrame, column: str, places: int, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[digit(column, k).alias(f"d{k}") for k in range(places)])


def decode_row(book: Codex, bits: list[int]) -> dict[str, tuple]:
    """What the bits of a row say of each source column: ("==", value) or (">=", lower, upper)."""
    out: dict[str, tuple] = {}
    for p in book.predicates:
        if p.relation == "==" and bits[p.pos]:
            out[p.col] = ("==", p.reference)
        elif p.relation == ">=":
            _, lo, hi = out.get(p.col, (">=", None, None))
            if bits[p.pos]:
                lo = p.reference if lo is None else max(lo, p.reference)
            else:
                hi = p.reference if hi is None else min(hi, p.reference)
            out[p.col] = (">=", lo, hi)
    return out
