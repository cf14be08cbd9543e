"""Scalar functions: canonical values, lists, intervals, bins, masks and predicate builders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean true and false (fixed values).
TRUE_TEXTS = ("true", "t", "1", "yes", "y")
FALSE_TEXTS = ("false", "f", "0", "no", "n")
#: Texts that mean null in a constraint's value (fixed values).
NULL_TEXTS = ("IS_NULL", "NULL", "NAN", "")


def canonical(text: Column) -> Column:
    """Canonical text of a scalar given as text: null and NaN are null, whole floats lose their fraction, spaces
    around go, and texts that mean true or false are "true" or "false"."""
    t = F.trim(text)
    whole = F.regexp_replace(t, r"^([+-]?\d+)\.0*$", "$1")
    return F.when(t.isNull() | F.lower(t).isin("", "nan"), None).when(F.lower(whole).isin(*TRUE_TEXTS), "true").when(F.lower(whole).isin(*FALSE_TEXTS), "false").otherwise(whole)


def as_number(text: Column) -> Column:
    """Number of a text, null where it is none; NaN counts as null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def as_bit(text: Column) -> Column:
    """1 for true, 0 for false, else null."""
    t = canonical(text)
    return F.when(t == "true", 1).when(t == "false", 0)


def sorted_tokens(text: Column, separator: str = r"\|") -> Column:
    """Tokens of a list in order, joined again, without spaces around and without empty ones."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(parts), separator.replace("\\", ""))


def normal_lhs(text: Column) -> Column:
    """Left side of a dependency as a sorted array of trimmed names without quotes."""
    return F.array_sort(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(F.regexp_replace(x, "[\"'`]", ""))), lambda x: x != ""))


def interval_bounds(label: Column) -> Column:
    """struct(lo, hi, lo_inclusive, hi_inclusive) of labels like [3-5], (3,5], [.5-1] or [+3-5); null if it is none."""
    number = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))"
    pattern = rf"^\s*([\[(])\s*{number}\s*[-,]\s*{number}\s*([\])])\s*$"
    part = lambda i: F.regexp_extract(label, pattern, i)
    bounds = F.struct(part(2).try_cast("double").alias("lo"), part(3).try_cast("double").alias("hi"), (part(1) == "[").alias("lo_inclusive"), (part(4) == "]").alias("hi_inclusive"))
    return F.when(label.rlike(pattern), bounds)


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct edges of equal-count bins by linear interpolation; driver gets bins + 1 numbers."""
    qs = [i / bins for i in range(bins + 1)]
    got = df.select(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, qs))).alias("q")).first()["q"]
    return sorted(set(got or []))


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin, the first one closed on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        out = F.when((value >= lo if i == 0 else value > lo) & (value <= hi), i).otherwise(out)
    return out


def in_interval(value: Column, lo, hi, lo_inclusive=True, hi_inclusive=True) -> Column:
    above = value >= lo if lo_inclusive is True else F.when(lo_inclusive, value >= lo).otherwise(value > lo) if lo_inclusive is not False else value > lo
    below = value <= hi if hi_inclusive is True else F.when(hi_inclusive, value <= hi).otherwise(value < hi) if hi_inclusive is not False else value < hi
    return above & below


def atom(column: Column, op: str, value) -> Column:
    """Predicate column op value for =, !=, <, <=, >, >=, IN, IS_NULL; an equality with a null token tests for null."""
    if op == "IS_NULL" or op == "=" and (value is None or str(value).upper() in NULL_TEXTS):
        return column.isNull()
    if op == "IN":
        return column.isin(list(value))
    compare = {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}
    return compare[op]


def id_name_pattern(names: list[str]) -> re.Pattern:
    """Matches names that are, or end after an underscore in, one of the id words; letter case doesn't matter."""
    return re.compile(rf"(?:^|_)(?:{'|'.join(map(re.escape, names))})$", re.I)


def mask_of(columns: list[str], features: list[str]) -> int:
    """Bit i for feature i; names match whatever their letter case."""
    place = {f.lower(): i for i, f in enumerate(features)}
    return sum(1 << i for i in {place[c.lower()] for c in columns if c.lower() in place})


def columns_of(mask: int, features: list[str]) -> list[str]:
    return [f for i, f in enumerate(features) if mask >> i & 1]


def seeded(key: Column, seed: int | str) -> Column:
    """A number in 0 to 2^32 - 1 from a row's key, the same in any SQL engine with md5."""
    return F.conv(seeded_hex(key, seed), 16, 10).cast("long")


def seeded_hex(key: Column, seed: int | str) -> Column:
    """seeded() as eight hexadecimal digits, which sort like the numbers."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
