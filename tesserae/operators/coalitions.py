"""Coalitions of features as bit masks: closures, classes, budgets and draws, as column expressions.

Bit i of a mask is feature i. One whole number holds up to 62 features; more go into several (see words()).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import mask_of, seeded, seeded_hex

BITS = 62


def words(features: list[str]) -> list[list[str]]:
    """Features in groups of at most BITS, each with a mask of its own."""
    return [features[i : i + BITS] for i in range(0, len(features), BITS)]


def rule_masks(rules: Iterable[tuple[tuple[str, ...], str]], features: list[str]) -> list[tuple[int, int]]:
    """(left mask, right mask) of the rules whose columns are all features; names match whatever their letter case."""
    low = {f.lower() for f in features}
    got = [(mask_of(list(lhs), features), mask_of([rhs], features)) for lhs, rhs in rules if {*map(str.lower, lhs), rhs.lower()} <= low]
    return sorted(set(got))


def close_mask(mask: int, rules: list[tuple[int, int]]) -> int:
    while True:
        new = reduce(lambda m, r: m | r[1] if m & r[0] == r[0] else m, rules, mask)
        if new == mask:
            return mask
        mask = new


def closed(mask: Column, rules: list[tuple[int, int]]) -> Column:
    """Closure of a mask under the rules. Each rule gives the closure of its left side, so that what follows from single
    features comes in one round; left sides of several features may need one each."""
    if not rules:
        return mask
    rules = [(a, close_mask(a, rules)) for a in sorted({a for a, _ in rules})]
    rounds = 1 + sum(a.bit_count() > 1 for a, _ in rules)

    def step(m: Column, _: Column) -> Column:
        add = [F.when(m.bitwiseAND(F.lit(a)) == F.lit(a), F.lit(b)).otherwise(F.lit(0)).cast("long") for a, b in rules]
        return reduce(lambda x, y: x.bitwiseOR(y), add, m)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), mask.cast("long"), lambda acc, i: step(acc, i))


def all_masks(spark: SparkSession, n: int) -> DataFrame:
    if n > 24:
        raise ValueError("too many features for all coalitions; draw some")
    return spark.range(1 << n).select(F.col("id").alias("mask"))


def canonical(masks: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Adds canon, the closure: equal ones are one class, evaluated once."""
    return masks.withColumn("canon", closed(F.col("mask"), rules))


def classes(masks: DataFrame, rules: list[tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, canon, n_masks) of the distinct classes."""
    return canonical(masks, rules).groupBy(*keys, "canon").agg(F.count("*").alias("n_masks"))


def budget(draws: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n distinct classes of each row in order of drawing."""
    first = draws.groupBy(key, "canon").agg(F.min(order).alias(order))
    w = Window.partitionBy(key).orderBy(order)
    return first.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def first_draws(draws: DataFrame, key: str, classes: list[str], n: int, order: str = "draw") -> DataFrame:
    """Of each row's draws those whose class is new, the first n in order of drawing."""
    new = draws.withColumn("_t", F.row_number().over(Window.partitionBy(key, *classes).orderBy(order))).filter("_t = 1").drop("_t")
    return new.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_i") <= n).drop("_i")


def size_histogram(masks: DataFrame, column: str = "mask") -> DataFrame:
    return masks.groupBy(F.bit_count(column).cast("int").alias("size")).agg(F.count("*").alias("n"))


#: With at most so many features, draws compare them pair by pair in generated code; more are sorted in arrays.
COMPARED = 8


def draws(rows: DataFrame, key: str, n: int, features: int, seed: int) -> DataFrame:
    """(key, draw, pivot, before, after): n draws a row of a pivot feature and a random set of others, its size
    uniform from 0 to features - 1; after is before with the pivot. All from md5, so that reruns agree."""
    # A join, not explode: Spark takes what explode makes for as small as its input, and would broadcast it.
    d = rows.select(key).join(F.broadcast(rows.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("draw"))), F.lit(True), "inner")
    text = lambda what: F.concat_ws("|", F.col(key).cast("string"), F.col("draw").cast("string"), F.lit(what))
    d = d.withColumn("pivot", (seeded(text("pivot"), seed) % features).cast("int")).withColumn("_size", (seeded(text("size"), seed) % features).cast("int"))
    if features <= COMPARED:
        d = d.withColumns({f"_h{i}": seeded_hex(text(f"f{i}"), seed) for i in range(features)})
        bits = [F.when((F.col("pivot") != i) & (_rank(i, features) < F.col("_size")), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(features)]
        before = reduce(lambda a, b: a.bitwiseOR(b), bits)
    else:
        ranked = F.array_sort(F.filter(F.array(*[F.struct(seeded_hex(text(f"f{i}"), seed).alias("h"), F.lit(i).alias("i")) for i in range(features)]), lambda x: x["i"] != F.col("pivot")))
        bits = F.transform(F.slice(ranked, F.lit(1), F.col("_size")), lambda x: F.expr("1L") * F.pow(F.lit(2.0), x["i"]).cast("long"))
        before = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    pivot_bit = F.pow(F.lit(2.0), F.col("pivot")).cast("long")
    return d.select(key, "draw", "pivot", before.alias("before")).withColumn("after", F.col("before").bitwiseOR(pivot_bit))


def _rank(i: int, features: int) -> Column:
    """How many features but the pivot come before feature i in order of (_h, number)."""
    h = [F.col(f"_h{j}") for j in range(features)]
    less = [(F.col("pivot") != j) & (h[j] <= h[i] if j < i else h[j] < h[i]) for j in range(features) if j != i]
    return reduce(lambda a, b: a + b, [x.cast("int") for x in less], F.lit(0))
