"""Relational building blocks that plain SQL lacks or that need a deterministic form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import bin_of, in_interval, interval_bounds, quantile_edges, seeded
from tesserae.sources.store import numbered

#: Bits of a seeded hash below those that a split counts rows by: 2 ** 16 buckets of a label.
SPLIT_BITS = 16


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in `order`; partial limits run before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes from 0 by order of value; only the distinct values are sorted, over all partitions."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    codes = numbered(values, [F.col("value")], "code", 0).select(F.col("value").alias(column), F.col("code").cast("int").alias(out))
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def unpivot(df: DataFrame, keys: list[str], groups: dict[str, dict[str, str]], name: str) -> DataFrame:
    """Long form: for each label one row with the columns renamed as {target: source} says."""
    parts = [df.select(*keys, F.lit(label).alias(name), *[F.col(c).alias(t) for t, c in cols.items()]) for label, cols in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def pivot_back(df: DataFrame, keys: list[str], name: str, labels: list[str], values: list[str]) -> DataFrame:
    """Wide form in one aggregation; column <label>_<value> for each label and value."""
    pick = [F.max(F.when(F.col(name) == lab, F.col(v))).alias(f"{lab}_{v}") for lab in labels for v in values]
    return df.groupBy(*keys).agg(*pick)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def exclude(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df without an equal row, nulls included, in other."""
    a, b = df.alias("a"), other.alias("b")
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]), "left_anti")


def matching_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of df that occur in other, nulls equal."""
    a, b = df.alias("a"), other.alias("b")
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in other.columns]), "left_semi")


def merge_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that refuses keys that occur twice on either side."""
    for side, df in (("left", left), ("right", right)):
        if not df.groupBy(*on).count().filter("count > 1").isEmpty():
            raise ValueError(f"keys {on} are not unique on the {side}")
    return left.join(right, on, how)


def in_key_order(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df in the order in which keys (on, ordinal) lists its rows."""
    return df.join(keys, on).orderBy("ordinal").drop("ordinal")


def fk_violations(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """One row n_violations: rows of child with a full key that parent lacks."""
    keyed = child.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    target = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns, strict=True)])
    return keyed.join(target, columns, "left_anti").agg(F.count("*").alias("n_violations"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top1(df, keys, order)


def nearest_bucket(df: DataFrame, value: str, rules: DataFrame, out: str, max_rules: int = 10_000) -> DataFrame:
    """Label of the interval that holds the value, or else lies nearest to it; ties go to the lower and then the
    first rule. rules (rule_id, label, lo, hi, lo_inclusive, hi_inclusive) is a small table, whose size is checked;
    distinct values meet it, not rows. Null and NaN values get null."""
    if rules.limit(max_rules + 1).count() > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    v = F.col("_v")
    values = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).distinct()
    inside = in_interval(v, F.col("lo"), F.col("hi"), F.col("lo_inclusive"), F.col("hi_inclusive"))
    distance = F.when(inside, 0.0).otherwise(F.least(F.abs(v - F.col("lo")), F.abs(v - F.col("hi"))))
    met = values.join(F.broadcast(rules), F.lit(True), "inner")
    best = met.groupBy("_v").agg(F.min_by("label", F.struct((~inside).alias("out"), distance.alias("d"), F.col("lo"), F.col("rule_id"))).alias(out))
    return df.join(best, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def bucket_rules(df: DataFrame, label: str, base: str) -> DataFrame:
    """(rule_id, bucket_col, base_col, label, lo, hi, lo_inclusive, hi_inclusive) from a column's interval labels."""
    parsed = df.select(F.col(label).alias("label")).distinct().withColumn("b", interval_bounds(F.col("label"))).filter("b is not null")
    ranked = parsed.withColumn("rule_id", F.row_number().over(Window.orderBy("b.lo", "b.hi", "label")))
    return ranked.select("rule_id", F.lit(label).alias("bucket_col"), F.lit(base).alias("base_col"), "label", "b.lo", "b.hi", "b.lo_inclusive", "b.hi_inclusive")


def reciprocal_partners(df: DataFrame, row_id: str, equal: list[str], swapped: list[tuple[str, str]]) -> DataFrame:
    """(row_id, partners): rows that agree in `equal` and hold each other's values in the swapped pairs, nulls equal."""
    a, b = df.alias("a"), df.alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in equal])
    for x, y in swapped:
        cond &= F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}")) & F.col(f"a.{y}").eqNullSafe(F.col(f"b.{x}"))
    pairs = a.join(b, cond & (F.col(f"a.{row_id}") != F.col(f"b.{row_id}")))
    return pairs.groupBy(F.col(f"a.{row_id}").alias(row_id)).agg(F.sort_array(F.collect_set(F.col(f"b.{row_id}"))).alias("partners"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in order of a seeded hash of the key."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    return df.filter(seeded(F.col(key), seed) < int(fraction * 2**32))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float, seed: int) -> DataFrame:
    """Adds `split`: of each label's rows, in order of a seeded hash, round(share * rows) are test, the others train.

    A label may hold any share of the rows: they are counted by label and leading bits of the hash, and only the one
    bucket of each label in which the test rows end is sorted. Rows of equal hash and key are split by nothing and
    stay together in arbitrary order. A null label is a label of its own.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(label).alias("label"), F.col(key).alias("key"), seeded(F.col(key), seed).alias("h"))
    rows = rows.withColumn("bucket", F.shiftright("h", SPLIT_BITS))
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("want", F.floor(F.sum("n").over(w) * test_share + 0.5))
    edges = counts.filter("upto - n < want and upto >= want").select("label", F.col("bucket").alias("edge"), (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
    # At most a row a label; labels are joined null-safe.
    edges = edges.select(F.col("label").alias("_label"), "edge", "left")
    marked = rows.join(edges, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    inside = F.col("bucket") == F.col("edge")
    rank = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h", "key"))
    near = marked.filter(inside).withColumn("split", F.when(rank <= F.col("left"), "test").otherwise("train"))
    far = marked.filter(~F.coalesce(inside, F.lit(False))).withColumn("split", F.when(F.col("bucket") < F.col("edge"), "test").otherwise("train"))
    return near.select("row.*", "split").unionByName(far.select("row.*", "split"))


def median_label(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 where the column is at its median or above."""
    median = df.agg(F.percentile(column, 0.5)).scalar()
    return df.withColumn(out, (F.col(column) >= median).cast("int"))


def quantile_label(df: DataFrame, column: str, out: str, bins: int) -> DataFrame:
    return df.withColumn(out, bin_of(F.col(column), quantile_edges(df, column, bins)))


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the most frequent value, ties to the least."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(1)


def conditional_update(df: DataFrame, updates: list[tuple[str, Column, Column]]) -> DataFrame:
    """Statements UPDATE SET column = value WHERE condition, one after the other; an unknown condition changes nothing."""
    for column, condition, value in updates:
        df = df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))
    return df


def surrogate_ids(df: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """Whole numbers in order of columns, nulls last; a sort over all partitions, no single one holds the table."""
    return numbered(df, [F.col(c).asc_nulls_last() for c in order], out, first)
