"""Mixing sources to target weights with hash thresholds.

Each row gets a hash; a source keeps the rows below a threshold. Sizes are summed by source and leading hash
bits, the budget falls into one boundary bucket, and only that bucket's rows are summed again by their next bits,
until it holds a single hash. The sums are a few thousand rows a source whatever the input; no row is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_small, n_words

#: Bits of a row's hash, and bits that one level of the histogram takes.
HASH_BITS, LEVEL_BITS = 60, 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(_skey, source_size, target) for a table (_skey, source, source_size) with a row for each source.

    Sources in code point order, null last, weigh `weights` in turn and share the whole size; a target stops at
    max_repeats times its source's size and the rest is shared again by weight. That ends at
    target = min(cap, level * weight) for one level, found from running sums in order of cap / weight. The table of
    sources, a row each, is sorted in one task; documents never go there.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = one.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    w = w.withColumn("level", level)
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(one)["level"])
    return w.select("_skey", "source_size", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _row_columns(id_col: str, source_col: str, text_col: str) -> dict:
    """What a row contributes, by name: its source's key (never null), size and hash."""
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    size = n_words(F.col(text_col))
    seed = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), key, size.cast("string"))
    return {"_skey": key, "_size": size, "_h": F.conv(F.substring(F.md5(seed), 1, HASH_BITS // 4), 16, 10).cast("long")}


def thresholds(rows: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(_skey, source_size, target, whole, threshold) for rows (_skey, _size, _h, source): a row is taken `whole`
    times, and once more if its hash is below the threshold."""
    sizes = rows.groupBy("_skey").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    plan = targets(sizes, weights, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = checkpointed(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    # Level by level: the bucket in which a source's budget runs out, then that bucket alone.
    inside, shift = rows.select("_skey", "_size", "_h"), HASH_BITS
    steps = plan.select("_skey", "rest")
    while shift > 0:
        shift -= LEVEL_BITS
        bucket = F.shiftright("_h", shift)
        sums = inside.groupBy("_skey", bucket.alias("bucket")).agg(F.sum("_size").alias("size"), F.min("_h").alias("least"), F.max("_h").alias("most"))
        sums = join_small(sums, steps.select("_skey", "rest"), "_skey", F.col("bucket"), "inner")
        upto = Window.partitionBy("_skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("cum", F.sum("size").over(upto)).filter(F.col("cum") > F.col("rest"))
        edge = F.min(F.struct("bucket", "cum", "size", "least", "most", "rest"))
        steps = sums.groupBy("_skey").agg(edge.alias("e")).select("_skey", F.col("e.bucket").alias("prefix"), (F.col("e.rest") - F.col("e.cum") + F.col("e.size")).alias("rest"), "e.size", "e.least", "e.most")
        steps = checkpointed(steps)
        if shift == 0 or steps.filter("least < most").isEmpty():
            break
        inside = join_small(inside, steps.select("_skey", "prefix"), "_skey", F.col("_h"), "inner").filter(bucket == F.col("prefix")).drop("prefix")
    # The boundary bucket now holds one hash: rows below it are taken, its own if that comes nearer.
    nearer = F.col("size") - F.col("rest") < F.col("rest")
    edges = steps.select("_skey", (F.col("least") + nearer.cast("long")).alias("threshold"))
    return checkpointed(plan.select("_skey", "source_size", "target", "whole").join(edges, "_skey", "left"))


def _repeats(whole: Column, threshold: Column) -> Column:
    return whole + F.coalesce((F.col("_h") < threshold).cast("long"), F.lit(0))


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(id, size, source_size, target, repeats, taken): how many times each row is taken.

    A row is taken floor(target / source_size) times, and once more if its hash is below its source's threshold.
    The hash is of id, source and size, so reruns agree. The boundary row is taken if that brings the sum nearer.
    Null text and text without words have size 0 and are taken 0 words; a null source is a source of its own,
    last; null ids and repeated rows are rows like others, of which equal ones share a hash and so a decision;
    an empty table gives an empty result. Other columns, whatever their names, are left out.
    """
    own = [c.alias(k) for k, c in _row_columns(id_col, source_col, text_col).items()]
    rows = checkpointed(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *own))
    out = join_small(rows, thresholds(rows, weights, max_repeats), "_skey", F.col("_h"), "inner")
    out = out.withColumn("repeats", _repeats(F.col("whole"), F.col("threshold")))
    return out.select(F.col("id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "repeats", (F.col("_size") * F.col("repeats")).alias("taken"))


def apply_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The rows of df as often as mix_sources() takes them, with df's columns, whatever their names; copies keep their
    id."""
    own = [c.alias(k) for k, c in _row_columns(id_col, source_col, text_col).items()]
    rows = checkpointed(df.select(*own, F.col(source_col).cast("string").alias("source")))
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *own)
    plan = thresholds(rows, weights, max_repeats).select("_skey", F.struct("whole", "threshold").alias("_plan"))
    out = join_small(marked, plan, "_skey", F.col("_h"), "inner")
    out = out.withColumn("_n", _repeats(F.col("_plan")["whole"], F.col("_plan")["threshold"]).cast("int")).filter("_n > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def op6_mix(spark, sf_dir):
    from .common import documents

    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), r AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), skey, CAST(size AS VARCHAR))), 1, 15) AS BIGINT) AS h FROM d
), s AS (
  SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY skey
), w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT skey, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0) * w) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.skey ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum,
         sum(r.size) OVER (PARTITION BY r.skey, h) AS own
  FROM r JOIN p USING (skey)
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND (cum <= rest OR (cum - own <= rest AND cum - rest < rest - (cum - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
