"""What the operators share: partition counts, row keys and joins with small tables."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.store import checkpointed, numbered

#: Word separators: space and U+0009 to U+000D, in Java and RE2 syntax.
WORD = r"[^\x20\x09-\x0D]+"
#: A table with at most so many rows counts as small enough to broadcast; the count is checked each time.
BROADCAST_ROWS = 100_000
#: Rows of one key, in joins with a table that is not small, that are one task's work.
HOT_ROWS = 1 << 14


def remembered(name: str, make):
    """What make() returned when a worker first asked for the name; kept until that Python worker ends or is asked for
    another name, so that a worker never holds the memories of two operators."""
    kept = vars(sys).setdefault("_tesserae_kept", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def tidy(run: Callable, name: str | None = None) -> Callable:
    """run, a function from batches to batches, for a worker that lives on between tasks: at its start what is remembered
    under other names is dropped, at its end freed memory goes back to the machine, so that idle workers hold little."""

    def tidied(batches):
        kept = vars(sys).setdefault("_tesserae_kept", {})
        for other in [k for k in kept if k != name]:
            del kept[other]
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
            trim(0)

    return tidied


def sampled(key: Column, share: float) -> Column:
    """About a share of the rows, however small, by hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_small(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """Join a table with a smaller one by a non-null key of which one value may hold most rows of the big table.

    The small table is broadcast if it has at most BROADCAST_ROWS rows, which is counted. Else keys are counted, and
    the hot ones salted: `spread`, an integer of the big table's row, deals a hot key over as many values as it has
    times HOT_ROWS rows, for each of which the small table's row is repeated. A key is hot above HOT_ROWS rows, or, of
    very large tables, above that share of all rows that at most BROADCAST_ROWS keys can have; so the table of hot
    keys can be broadcast.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    counts = checkpointed(big.groupBy(key).agg(F.count("*").alias("_count")))
    total = counts.agg(F.sum("_count")).first()[0] or 0
    limit = max(HOT_ROWS, -(-total // max(1, BROADCAST_ROWS)))
    hot = checkpointed(counts.filter(F.col("_count") > limit).select(key, F.ceil(F.col("_count") / limit).cast("int").alias("_salts")))
    if hot.isEmpty():
        return big.join(small, key, how)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("_salts")
    salted = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")


def has_plain_ids(df: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers, none null and none twice."""
    if df.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return False
    odd = df.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
    return odd.isEmpty()


def with_row_ids(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """Columns (_rid, _id, _text, *carry) with a long _rid, never null, that tells rows apart and sorts as (id, nulls
    last, then text); and whether _rid is the id itself.

    Unique non-null whole-number ids are used as they are. Otherwise rows are sorted over all partitions and
    numbered; identical rows get neighbouring numbers. The carried columns come as one struct column _carry.
    """
    extra = [F.struct(*[F.col(c) for c in carry]).alias("_carry")] if carry else []
    df = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *extra)
    if has_plain_ids(df, "_id"):
        rid = F.coalesce(F.col("_id").cast("long"), F.lit(0)).alias("_rid")  # so that Spark knows it is never null
        return df.select(rid, *df.columns), True
    out = numbered(df, [F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_first()], "_rid", 0)
    return checkpointed(out.withColumn("_rid", F.coalesce("_rid", F.lit(0).cast("long")))), False
