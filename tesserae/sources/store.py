"""Intermediate tables in the shared folder, and row numbers that need them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() counts a partition's rows in so many bits.
_PLACE_BITS = 33


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and read it from there: its lineage ends.

    Where a session in one process (tests, a laptop) names no folder, a temporary one is set; on a cluster, whose
    machines would not share it, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], out: str, first: int = 1) -> DataFrame:
    """df with whole numbers in the given order in column `out`: a sort over all partitions, whose rows are numbered by
    their partition's offset and their place in it. What one task adds up is a row a partition."""
    place = "_place" + "_" * max([len(c) for c in df.columns], default=0)
    rows = checkpointed(df.sort(*order).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, _PLACE_BITS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("part")).count()
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    named = offsets.select(F.col("part").alias(f"{place}p"), F.col("offset").alias(f"{place}o"))
    joined = rows.withColumn(f"{place}p", part).join(F.broadcast(named), f"{place}p")
    number = F.col(f"{place}o") + F.col(place).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + first
    return joined.select(number.alias(out), *[F.col(f"`{c}`") for c in df.columns if c != out])
