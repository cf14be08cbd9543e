"""Writing of flat tables, constraints, closures, attributions and models. Paths may be any that Spark opens."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import read_fds


def write_flat(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").options(header=True, escape="\"").format(kind).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _stem(path: str) -> str:
    return path[:-4] if path.endswith(".csv") else path


def write_fds(fds: DataFrame, path: str) -> None:
    """CSV (lhs, rhs) in place of what is there, with the hand-written ones of <stem>_add.csv; each pair once."""
    spark, added = fds.sparkSession, f"{_stem(path)}_add.csv"
    out = fds.select("lhs", F.explode(F.split("rhs", ",")).alias("rhs")).withColumn("rhs", F.trim("rhs")).filter("rhs <> ''")
    if _exists(spark, added):
        out = out.unionByName(read_fds(spark, added))
    out = out.select(F.array_join(F.array_sort("lhs"), ",").alias("lhs"), "rhs").distinct()
    out.orderBy("lhs", "rhs").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_atoms(atoms: DataFrame, path: str) -> None:
    """CSV of domain atoms; atoms that differ in their number alone occur once."""
    flat = atoms.withColumn("domain_value", F.array_join("domain_value", "|"))
    content = [c for c in flat.columns if c != "cid"]
    w = Window.partitionBy(*content).orderBy("cid")
    once = flat.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    once.orderBy("source", "cid", "group_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_denials(spark: SparkSession, found: list[dict], path: str) -> None:
    """CSV (ic_id, kind, cols, k, parity_bit): one-hot sets as "onehot", parities of either kind as "xor"."""
    rows = [(i, "onehot" if r["kind"].startswith("onehot") else "xor", r["cols"], r["k"], r["parity_bit"]) for i, r in enumerate(found, 1)]
    frame = spark.createDataFrame(rows, "ic_id int, kind string, cols string, k int, parity_bit int")
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_closures(closures: DataFrame, path: str) -> None:
    """New (seed, closure) rows added to a Parquet table; seeds it has already are left out."""
    spark = closures.sparkSession
    if _exists(spark, path):
        closures = closures.join(spark.read.parquet(path).select("seed"), "seed", "left_anti")
    closures.write.mode("append").parquet(path)


def write_attributions(phi: DataFrame, path: str, settings: dict) -> None:
    """Long attributions as Parquet and the settings as one JSON file beside them."""
    phi.write.mode("overwrite").parquet(f"{path}/phi")
    phi.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def write_model(model: PipelineModel, path: str, predictions: DataFrame | None = None) -> None:
    """The model and, if given, the rows it scored in a table beside it."""
    model.write().overwrite().save(path)
    if predictions is not None:
        predictions.write.mode("overwrite").parquet(f"{path.rstrip('/')}_predictions")


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
