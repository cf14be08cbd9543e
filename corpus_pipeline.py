"""A training corpus from raw documents: STAGES in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed
from tesserae.llm.mixing import apply_mix
from tesserae.llm.packing import pack_documents
from tesserae.llm.quality import keep_quality, train
from tesserae.llm.simhash import drop_near_duplicates
from tesserae.llm.suffix_dedup import remove_repeats


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes and more that start earlier in the corpus; n_chars is counted anew."""
    out = remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_dedup),
    ("repeats", repeat_removal),
    ("mix", source_mix),
    ("packing", packing),
]

#: Hashing, training and tokenizing can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir. What a stage returns is written to the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
