"""Models and their scores: preparation, training, tuning and metrics."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import seeded
from tesserae.operators.relational import SPLIT_BITS
from tesserae.sources.store import numbered

#: Scores of a block in whose order running sums are made by one task: 2 ** 16.
BLOCK_BITS = 16
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def preparation(df: DataFrame, label: str) -> list:
    """Stages to `features`: medians for missing numbers, all standardised; missing text is a value of its own, one-hot,
    and values unseen in training are none of them."""
    numbers = [c for c, t in df.dtypes if c != label and t in NUMERIC]
    texts = [c for c, t in df.dtypes if c != label and t in ("string", "boolean")]
    stages, parts = [], []
    if numbers:
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=[f"_i_{c}" for c in numbers]), VectorAssembler(inputCols=[f"_i_{c}" for c in numbers], outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_std", withMean=True)]
        parts.append("_std")
    if texts:
        stages += [StringIndexer(inputCols=texts, outputCols=[f"_x_{c}" for c in texts], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"_x_{c}" for c in texts], outputCols=[f"_h_{c}" for c in texts], dropLast=True)]
        parts += [f"_h_{c}" for c in texts]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def classifier(name: str, label: str, **options):
    kinds = {"logreg": LogisticRegression, "random_forest": RandomForestClassifier, "gbdt": GBTClassifier, "svm": LinearSVC, "mlp": MultilayerPerceptronClassifier}
    return kinds[name](labelCol=label, featuresCol="features", **options)


def train(df: DataFrame, label: str, name: str = "logreg", **options) -> PipelineModel:
    """Pipeline of preparation and classifier. For "mlp", layers=[...] without the first, which is the feature count."""
    if name == "mlp":
        stages = Pipeline(stages=preparation(df, label)).fit(df)
        size = len(stages.transform(df.limit(1)).first()["features"])
        model = classifier(name, label, **options | {"layers": [size, *options.get("layers", [8, 2])]}).fit(stages.transform(df))
        return PipelineModel([*stages.stages, model])
    return Pipeline(stages=[*preparation(df, label), classifier(name, label, **options)]).fit(df)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df and `proba`, the chance of class 1; for margins their logistic."""
    out = model.transform(df)
    own = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(*df.columns, own.alias("proba"), F.col("prediction").cast("int").alias("prediction"))


#: Labels at most; their codes are sent to every task.
MAX_LABELS = 10_000


def encode_label(df: DataFrame, label: str) -> DataFrame:
    """Label as codes from 0 by order of value; null stays null. There are at most MAX_LABELS, which is checked."""
    values = df.select(label).filter(F.col(label).isNotNull()).distinct()
    if values.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    codes = values.withColumn("_code", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(codes), label, "left").drop(label).withColumnRenamed("_code", label)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall (the rate of true positives), fpr, f1; null where undefined."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.agg(F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"), F.count(F.when(y & ~p, 1)).alias("fn"), F.count(F.when(~y & ~p, 1)).alias("tn"))
    part = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    return c.select("*", part("tp + tn", "tp + fp + fn + tn").alias("accuracy"), part("tp", "tp + fp").alias("precision"), part("tp", "tp + fn").alias("recall"), part("fp", "fp + tn").alias("fpr"), part("2 * tp", "2 * tp + fp + fn").alias("f1"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve: the chance that a positive outranks a negative, ties half. Counts are summed by score
    first; the distinct scores, which may be as many as the rows, are numbered over all partitions, and running sums
    are those of a block of numbers after those of the blocks before."""
    per = df.groupBy(F.col(score).alias("score")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    per = numbered(per, [F.col("score")], "number", 0).withColumn("block", F.shiftright("number", BLOCK_BITS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("block").agg(F.sum("neg").alias("neg"))
    blocks = blocks.select("block", F.coalesce(F.sum("neg").over(before(Window.orderBy("block"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("neg").over(before(Window.partitionBy("block").orderBy("number"))), F.lit(0))
    less = per.withColumn("inside", inside).join(blocks, "block").withColumn("less", F.col("base") + F.col("inside"))
    wins = F.sum(F.col("pos") * (2 * F.col("less") + F.col("neg")))
    return less.agg(F.try_divide(wins.cast("double"), (2 * F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Adds fold: each label's rows dealt in turn in order of a seeded hash. They are numbered within label and leading
    bits of the hash, after the rows of the buckets before, so that a label is no one task's."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(label).alias("label"), F.col(key).alias("key"), seeded(F.col(key), seed).alias("h"))
    rows = rows.withColumn("bucket", F.shiftright("h", SPLIT_BITS))
    upto = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("label").alias("_label"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h", "key")) - 1
    out = rows.withColumn("place", place).join(counts, F.col("label").eqNullSafe(F.col("_label")) & (F.col("bucket") == F.col("_bucket")))
    return out.select("row.*", ((F.col("base") + F.col("place")) % k).cast("int").alias("fold"))


def search(df: DataFrame, key: str, label: str, fit: Callable[..., PipelineModel], grid: dict[str, list], tries: int = 10, k: int = 2, seed: int = 0) -> list[tuple[float, dict]]:
    """Mean AUC over stratified folds of up to `tries` settings of the grid, chosen by seed, best first."""
    import random

    every = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    chosen = random.Random(seed).sample(every, min(tries, len(every)))
    dealt, out = folds(df, key, label, k, seed).cache(), []
    for options in chosen:
        total = 0.0
        for i in range(k):
            model = fit(dealt.filter(F.col("fold") != i).drop("fold", key), label, **options)
            total += BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(dealt.filter(F.col("fold") == i).drop("fold", key)))
        out.append((total / k, options))
    dealt.unpersist()
    return sorted(out, key=lambda x: -x[0])
