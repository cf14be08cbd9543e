"""Shapley-style attributions. A coalition's value is a row's mean score when the features outside the coalition come
from background rows; coalitions are closed under dependencies first, and only distinct ones are scored."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import coalitions as C
from tesserae.operators import integrity as I
from tesserae.sources.store import checkpointed

#: Background rows, and sampled coalitions, at most: they are sent to every task.
MAX_BACKGROUND, MAX_SAMPLES = 10_000, 1 << 20

Scorer = Callable[[dict[str, Column]], Column]


def linear_scorer(weights: dict[str, float], bias: float = 0.0, logistic: bool = False) -> Scorer:
    def score(x: dict[str, Column]) -> Column:
        s = F.lit(bias)
        for f, w in weights.items():
            s = s + x[f].cast("double") * w
        return 1 / (1 + F.exp(-s)) if logistic else s

    return score


def model_scorer(predict: Callable[[pd.DataFrame], np.ndarray]) -> Scorer:
    """Any model that scores frames; batches go through Arrow."""

    def score(x: dict[str, Column]) -> Column:
        names = list(x)

        @F.pandas_udf("double")
        def run(s: pd.DataFrame) -> pd.Series:
            return pd.Series(predict(s[names]))

        return run(F.struct(*[c.alias(n) for n, c in x.items()]))

    return score


def values(explain: DataFrame, key: str, masks: DataFrame, background: DataFrame, features: list[str], score: Scorer, rules: list[I.Rule] | None = None) -> DataFrame:
    """(key, mask, value) for masks (key, mask), each scored once; repeated ones count once.

    rules: mixed rows are repaired by them before scoring; features in the coalition keep the row's own values.
    """
    if background.limit(MAX_BACKGROUND + 1).count() > MAX_BACKGROUND:
        raise ValueError(f"more than {MAX_BACKGROUND} background rows")
    base = F.broadcast(background.select(*[F.col(f).alias(f"_z_{f}") for f in features]))
    rows = masks.select(key, "mask").distinct().join(explain.select(key, *[F.col(f).alias(f"_x_{f}") for f in features]), key)
    mixed = rows.join(base, F.lit(True), "inner")
    on = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(features))]
    mixed = mixed.withColumns({f: F.when(o, F.col(f"_x_{f}")).otherwise(F.col(f"_z_{f}")) for f, o in zip(features, on, strict=True)})
    if rules:
        mixed = I.repair(mixed, rules).withColumns({f: F.when(o, F.col(f"_x_{f}")).otherwise(F.col(f)) for f, o in zip(features, on, strict=True)})
    return mixed.withColumn("_score", score({f: F.col(f) for f in features})).groupBy(key, "mask").agg(F.avg("_score").alias("value"))


#: From masks (key, mask) to (key, mask, canon), where closures alone don't tell the canonical coalition.
Canon = Callable[[DataFrame], DataFrame]


def exact(explain: DataFrame, key: str, background: DataFrame, features: list[str], score: Scorer, closure: list[tuple[int, int]] = (), repair: list[I.Rule] | None = None, canon: Canon | None = None) -> DataFrame:
    """(key, feature, phi) over all coalitions of at most 24 features; values are those of the closures, or of what
    canon makes of each row's coalitions (see provenance)."""
    n = len(features)
    every = C.canonical(C.all_masks(explain.sparkSession, n), list(closure))
    per_row = explain.select(key).join(F.broadcast(every), F.lit(True), "inner")
    per_row = canon(per_row.select(key, "mask")) if canon else per_row
    v = values(explain, key, per_row.select(key, F.col("canon").alias("mask")), background, features, score, repair)
    v = per_row.join(v.withColumnRenamed("mask", "canon"), [key, "canon"])
    # phi_i = sum over S of v(S) times (|S|-1)! (n-|S|)! where i is in S, -|S|! (n-|S|-1)! where not, over n!.
    size = F.bit_count("mask").cast("int")
    plus = F.element_at(F.array(*[F.lit(float(math.factorial(max(s - 1, 0)) * math.factorial(n - s))) for s in range(n + 1)]), size + 1)
    minus = F.element_at(F.array(*[F.lit(float(math.factorial(s) * math.factorial(max(n - s - 1, 0)))) for s in range(n + 1)]), size + 1)
    aggs = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, plus).otherwise(-minus) * F.col("value")).alias(f"p{i}") for i in range(n)]
    wide = v.groupBy(key).agg(*aggs)
    return _long(wide, key, features, float(math.factorial(n)))


def _long(wide: DataFrame, key: str, features: list[str], divisor: float) -> DataFrame:
    items = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"p{i}") / divisor).alias("phi")) for i, f in enumerate(features)])
    return wide.select(key, F.explode(items).alias("x")).select(key, "x.*")


def matrix(phi: DataFrame, key: str, features: list[str]) -> DataFrame:
    return phi.groupBy(key).pivot("feature", features).agg(F.first("phi"))


def monte_carlo(explain: DataFrame, key: str, background: DataFrame, features: list[str], score: Scorer, n: int = 100, seed: int = 0, closure: list[tuple[int, int]] = (), scale: str = "shapley", max_classes: int | None = None, repair: list[I.Rule] | None = None, canon: Canon | None = None, max_skips: int | None = None) -> DataFrame:
    """(key, feature, phi) from n draws a row: the change of value when the pivot joins is shared by the features that
    it turns on. scale="shapley" estimates Shapley values; "mean" is the plain mean over draws, their n-th part of
    the number of features. max_classes keeps each row's draws within its first so many distinct coalitions.

    max_skips: budget mode. Only draws whose pair of coalitions is new to the row count; those that repeat one are
    drawn anew, until n count or max_skips were skipped. It is left out where n is half of all coalitions or more.
    canon: what makes a row's coalitions canonical instead of the closure alone (see provenance).
    """
    m, rules = len(features), list(closure)
    unique = max_skips is not None and n < 2 ** (m - 1)
    rows = explain.select(key).repartition(int(explain.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)  # one small file's draws are many tasks' work
    d = C.draws(rows, key, n + max_skips if unique else n, m, seed)
    if canon:
        every = canon(d.select(key, F.col("before").alias("mask")).union(d.select(key, F.col("after").alias("mask"))).distinct())
        for mask, s in (("before", "s0"), ("after", "s1")):
            d = d.join(every.select(key, F.col("mask").alias(mask), F.col("canon").alias(s)).hint("merge"), [key, mask])
    else:
        d = d.withColumn("s0", C.closed(F.col("before"), rules)).withColumn("s1", C.closed(F.col("after"), rules))
    if unique:
        d = C.first_draws(d, key, ["s0", "s1"], n)
    if max_classes is not None and max_classes < 2 ** (m - 1):
        seen = d.select(key, F.col("s0").alias("canon"), "draw").union(d.select(key, F.col("s1").alias("canon"), "draw"))
        kept = C.budget(seen, key, "draw", max_classes).select(key, "canon")
        for s in ("s0", "s1"):
            d = d.join(kept.withColumnRenamed("canon", s).hint("merge"), [key, s], "left_semi")
    # A row's draws are few distinct pairs of coalitions, each told once with its number. The tables here grow with
    # rows times draws, whatever the size of the file they come from: none is to be broadcast.
    pairs = checkpointed(d.groupBy(key, "s0", "s1").agg(F.count("*").alias("_c")))
    sides = pairs.withColumn("mask", F.explode(F.array("s0", "s1")))
    v = values(explain, key, sides, background, features, score, repair)
    side = lambda s: F.max(F.when(F.col("mask") == F.col(s), F.col("value")))
    d = sides.join(v.hint("merge"), [key, "mask"]).groupBy(key, "s0", "s1").agg(F.first("_c").alias("_c"), side("s0").alias("v0"), side("s1").alias("v1"))
    new = F.col("s1").bitwiseXOR(F.col("s0"))
    share = F.when(new != 0, (F.col("v1") - F.col("v0")) / F.bit_count(new) * F.col("_c")).otherwise(0.0)
    total = F.coalesce(F.sum(F.when(new != 0, F.col("_c"))), F.lit(0))
    aggs = [F.coalesce(F.sum(F.when(new.bitwiseAND(F.lit(1 << i)) != 0, share)), F.lit(0.0)).alias(f"p{i}") for i in range(m)]
    wide = d.groupBy(key).agg(total.alias("_n"), *aggs)
    factor = m if scale == "shapley" else 1
    wide = wide.withColumns({f"p{i}": F.when(F.col("_n") > 0, F.col(f"p{i}") * factor / F.col("_n")).otherwise(0.0) for i in range(m)})
    return _long(wide, key, features, 1.0)


def size_probabilities(n: int, samples: int) -> np.ndarray:
    """Chance that a coalition of each size 1 to n-1 is drawn: in proportion to the sizes' leverage, by water filling,
    so that no size gets more draws than it has coalitions."""
    counts = np.array([math.comb(n, s) for s in range(1, n)], "f8")
    chance, open_ = np.zeros(n - 1), np.ones(n - 1, bool)
    left = float(min(samples, counts.sum()))
    while open_.any() and left > 0:
        level = left / open_.sum()
        full = open_ & (counts <= level)
        if not full.any():
            chance[open_] = level / counts[open_]
            break
        chance[full] = 1.0
        left -= counts[full].sum()
        open_ &= ~full
    return np.minimum(chance, 1.0)


def sample_coalitions(n: int, samples: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(masks, chances) of distinct coalitions, each with its complement; all of them if there are no more."""
    if 2**n - 2 <= samples:
        masks = np.arange(1, 2**n - 1)
        return masks, np.ones(len(masks))
    rng, chance = np.random.default_rng(seed), size_probabilities(n, samples)
    full, out = (1 << n) - 1, {}
    for size in range(1, n // 2 + 1):
        want = int(round(chance[size - 1] * math.comb(n, size)))
        pair = 2 * size == n
        got = set()
        limit = math.comb(n, size)
        while len(got) < min(want if not pair else -(-want // 2) * 2, limit):
            m = sum(1 << int(i) for i in rng.choice(n, size, replace=False))
            got.add(m)
            if pair:
                got.add(full ^ m)
        for m in got:
            out[m] = out[full ^ m] = max(len(got) / limit, 1e-12)
    masks = np.array(sorted(out))
    return masks, np.array([out[m] for m in masks.tolist()])


def sample_classes(n: int, samples: int, seed: int, rules: list[tuple[int, int]], max_skips: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, chances) of sampled coalitions with distinct closures, the first of each class, as many as asked or as
    are found before so many were skipped."""
    want, size = samples, samples
    while True:
        masks, chance = sample_coalitions(n, size, seed)
        _, first = np.unique([C.close_mask(m, rules) for m in masks.tolist()], return_index=True)
        if len(first) >= want or len(masks) - len(first) >= max_skips or len(masks) >= 2**n - 2:
            keep = np.sort(first)[:want]
            return masks[keep], chance[keep]
        size *= 2


def regression(explain: DataFrame, key: str, background: DataFrame, features: list[str], score: Scorer, samples: int = 2048, seed: int = 0, kernel: str = "leverage", closure: list[tuple[int, int]] = (), repair: list[I.Rule] | None = None, canon: Canon | None = None, max_skips: int | None = None) -> DataFrame:
    """(key, feature, phi) by least squares over sampled coalitions, with the values of all and of none kept exactly.

    max_skips: budget mode. Of coalitions with the same closure one is kept, and more are sampled until there are as
    many classes as samples, or max_skips were skipped. canon: see monte_carlo().

    kernel: "leverage" weighs a coalition by 1 / (C(n, s) s (n - s)) over its chance of being drawn, "kernel" by
    (n - 1) / (C(n, s) s (n - s)). With all coalitions both give Shapley values. The solve is one small system a row.
    """
    n, rules = len(features), list(closure)
    if n == 1:
        return exact(explain, key, background, features, score, closure, repair)
    masks, chance = sample_coalitions(n, samples, seed) if max_skips is None else sample_classes(n, samples, seed, rules, max_skips)
    size = np.array([m.bit_count() for m in masks.tolist()])
    weight = 1 / (np.array([math.comb(n, s) for s in size.tolist()], "f8") * size * (n - size))
    weight = weight / chance if kernel == "leverage" else weight * (n - 1)
    spark, full = explain.sparkSession, (1 << n) - 1
    rows = [(int(m), float(w)) for m, w in zip(masks, weight, strict=True)] + [(0, 0.0), (full, 0.0)]
    drawn = C.canonical(spark.createDataFrame(rows, "mask long, weight double"), rules)
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} sampled coalitions")
    per_row = explain.select(key).join(F.broadcast(drawn), F.lit(True), "inner")
    if canon:
        per_row = per_row.drop("canon").join(canon(per_row.select(key, "mask")), [key, "mask"])
    v = values(explain, key, per_row.select(key, F.col("canon").alias("mask")), background, features, score, repair)
    v = per_row.join(v.withColumnRenamed("mask", "canon"), [key, "canon"])
    kind = explain.schema[key].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        mask = frame["mask"].to_numpy()
        y, w = frame["value"].to_numpy(), np.sqrt(frame["weight"].to_numpy())
        v0, v1 = y[mask == 0][0], y[mask == full][0]
        x = (mask[:, None] >> np.arange(n) & 1).astype("f8")
        centred = x - x.sum(axis=1, keepdims=True) / n  # what is left when the sum of phi is given
        target = y - v0 - x.sum(axis=1) * (v1 - v0) / n
        phi = np.linalg.lstsq(centred * w[:, None], target * w, rcond=None)[0] + (v1 - v0) / n
        phi += (v1 - v0 - phi.sum()) / n
        return pd.DataFrame({key: frame[key].iloc[0], "feature": features, "phi": phi})

    return v.groupBy(key).applyInPandas(solve, f"{key} {kind}, feature string, phi double")
