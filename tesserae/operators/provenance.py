"""Provenance: which entities a coalition's values single out, and what else is then known."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import canonical
from tesserae.operators.coalitions import closed
from tesserae.operators.refine import Closure

Rule = tuple[tuple[str, ...], tuple[str, ...]]  # determining features, features that follow


def id_rules(rules: list[tuple[tuple[str, ...], str]], id_cols: list[str]) -> dict[str, list[str]]:
    """For each id column what it determines, by rules that follow from each other too."""
    close = Closure(rules)
    return {i: sorted(set(close((i,))) - set(id_cols)) for i in id_cols}


def pair_id(rows: DataFrame, columns: list[str], out: str = "pair_id") -> DataFrame:
    """rows with an id made of two columns, null if either is."""
    return rows.withColumn(out, F.when(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull(), F.struct(*columns)))


def candidate_counts(rows: DataFrame, id_col: str, asked: DataFrame, features: list[str], bits: list[int], max_masks: int = 4096) -> DataFrame:
    """(key, mask, n_candidates): how many ids have a row that holds all of the asked row's values in the mask, nulls equal.

    asked: key, mask and the features; bits: the mask's bit of each feature. The ids of equal values are counted once,
    before they meet the rows that ask; distinct masks, whose number is checked, are what the rows are repeated for.
    """
    known = sum(1 << b for b in bits)
    asked = asked.withColumn("_held", F.col("mask").bitwiseAND(F.lit(known).cast("long"))).filter("_held <> 0")
    masks = asked.select("_held").distinct()
    if masks.limit(max_masks + 1).count() > max_masks:
        raise ValueError(f"more than {max_masks} masks")
    seen = F.struct(*[F.when(F.col("_held").bitwiseAND(F.lit(1 << b)) != 0, F.struct(F.col(f))).alias(f) for f, b in zip(features, bits, strict=True)])
    held = rows.select(F.col(id_col).alias("_id"), *features).filter("_id is not null").join(F.broadcast(masks), F.lit(True), "inner")
    counts = held.groupBy("_held", seen.alias("_v")).agg(F.count_distinct("_id").alias("n_candidates"))
    return asked.select("key", "mask", "_held", seen.alias("_v")).join(counts, ["_held", "_v"]).select("key", "mask", "n_candidates")


def canon_by_provenance(explained: DataFrame, key: str, rows: DataFrame, id_col: str, features: list[str], follow: list[Rule], closure: list[tuple[int, int]] = (), threshold: int = 1, again: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A function from masks (key, mask) to (key, mask, canon): the closure, and where the values in it single out
    between one and `threshold` ids of rows, what follows (rules `follow` of feature names) as well, closed again.

    rows: the id and those of the features that entities hold. again: a second look with exactly one candidate.
    """
    held = [f for f in features if f in rows.columns]
    bits = [features.index(f) for f in held]
    known = explained.select(F.col(key).alias("key"), *held)

    def widened(masks: DataFrame, limit: int) -> DataFrame:  # (key, raw, mask)
        asked = masks.select("key", "mask").distinct().join(known, "key")
        n = candidate_counts(rows, id_col, asked, held, bits)
        more = F.lit(0).cast("long")
        for lhs, rhs in follow:
            need, gain = sum(1 << features.index(f) for f in lhs), sum(1 << features.index(f) for f in rhs if f in features)
            more = more.bitwiseOR(F.when(F.col("mask").bitwiseAND(F.lit(need).cast("long")) == need, F.lit(gain)).otherwise(0).cast("long"))
        few = F.coalesce((F.col("n_candidates") >= 1) & (F.col("n_candidates") <= limit), F.lit(False))
        out = masks.join(n, ["key", "mask"], "left")
        wide = F.when(few, F.col("mask").bitwiseOR(more)).otherwise(F.col("mask"))
        return out.select("key", "raw", closed(wide, list(closure)).alias("mask"))

    def canon(masks: DataFrame) -> DataFrame:
        start = masks.select(F.col(key).alias("key"), F.col("mask").cast("long").alias("raw")).distinct()
        out = widened(start.withColumn("mask", closed(F.col("raw"), list(closure))), threshold)
        out = widened(out, 1) if again else out
        return out.select(F.col("key").alias(key), F.col("raw").alias("mask"), F.col("mask").alias("canon"))

    return canon


def inverted_index(rows: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """(id, feature, value): distinct, values in canonical text, nulls included as null."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), canonical(F.col(f).cast("string")).alias("value")) for f in features])
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(items).alias("x")).select("id", "x.*").distinct()


def candidates(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, id): ids that hold all asked values. asked: (key, feature, value)."""
    need = asked.groupBy("key").agg(F.count("*").alias("n"))
    a, b = asked.alias("a"), index.alias("b")
    hits = a.join(b, (F.col("a.feature") == F.col("b.feature")) & F.col("a.value").eqNullSafe(F.col("b.value")))
    found = hits.groupBy("a.key", "b.id").agg(F.count("*").alias("m"))
    return found.join(need, "key").filter("m = n").select("key", "id")


def entity_candidates(rows: DataFrame, id_col: str, asked: DataFrame, features: list[str], max_masks: int = 4096) -> DataFrame:
    """(key, id) by whole rows: ids with a row that holds all the values in the mask at once, nulls equal.

    asked: key, mask and the features. Distinct masks, whose number is checked, are what the rows are repeated for.
    """
    masks = asked.select("mask").distinct()
    if masks.limit(max_masks + 1).count() > max_masks:
        raise ValueError(f"more than {max_masks} masks")
    seen = F.struct(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.col(f))).alias(f) for i, f in enumerate(features)])
    held = rows.select(F.col(id_col).alias("id"), *features).filter("id is not null").join(F.broadcast(masks), F.lit(True), "inner")
    a, b = asked.select("key", "mask", seen.alias("v")), held.select("id", "mask", seen.alias("v"))
    return a.join(b, ["mask", "v"]).select("key", "id").distinct()


def constant_values(index: DataFrame, found: DataFrame, rhs: list[str]) -> DataFrame:
    """(key, feature, n_ids): features of which all candidates of a key agree."""
    held = found.join(index.filter(F.col("feature").isin(rhs)), "id")
    agg = held.groupBy("key", "feature").agg(F.count_distinct(F.struct("value")).alias("d"), F.count_distinct("id").alias("n_ids"))
    return agg.filter("d = 1").select("key", "feature", "n_ids")


def expand(masks: DataFrame, found: DataFrame, index: DataFrame, features: list[str], rules: list[Rule], threshold: int = 1, weak: bool = False) -> DataFrame:
    """masks (key, mask) with n_candidates and expanded: between one and `threshold` candidates turn on what follows
    from features in the mask; if weak, more candidates do so for features on which they all agree."""
    place = {f: 1 << i for i, f in enumerate(features)}
    n = found.groupBy("key").agg(F.count_distinct("id").alias("n_candidates"))
    out = masks.join(n, "key", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    few = (F.col("n_candidates") >= 1) & (F.col("n_candidates") <= threshold)
    follow = F.lit(0).cast("long")
    for lhs, rhs in rules:
        need, gain = sum(place[f] for f in lhs), sum(place[f] for f in rhs if f in place)
        follow = follow.bitwiseOR(F.when(F.col("mask").bitwiseAND(F.lit(need)) == need, F.lit(gain)).otherwise(0).cast("long"))
    out = out.withColumn("expanded", F.when(few, F.col("mask").bitwiseOR(follow)).otherwise(F.col("mask")))
    if weak:
        targets = sorted({f for _, rhs in rules for f in rhs if f in place})
        bit = reduce(lambda a, f: F.when(F.col("feature") == f, F.lit(place[f])).otherwise(a), targets, F.lit(0)).cast("long")
        agreed = constant_values(index, found, targets).groupBy("key").agg(F.bit_or(bit).alias("agreed"))
        more = F.when(F.col("n_candidates") > threshold, F.col("agreed").bitwiseAND(follow)).otherwise(F.lit(0).cast("long"))
        out = out.join(agreed, "key", "left").withColumn("expanded", F.col("expanded").bitwiseOR(F.coalesce(more, F.lit(0).cast("long")))).drop("agreed")
    return out


def expand_again(masks: DataFrame, found_by: Callable[[DataFrame], DataFrame], index: DataFrame, features: list[str], rules: list[Rule], threshold: int = 1) -> DataFrame:
    """expand(), and once more with exactly one candidate for what the wider coalition singles out. found_by gives the
    candidates (key, id) of masks (key, mask)."""
    first = expand(masks, found_by(masks), index, features, rules, threshold).select("key", F.col("expanded").alias("mask"))
    return expand(first, found_by(first), index, features, rules, 1)


def group_map(rows: DataFrame, key_cols: list[str], id_col: str) -> DataFrame:
    """(key_cols, ids): the distinct ids of each combination of values; null is a value."""
    return rows.groupBy(*key_cols).agg(F.sort_array(F.collect_set(id_col)).alias("ids"))


def intersect_ids(parts: list[DataFrame]) -> DataFrame:
    """(key, row_id) that every id column's candidates share; each part is (key, row_id)."""
    every = reduce(DataFrame.unionByName, [p.distinct().withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return every.groupBy("key", "row_id").agg(F.count_distinct("_part").alias("m")).filter(F.col("m") == len(parts)).select("key", "row_id")
