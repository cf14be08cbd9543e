"""Merging of mined dependencies and constraints, and closures under them."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[tuple[str, ...], str]


def merge_fds(frames: list[DataFrame], max_error: float = 0.0) -> DataFrame:
    """Dependencies (lhs, rhs, source, kind, approx_error) of all sources up to an error, each pair once: the least
    error and then the first source and kind in order stay."""
    every = reduce(DataFrame.unionByName, frames).withColumn("lhs", F.array_sort(F.array_distinct("lhs"))).filter(F.col("approx_error") <= max_error)
    best = F.min(F.struct("approx_error", "source", "kind")).alias("b")
    return every.filter(~F.array_contains("lhs", F.col("rhs"))).groupBy("lhs", "rhs").agg(best).select("lhs", "rhs", "b.source", "b.kind", "b.approx_error")


def drop_columns(fds: DataFrame, columns: list[str], keep_for_provenance: bool = False) -> DataFrame:
    """Without dependencies that touch the label or dropped columns; provenance still needs those from them."""
    low = [c.lower() for c in columns]
    touch = F.arrays_overlap(F.transform("lhs", lambda x: F.lower(x)), F.array(*map(F.lit, low))) if low else F.lit(False)
    right = F.lower("rhs").isin(low) if low else F.lit(False)
    return fds.filter(~right if keep_for_provenance else ~(touch | right))


def check_single_rhs(fds: DataFrame) -> DataFrame:
    if not fds.filter(F.col("rhs").contains(",")).isEmpty():
        raise ValueError("a right side names several columns; split them first")
    return fds


class Closure:
    """Attribute closures in time linear in the rules: each rule counts the columns of its left side still missing."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = sorted({(tuple(sorted(set(lhs))), rhs) for lhs, rhs in rules})
        self.uses: dict[str, list[int]] = defaultdict(list)
        for i, (lhs, _) in enumerate(self.rules):
            for c in lhs:
                self.uses[c].append(i)
        self.memo: dict[tuple[str, ...], tuple[str, ...]] = {}

    def __call__(self, seed: Iterable[str]) -> tuple[str, ...]:
        key = tuple(sorted(set(seed)))
        if key not in self.memo:
            self.memo[key] = tuple(sorted(self.reasons(key)))
        return self.memo[key]

    def reasons(self, seed: Iterable[str]) -> dict[str, Rule | None]:
        """Columns of the closure and the rule that added each; None for the seed."""
        missing = [len(lhs) for lhs, _ in self.rules]
        why: dict[str, Rule | None] = dict.fromkeys(seed)
        todo = deque(why)
        while todo:
            for i in self.uses[todo.popleft()]:
                missing[i] -= 1
                rhs = self.rules[i][1]
                if missing[i] == 0 and rhs not in why:
                    why[rhs] = self.rules[i]
                    todo.append(rhs)
        return why

    def seeds(self) -> list[tuple[str, ...]]:
        """Every single column and every left side."""
        single = {(c,) for lhs, rhs in self.rules for c in (*lhs, rhs)}
        return sorted(single | {lhs for lhs, _ in self.rules})


def closure_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(seed, closure) for all seeds."""
    c = Closure(rules)
    return spark.createDataFrame([(list(s), list(c(s))) for s in c.seeds()], "seed array<string>, closure array<string>")


def rules_of(fds: DataFrame) -> list[Rule]:
    """Rules on the driver: as many as were mined, not as many as rows."""
    return [(tuple(r["lhs"]), r["rhs"]) for r in fds.select("lhs", "rhs").distinct().collect()]


def merge_atoms(frames: list[DataFrame]) -> DataFrame:
    """Domain atoms of all sources; a constraint is told by source and number. Equal atoms of a source occur once."""
    return reduce(DataFrame.unionByName, frames).dropDuplicates(["source", "cid", "group_id", "lhs", "op", "value", "rhs", "domain_op", "domain_value"])


def unified(fds: DataFrame, atoms: DataFrame, denials: DataFrame | None = None) -> DataFrame:
    """Everything as (constraint_type, lhs, rhs, raw)."""
    raw = lambda d: F.to_json(F.struct(*d.columns))
    parts = [fds.select(F.when(F.col("approx_error") > 0, "approx_fd").otherwise("fd").alias("constraint_type"), F.array_join("lhs", ",").alias("lhs"), "rhs", raw(fds).alias("raw"))]
    parts.append(atoms.select(F.lit("domain").alias("constraint_type"), "lhs", "rhs", raw(atoms).alias("raw")))
    if denials is not None:
        parts.append(denials.select(F.lit("denial").alias("constraint_type"), F.col("cols").alias("lhs"), F.lit(None).cast("string").alias("rhs"), raw(denials).alias("raw")))
    return reduce(DataFrame.unionByName, parts)
