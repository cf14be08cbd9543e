"""The whole way from a flat table and its declared structure to explained rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import attribution as A
from tesserae.operators import coalitions as C
from tesserae.operators import data_constraints as D
from tesserae.operators import integrity as I
from tesserae.operators import provenance as P
from tesserae.operators import refine as X
from tesserae.operators import schema_constraints as S
from tesserae.operators.relational import seeded_sample, stratified_split
from tesserae.plans.lineage import Lineage
from tesserae.sources.catalog import Catalog
from tesserae.sources.config import Config


@dataclass
class Constraints:
    fds: DataFrame
    atoms: DataFrame
    denials: list[dict] = field(default_factory=list)

    def rules(self) -> list[X.Rule]:
        return X.rules_of(self.fds)

    def checks(self) -> list[I.Rule]:
        return I.load_rules([tuple(r) for r in self.atoms.collect()])  # as many as were mined, not as rows


def discovery_frame(df: DataFrame, config: Config, mode: str = "train", key: str | None = None) -> DataFrame:
    """What is mined: "full" leaves out the label; "train" also the dropped columns and the test rows, told by `key`.
    SAMPLE_N rows of it in seeded order if configured."""
    label = config.label_col[0] if config.label_col else None
    out = df
    if mode == "train" and label and key:
        out = stratified_split(out, key, label, 0.2, config.sample_random_seed).filter("split = 'train'").drop("split")
    if config.sample_n and key:
        out = seeded_sample(out, key, config.sample_n, config.sample_random_seed)
    return out.drop(*config.label_col, *(config.drop_cols if mode == "train" else []))


def mine(df: DataFrame, config: Config, catalog: Catalog | None = None, sql: str | None = None, excluded: set[tuple[str, str]] = frozenset(), max_error: float = 0.0) -> Constraints:
    """Constraints of declared structure, query text and data, merged."""
    spark = df.sparkSession
    exact, near = D.discover_fds(df, config.max_lhs_size, config.fd_eps, excluded)
    frames = [spark.createDataFrame([(list(d.lhs), d.rhs, "data", "approximate" if d.bad_groups else "exact", d.error) for d in exact + near], S.FD_SCHEMA)]
    atoms = [spark.createDataFrame(D.domain_atoms(df, exact, config), S.ATOM_SCHEMA)]
    if catalog:
        frames.append(S.schema_fd_frame(spark, catalog).filter("kind <> 'unique_nullable'"))
        atoms.append(S.check_atom_frame(spark, catalog))
    if sql:
        found = Lineage(spark, sql, catalog)
        frames.append(spark.createDataFrame([(list(a), r, "query", k, 0.0) for a, r, k in found.exported()], S.FD_SCHEMA))
        atoms.append(spark.createDataFrame(found.conditional_domains(), S.ATOM_SCHEMA))
    cycles = D.full_cycles([(d.lhs, d.rhs) for d in exact])
    fds = X.drop_columns(X.merge_fds(frames, max_error), config.label_col)
    return Constraints(fds, X.merge_atoms(atoms), D.integrity(df, cycles))


def explain(explained: DataFrame, key: str, background: DataFrame, features: list[str], score: A.Scorer, constraints: Constraints | None = None, estimator: str = "monte_carlo", samples: int = 100, seed: int = 0, repair: bool = False, max_classes: int | None = None, max_skips: int | None = None, entities: DataFrame | None = None, id_cols: list[str] = (), threshold: int = 1, again: bool = True) -> DataFrame:
    """(key, feature, phi): "exact", "monte_carlo", "leverage" or "kernel" attributions, closed under the dependencies
    among the features and, if asked, with mixed rows repaired by the checks.

    max_skips: budget mode of the estimators. entities: provenance, rows of id columns and the features they come with;
    a coalition whose values single out at most `threshold` ids, by an id column, is widened by what the constraints
    say follows from it, and looked at once more if again. With two id columns their pair is an id as well.
    """
    rules = constraints.rules() if constraints else []
    closure = C.rule_masks(rules, features)
    checks = constraints.checks() if constraints and repair else None
    canon = None
    if entities is not None and id_cols:
        known = P.id_rules(rules, list(id_cols))
        if len(id_cols) == 2:
            entities = P.pair_id(entities, list(id_cols))
            known["pair_id"] = sorted(set(X.Closure(rules)(id_cols)) - set(id_cols))
        steps = []
        for i, told in known.items():
            held = [f for f in features if f in told]
            if held:  # each of what an id comes with, once it is singled out, tells the others
                follow = [((f,), tuple(g for g in held if g != f)) for f in held]
                steps.append(P.canon_by_provenance(explained, key, entities.select(i, *held), i, features, follow, closure, threshold, again))
        if steps:
            canon = _chain(steps, key)
    if estimator == "exact":
        return A.exact(explained, key, background, features, score, closure, checks, canon)
    if estimator == "monte_carlo":
        return A.monte_carlo(explained, key, background, features, score, samples, seed, closure, max_classes=max_classes, repair=checks, canon=canon, max_skips=max_skips)
    if estimator in ("leverage", "kernel"):
        return A.regression(explained, key, background, features, score, samples, seed, estimator, closure, checks, canon, max_skips)
    raise ValueError(f"no estimator {estimator}")


def _chain(steps: list[A.Canon], key: str) -> A.Canon:
    """One after the other: each step widens what the one before made of a coalition."""

    def canon(masks: DataFrame) -> DataFrame:
        out = steps[0](masks)
        for step in steps[1:]:
            wider = step(out.select(key, F.col("canon").alias("mask"))).withColumnsRenamed({"mask": "canon", "canon": "_wider"})
            out = out.join(wider, [key, "canon"]).select(key, "mask", F.col("_wider").alias("canon"))
        return out

    return canon


def samples(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return seeded_sample(df, key, n, seed)


def ship(spark: SparkSession, constraints: Constraints, path: str) -> None:
    """Merged constraints as one long table and their closures as another."""
    X.unified(constraints.fds, constraints.atoms).withColumn("written", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/constraints")
    X.closure_frame(spark, constraints.rules()).write.mode("overwrite").parquet(f"{path}/closures")
