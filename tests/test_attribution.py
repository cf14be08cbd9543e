"""Coalitions, provenance, attributions and models."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import attribution as A
from tesserae.operators import coalitions as C
from tesserae.operators import integrity as I
from tesserae.operators import models as M
from tesserae.operators import provenance as P

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    make = lambda n, at: [(at + i, *map(int, rng.integers(0, 9, 4))) for i in range(n)]
    x, z = make(6, 0), make(8, 100)
    schema = "row_id long, a int, b int, c int, d int"
    return x, z, spark.createDataFrame(x, schema), spark.createDataFrame(z, schema)


def score(v):
    return (2 * v["a"] + v["b"] * v["c"] + F.when(v["d"] > 4, 3).otherwise(0) * v["a"]).cast("double")


def plain(a, b, c, d):
    return 2 * a + b * c + (3 if d > 4 else 0) * a


def value(x, z, mask):
    return np.mean([plain(*[x[i + 1] if mask >> i & 1 else r[i + 1] for i in range(4)]) for r in z])


def shapley(x, z, close=lambda m: m):
    phi = np.zeros(4)
    for order in itertools.permutations(range(4)):
        m = 0
        for i in order:
            phi[i] += value(x, z, close(m | 1 << i)) - value(x, z, close(m))
            m |= 1 << i
    return phi / math.factorial(4)


def frame(out):
    got = {}
    for r in out.collect():
        got.setdefault(r["row_id"], {})[r["feature"]] = r["phi"]
    return {k: np.array([v[f] for f in FEATURES]) for k, v in got.items()}


def test_exact_values(data):
    x, z, dx, dz = data
    got = frame(A.exact(dx, "row_id", dz, FEATURES, score))
    for r in x:
        assert np.allclose(got[r[0]], shapley(r, z)) and np.isclose(got[r[0]].sum(), value(r, z, 15) - value(r, z, 0))


def test_closed_coalitions(data):
    x, z, dx, dz = data
    rules = C.rule_masks([(("A",), "b"), (("b", "c"), "d"), (("q",), "a")], FEATURES)
    assert rules == [(1, 2), (6, 8)]
    got = frame(A.exact(dx, "row_id", dz, FEATURES, score, rules))
    for r in x:
        assert np.allclose(got[r[0]], shapley(r, z, lambda m: C.close_mask(m, rules)))


def test_regression_over_all_coalitions_is_exact(data):
    x, z, dx, dz = data
    for kernel in ("leverage", "kernel"):
        got = frame(A.regression(dx, "row_id", dz, FEATURES, score, kernel=kernel))
        assert all(np.allclose(got[r[0]], shapley(r, z)) for r in x)


def test_sampled_regression_keeps_the_sum(data):
    x, z, dx, dz = data
    got = frame(A.regression(dx, "row_id", dz, FEATURES, score, samples=8, seed=3))
    assert all(np.isclose(got[r[0]].sum(), value(r, z, 15) - value(r, z, 0)) for r in x)


def test_monte_carlo_converges(data):
    x, z, dx, dz = data
    got = frame(A.monte_carlo(dx.filter("row_id < 2"), "row_id", dz, FEATURES, score, n=3000, seed=1))
    mean = frame(A.monte_carlo(dx.filter("row_id < 2"), "row_id", dz, FEATURES, score, n=3000, seed=1, scale="mean"))
    for r in x[:2]:
        want = shapley(r, z)
        assert np.allclose(got[r[0]], want, atol=0.12 * (1 + np.abs(want).max())) and np.allclose(got[r[0]], 4 * mean[r[0]])


def test_draws_are_what_they_say(data):
    _, _, dx, _ = data
    rows = C.draws(dx, "row_id", 200, 4, 9).collect()
    assert len(rows) == 1200
    sizes = [r["before"].bit_count() for r in rows]
    assert all(r["after"] == r["before"] | 1 << r["pivot"] and not r["before"] >> r["pivot"] & 1 for r in rows)
    assert all(abs(sizes.count(s) - 300) < 70 for s in range(4)) and all(abs([r["pivot"] for r in rows].count(p) - 300) < 70 for p in range(4))
    again = C.draws(dx.repartition(3), "row_id", 200, 4, 9).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_budget_keeps_the_first_classes(spark):
    d = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 7, 3), (1, 9, 4), (2, 9, 1)], "row_id long, canon long, draw int")
    assert sorted((r["row_id"], r["canon"]) for r in C.budget(d, "row_id", "draw", 2).collect()) == [(1, 5), (1, 7), (2, 9)]


def test_masks(spark):
    rules = [(1, 2), (2, 4), (4, 8), (3, 16)]
    got = {r["mask"]: r["canon"] for r in C.canonical(C.all_masks(spark, 6), rules).collect()}
    assert got == {m: C.close_mask(m, rules) for m in range(64)}
    assert [len(w) for w in C.words([f"f{i}" for i in range(130)])] == [62, 62, 6]
    with pytest.raises(ValueError):
        C.all_masks(spark, 40)


def test_sampled_coalitions_come_with_their_complements():
    masks, chance = A.sample_coalitions(10, 100, 1)
    got = set(masks.tolist())
    assert got == {1023 ^ m for m in got} and 80 <= len(got) <= 120 and ((chance > 0) & (chance <= 1)).all()
    assert len(A.sample_coalitions(4, 100)[0]) == 14
    p = A.size_probabilities(8, 60)
    assert np.isclose((p * [math.comb(8, s) for s in range(1, 8)]).sum(), 60) and p[0] == 1


def test_repaired_rows_keep_the_coalition(data, spark):
    x, z, dx, dz = data
    rules = I.load_rules([("t", 1, 0, "d", "IS_NULL", "IS_NULL", "a", "=", ["0"]), ("t", 2, 0, "b", ">=", "0", "a", "=", ["0"])])
    masks = dx.select("row_id", F.lit(1).cast("long").alias("mask")).union(dx.select("row_id", F.lit(2).cast("long")))
    got = {(r["row_id"], r["mask"]): r["value"] for r in A.values(dx, "row_id", masks, dz, FEATURES, score, rules).collect()}
    for r in x:
        assert np.isclose(got[r[0], 1], value(r, z, 1))
        assert np.isclose(got[r[0], 2], np.mean([plain(0, r[2], q[3], q[4]) for q in z]))


def test_any_model_scores(data):
    x, z, dx, dz = data
    model = A.model_scorer(lambda f: f["a"].to_numpy() * 2.0 - f["d"].to_numpy())
    linear = A.linear_scorer({"a": 2.0, "d": -1.0})
    a, b = (frame(A.exact(dx, "row_id", dz, FEATURES, s)) for s in (model, linear))
    assert all(np.allclose(a[k], b[k]) for k in a) and all(np.allclose(v[[1, 2]], 0) for v in a.values())


def test_provenance(spark):
    rows = [(1, "x", 1, "p"), (1, "x", 1, "p"), (2, "x", 2, "p"), (3, "z", 2, "q"), (4, "z", 2, None)]
    df = spark.createDataFrame(rows, "id long, f string, g int, h string")
    index = P.inverted_index(df, "id", ["f", "g", "h"])
    asked = spark.createDataFrame([(10, "f", "x"), (20, "f", "x"), (20, "g", "true"), (30, "f", "z")], "key long, feature string, value string")
    found = P.candidates(index, asked)
    assert sorted(map(tuple, found.collect())) == [(10, 1), (10, 2), (20, 1), (30, 3), (30, 4)]
    assert {(r["key"], r["feature"]) for r in P.constant_values(index, found, ["g", "h"]).collect()} == {(10, "h"), (20, "g"), (20, "h"), (30, "g")}
    masks = spark.createDataFrame([(10, 1), (20, 3), (30, 1), (40, 1)], "key long, mask long")
    rules = [(("f",), ("h",)), (("f",), ("g",))]
    strong = {r["key"]: (r["n_candidates"], r["expanded"]) for r in P.expand(masks, found, index, ["f", "g", "h"], rules).collect()}
    assert strong == {10: (2, 1), 20: (1, 7), 30: (2, 1), 40: (0, 1)}
    weak = {r["key"]: r["expanded"] for r in P.expand(masks, found, index, ["f", "g", "h"], rules, weak=True).collect()}
    assert weak == {10: 5, 20: 7, 30: 3, 40: 1}
    by_row = P.entity_candidates(df, "id", spark.createDataFrame([(1, 3, "z", 2, "-"), (2, 6, "-", 2, None)], "key long, mask long, f string, g int, h string"), ["f", "g", "h"])
    assert sorted(map(tuple, by_row.collect())) == [(1, 3), (1, 4), (2, 4)]
    a, b = spark.createDataFrame([(1, 5), (1, 6)], "key long, row_id long"), spark.createDataFrame([(1, 6), (1, 7)], "key long, row_id long")
    assert [tuple(r) for r in P.intersect_ids([a, b]).collect()] == [(1, 6)]
    assert {r["f"]: r["ids"] for r in P.group_map(df, ["f"], "id").collect()} == {"x": [1, 2], "z": [3, 4]}
    again = P.expand_again(masks.filter("key = 20"), lambda m: found.join(m.select("key"), "key"), index, ["f", "g", "h"], rules)
    assert again.first()["expanded"] == 7
    assert P.id_rules([(("id",), "h"), (("id",), "other_id"), (("f",), "g")], ["id", "other_id"]) == {"id": ["h"], "other_id": []}


@pytest.mark.parametrize(("name", "options"), [("logreg", {}), ("random_forest", {"numTrees": 10, "seed": 1}), ("gbdt", {"maxIter": 5, "seed": 1}), ("svm", {"maxIter": 20}), ("mlp", {"layers": [4, 2], "maxIter": 60, "seed": 1})])
def test_models_learn(spark, name, options):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b) if a > -2 else None, "uv"[int(a * 3) % 2], int(a + b > 0)) for a, b in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, t string, y int")
    out = M.scored(M.train(df, "y", name, **options), df)
    assert M.auc(out, "y", "proba").first()["auc"] > 0.9 and M.confusion(out, "y", "prediction").first()["accuracy"] > 0.8


def test_search_and_labels(spark):
    rows = [(i, float(i % 10), "no" if i % 10 < 5 else "yes") for i in range(200)]
    df = M.encode_label(spark.createDataFrame(rows, "k long, x double, y string"), "y")
    assert {(r["x"] >= 5) == (r["y"] == 1) for r in df.collect()} == {True}
    found = M.search(df, "k", "y", lambda d, label, **o: M.train(d, label, "logreg", **o), {"regParam": [0.0, 0.1], "maxIter": [5]}, tries=2, seed=1)
    assert len(found) == 2 and found[0][0] > 0.95


def test_every_part_is_explained(spark):
    from collections import defaultdict

    from tesserae.plans import q_attribution as Q

    sf = "/root/testdata/sf0.001"
    parts, background = ([r.asDict() for r in df.collect()] for df in Q.every_part(spark, sf))
    assert len(background) == Q.BACKGROUND and len(parts) == spark.read.parquet(f"{sf}/part.parquet").count() > 56

    def score(x):
        return 2 * x["qty"] + (100 if x["disc"] > 5 and x["qty"] > 25 else 0) - 3 * x["tax"] * (x["size"] > 20)

    base = sum(map(score, background)) / len(background)
    got = defaultdict(float)
    for r in Q.shapley_leverage_budget(spark, sf).collect():
        got[r["row_id"]] += r["phi"]
    assert set(got) == {x["row_id"] for x in parts}
    for x in parts:
        assert abs(got[x["row_id"]] - (score(x) - base)) < 1e-6
    assert {r["row_id"] for r in Q.shapley_monte_carlo(spark, sf).select("row_id").distinct().collect()} == set(got)


def test_sampled_estimates_of_parts_are_near_the_exact_ones(spark):
    from tesserae.plans import q_attribution as Q

    sf = "/root/testdata/sf0.001"
    pick = lambda out: {(r["row_id"], r["feature"]): r["phi"] for r in out.collect()}
    off = lambda got, want: np.mean([abs(got[k] - want[k]) for k in want]) / np.mean([abs(v) for v in want.values()])
    e, b = Q.every_part(spark, sf)
    want, drawn = pick(Q.shapley_exact(spark, sf)), pick(A.monte_carlo(e, "row_id", b, Q.FEATURES, Q.score, n=100, seed=2026))
    assert set(want) == set(drawn) and off(drawn, want) < 0.25
    want, solved = pick(Q.shapley_fd_closed(spark, sf)), pick(Q.shapley_leverage_budget(spark, sf))
    assert set(want) == set(solved) and off(solved, want) < 0.5


def test_budget_draws_anew(data):
    x, z, dx, dz = data
    d = C.draws(dx, "row_id", 300, 4, 2).withColumn("s0", F.col("before")).withColumn("s1", F.col("after"))
    kept = C.first_draws(d, "row_id", ["s0", "s1"], 7).collect()
    assert len(kept) == 7 * len(x) == len({(r["row_id"], r["s0"], r["s1"]) for r in kept})
    masks, _ = A.sample_classes(4, 6, 1, [(1, 2)], 100)
    assert len({C.close_mask(m, [(1, 2)]) for m in masks.tolist()}) == len(masks) == 6
    got = frame(A.monte_carlo(dx, "row_id", dz, FEATURES, score, n=7, seed=2, max_skips=200))
    assert set(got) == {r[0] for r in x}


def test_provenance_widens_coalitions(spark, data):
    x, z, dx, dz = data
    rows = spark.createDataFrame([(f"e{i}", *r[1:3]) for i, r in enumerate(x)] + [("e0", 99, 99)], "e string, a int, b int")
    canon = P.canon_by_provenance(dx, "row_id", rows, "e", FEATURES, [(("a",), ("b", "c"))], again=False)
    every = dx.select("row_id").join(C.all_masks(spark, 4), F.lit(True), "inner")
    got = {(r["row_id"], r["mask"]): r["canon"] for r in canon(every).collect()}
    assert len(got) == 16 * len(x)
    for r in x:
        for m in range(16):
            ids = {i for i, q in enumerate(x) if all(not m >> k & 1 or q[k + 1] == r[k + 1] for k in (0, 1))}
            assert got[r[0], m] == (m | 6 if m & 3 and len(ids) == 1 and m & 1 else m)
    phi = frame(A.exact(dx, "row_id", dz, FEATURES, score, canon=canon))
    for r in x:
        assert np.allclose(phi[r[0]], shapley(r, z, lambda m, r=r: got[r[0], m]))


def test_draws_are_no_small_table(spark, tmp_path):
    """A file of a few kB is n draws a row: neither its draws nor what is joined to them may go through the driver."""
    spark.range(2000).select(F.col("id").alias("row_id"), *[(F.col("id") % (7 + i)).cast("int").alias(f) for i, f in enumerate(FEATURES)]).write.parquet(f"{tmp_path}/x")
    x = spark.read.parquet(f"{tmp_path}/x")
    size = lambda d: int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(C.draws(x, "row_id", 100, 4, 9)) >= 100 * size(x.select("row_id"))
    phi = A.monte_carlo(x, "row_id", x.limit(4), FEATURES, score, n=100, seed=1)
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[[^\]]*,", plan)


@pytest.mark.parametrize("features", [1, 2, 5])
def test_draws_compared_like_draws_sorted(spark, monkeypatch, features):
    rows = spark.range(30).withColumnRenamed("id", "row_id")
    got = sorted(map(tuple, C.draws(rows, "row_id", 50, features, 3).collect()))
    monkeypatch.setattr(C, "COMPARED", 0)
    assert got == sorted(map(tuple, C.draws(rows, "row_id", 50, features, 3).collect()))
