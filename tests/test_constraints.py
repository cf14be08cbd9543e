"""Mining, closure, checking, repair."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators import data_constraints as D
from tesserae.operators import integrity as I
from tesserae.operators import refine as X
from tesserae.operators.schema_constraints import ATOM_SCHEMA, FD_SCHEMA
from tesserae.sources.config import Config, from_dict


def test_null_is_a_value(spark):
    df = spark.createDataFrame([(1, "x", None), (1, None, None), (2, "y", 1), (None, "z", 2), (None, "z", 2)], "a int, b string, c int")
    exact, near = D.discover_fds(df, 1, 0.5)
    brute = set()
    rows = [tuple(r) for r in df.collect()]
    for i, j in itertools.permutations(range(3), 2):
        seen = {}
        if all(seen.setdefault(r[i], r[j]) == r[j] for r in rows):
            brute.add((("abc"[i],), "abc"[j]))
    assert {(d.lhs, d.rhs) for d in exact} == brute
    assert (("a",), "b") in {(d.lhs, d.rhs) for d in near}  # one group of three


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*[st.sampled_from([None, 0, 1, 2])] * 4), min_size=1, max_size=9))
def test_minimal_dependencies_like_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    exact, _ = D.discover_fds(df, 2, 0.01)
    want = {}
    for k in (1, 2):
        for lhs in itertools.combinations(range(4), k):
            for r in set(range(4)) - set(lhs):
                seen = {}
                holds = all(seen.setdefault(tuple(x[i] for i in lhs), x[r]) == x[r] for x in rows)
                if holds and not any(set(o) < set(lhs) for o in want.get(r, [])):
                    want.setdefault(r, []).append(lhs)
    assert {(d.lhs, d.rhs) for d in exact} == {(tuple("abcd"[i] for i in lhs), "abcd"[r]) for r, ls in want.items() for lhs in ls}


def test_approximate_errors_count_groups(spark):
    rows = [(i, i % 7) for i in range(100)] + [(3, 5)] * 4
    _, near = D.discover_fds(spark.createDataFrame(rows, "k int, v int"), 1, 0.01)
    d = next(d for d in near if d.lhs == ("k",))
    assert (d.error, d.bad_rows, d.rows) == (0.01, 5, 104)
    exact, near = D.discover_fds(spark.createDataFrame(rows, "k int, v int"), 1, 0.009)
    assert not exact and not near


def test_excluded_pairs(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(6)], "k int, v int")
    assert D.discover_fds(df, 1, 0.01, {("k", "v")}) == ([], [])


def test_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a")], "x_id int, y_id int, t string")
    profile = {r["lhs"]: r for r in D.key_profile(df, 2).collect()}
    assert profile["x_id,y_id"]["is_unique"] and profile["t,x_id"]["is_unique"] and not profile["t"]["is_unique"]
    assert (("x_id", "y_id"), "t") in [(tuple(k), c) for k, c in D.key_fds(df, D.key_profile(df, 2))]
    assert D.candidate_keys(df, ["id"]) == [("x_id", "y_id")]


def test_domains_become_atoms(spark):
    rows = [(f"c{i % 6}" if i % 12 else None, "ab"[i % 2], float(i % 2 * 10 + i % 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "city string, land string, x double")
    config = Config(min_group_support=10, cat_max_unique=3)
    fds = [D.Dependency(("city",), "land", 1, 0, 0, 1), D.Dependency(("x",), "land", 1, 0, 0, 1)]
    atoms = D.domain_atoms(df, fds, config)
    a = {r[:3] + (r[5], r[6], r[7]): r[8] for r in atoms}
    assert a["data", 1, 0, "a", "city", "IN"] == ["c0", "c2", "c4"] and a["data", 1, 1, "a", "city", "IS_NULL"] == ["IS_NULL"]
    rules = I.load_rules(atoms)
    assert all(r["violated"] == 0 for r in I.violation_counts(df, rules).collect())


def test_onehot_and_parity(spark):
    df = spark.createDataFrame([(0, 0, 5, 0, 1, 1), (5, 0, 0, 1, 0, 1), (0, 5, 0, 1, 1, 0)], "a int, b int, c int, p int, q int, r int")
    got = D.integrity(df, [("a", "b", "c"), ("p", "q", "r"), ("a", "p")])
    assert [(r["kind"], r["k"], r["parity_bit"], r["allow_zero"]) for r in got] == [("onehot_m", 5, None, False), ("parity", None, 0, False)]
    assert D.integrity(df.selectExpr("a", "cast(null as int) as b"), [("a", "b")]) == []
    assert D.full_cycles([(("a", "b"), "c"), (("a", "c"), "b"), (("b", "c"), "a"), (("a",), "d")]) == [("a", "b", "c")]


RULES = st.lists(st.tuples(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=2, unique=True).map(tuple), st.sampled_from("abcdef")), max_size=9)


@settings(max_examples=200, deadline=None)
@given(RULES, st.sets(st.sampled_from("abcdef")))
def test_closure_laws(rules, seed):
    c = X.Closure(rules)
    got = set(c(seed))
    assert seed <= got and set(c(got)) == got
    want = set(seed)
    for _ in range(7):
        want |= {r for lhs, r in rules if set(lhs) <= want}
    assert got == want
    for more in "abcdef":
        assert got <= set(c(seed | {more}))


def test_a_rule_needs_its_whole_left_side():
    c = X.Closure([(("x",), "a"), (("a", "b"), "c")])
    assert c(("x",)) == ("a", "x") and c(("x", "b")) == ("a", "b", "c", "x")
    assert c.reasons(("x", "b"))["c"] == (("a", "b"), "c")


def test_merging(spark):
    a = spark.createDataFrame([(["b", "a"], "c", "schema", "pk", 0.0), (["a"], "y", "schema", "pk", 0.0)], FD_SCHEMA)
    b = spark.createDataFrame([(["a", "b"], "c", "data", "exact", 0.0), (["c"], "d", "data", "approximate", 0.004)], FD_SCHEMA)
    merged = X.merge_fds([a, b])
    assert {(",".join(r["lhs"]), r["rhs"], r["source"]) for r in merged.collect()} == {("a,b", "c", "data"), ("a", "y", "schema")}
    assert X.merge_fds([a, b], 0.01).count() == 3 and X.drop_columns(merged, ["Y"]).count() == 1
    with pytest.raises(ValueError):
        X.check_single_rhs(spark.createDataFrame([(["a"], "b,c", "x", "y", 0.0)], FD_SCHEMA))
    atoms = spark.createDataFrame([("schema", 1, 0, "a", "=", "1", "b", ">=", ["1"]), ("query", 1, 0, "a", "=", "2", "b", ">=", ["5"])], ATOM_SCHEMA)
    assert len(I.load_rules([tuple(r) for r in X.merge_atoms([atoms, atoms]).collect()])) == 2  # numbers of different sources stay apart
    assert {r["constraint_type"] for r in X.unified(merged, atoms).collect()} == {"fd", "domain"}


def rule(*atoms):
    return I.load_rules([("t", 1, g, *guard, *body) for g, guard, body in atoms])


G = ("g", "=", "1")


@pytest.mark.parametrize(
    ("rules", "row", "want"),
    [
        (rule((0, G, ("x", ">=", ["3"])), (0, G, ("x", "<=", ["9"]))), (1, 1, "s"), (3, 1, 0)),
        (rule((0, G, ("x", ">=", ["3"])), (0, G, ("x", "<=", ["9"]))), (1, 50, "s"), (9, 1, 0)),
        (rule((0, G, ("x", ">=", ["3"]))), (2, 1, "s"), (1, 0, 0)),
        (rule((0, G, ("x", ">=", ["3"]))), (None, 1, "s"), (1, 0, 0)),
        (rule((0, G, ("x", "IN", ["2", "8", "20"]))), (1, 6, "s"), (8, 1, 0)),
        (rule((0, G, ("x", "IS_NULL", ["IS_NULL"]))), (1, 6, "s"), (None, 1, 0)),
        (rule((0, G, ("x", "=", ["7"]))), (1, 6, "s"), (7, 1, 0)),
        (rule((0, G, ("x", ">=", ["3"]))), (1, None, "s"), (3, 1, 0)),
        (rule((0, ("x", "<", "5"), ("g", "=", ["1"]))), (2, 1, "s"), (1, 1, 0)),
        (rule((0, G, ("x", "=", ["7"])), (1, G, ("x", "IS_NULL", ["IS_NULL"]))), (1, None, "s"), (None, 0, 0)),
    ],
)
def test_repair(spark, rules, row, want):
    r = I.repair(spark.createDataFrame([row], "g int, x int, s string"), rules).first()
    assert (r["x"], r["n_changed"], r["n_infeasible"]) == want


def test_drawn_repairs_meet_the_rules(spark):
    df = spark.createDataFrame([(i, 1, i * 10 - 300, "s") for i in range(200)], "k int, g int, x int, s string")
    band = rule((0, G, ("x", ">=", ["3"])), (0, G, ("x", "<=", ["40"])))
    some = rule((0, G, ("x", "IN", ["2", "8", "20"])), (0, G, ("s", "IN", ["a", "b"])))
    seen = {}
    for mode in ("random", "weighted"):
        a = [tuple(r) for r in I.repair(df, band, mode=mode, key="k", seed=1).orderBy("k").collect()]
        assert all(3 <= r[2] <= 40 and r[5] == 0 for r in a) and len({r[2] for r in a}) > 10
        assert a == [tuple(r) for r in I.repair(df.repartition(3), band, mode=mode, key="k", seed=1).orderBy("k").collect()]
        seen[mode] = sum(r[2] for r in a if r[0] < 30) / 30
        b = I.repair(df, some, mode=mode, key="k", seed=1).collect()
        assert {r["x"] for r in b} == {2, 8, 20} and {r["s"] for r in b} == {"a", "b"}
    assert seen["weighted"] < seen["random"]  # from below, nearer the lower bound
    said = I.repair(df.filter("k < 2"), band, explain=True).orderBy("k").first()["changes"]
    assert said == ["t 1: x -300 to 3, as g = 1 asks x >= 3 and x <= 40"]
    with pytest.raises(ValueError):
        I.repair(df, band, mode="random")


def test_fixed_columns_never_change(spark):
    df = spark.createDataFrame([(1, 1, "s")], "g int, x int, s string")
    r = I.repair(df, rule((0, G, ("x", ">=", ["3"]))), fixed=("x",)).first()
    assert (r["x"], r["n_changed"], r["n_infeasible"]) == (1, 0, 1)


@pytest.mark.parametrize(
    ("row", "fixed", "want"),
    [((0, 0, 0), (), (4, 0, 0, False)), ((4, 4, 0), (), (4, 0, 0, False)), ((0, 4, 4), ("c",), (0, 0, 4, False)), ((0, 0, 0), ("a",), (0, 4, 0, False)), ((4, 0, 4), ("a", "c"), (4, 0, 4, True)), ((None, 9, None), (), (0, 4, 0, False)), ((0, 0, 0), ("a", "b", "c"), (0, 0, 0, True))],
)
def test_onehot_repair(spark, row, fixed, want):
    assert tuple(I.repair_onehot(spark.createDataFrame([row], "a int, b int, c int"), ["a", "b", "c"], 4, fixed).first()) == want


@pytest.mark.parametrize(("row", "fixed", "want"), [((1, 0, 0), (), (1, 0, 1, False)), ((1, 1, 0), (), (1, 1, 0, False)), ((1, 0, 0), ("c",), (1, 1, 0, False)), ((1, 0, 0), ("a", "b", "c"), (1, 0, 0, True))])
def test_parity_repair(spark, row, fixed, want):
    assert tuple(I.repair_parity(spark.createDataFrame([row], "a int, b int, c int"), ["a", "b", "c"], 0, fixed).first()) == want


def test_settings():
    c = from_dict({"LABEL_COL": "y", "RANDOM_SEED": 9, "MAX_LHS_SIZE": 1, "USE_QUANTILES_FOR_CONTI_CATE": True, "OTHER": 1})
    assert (c.label_col, c.sample_random_seed, c.max_lhs_size, c.use_quantiles, c.fd_eps) == (["y"], 9, 1, True, 0.01)
    with pytest.raises(ValueError):
        from_dict({"PROVENANCE_THRESHOLD": 0})
