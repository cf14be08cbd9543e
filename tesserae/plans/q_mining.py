"""Queries of constraint mining, closure, checking and repair over flat tables of the driver's data."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from tesserae.operators import data_constraints as D
from tesserae.operators import integrity as I
from tesserae.operators import refine as X
from tesserae.operators import schema_constraints as S
from tesserae.plans.lineage import Lineage
from tesserae.plans.q_relational import ORACLES as _R
from tesserae.plans.q_relational import table
from tesserae.sources.catalog import DRIVER
from tesserae.sources.config import Config

QUERIES: dict = {}
ORACLES: dict = {}

FLAT = "c_nationkey n_name n_regionkey r_name c_mktsegment acct_band".split()
FLAT_SQL = """flat AS (SELECT c_nationkey, n_name, n_regionkey, r_name, c_mktsegment, CAST(floor(c_acctbal / 2500) AS INTEGER) AS acct_band, c_custkey, c_acctbal
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return out.select("c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment", F.floor(F.col("c_acctbal") / 2500).cast("int").alias("acct_band"), "c_custkey", "c_acctbal")


def _pair_sql(lhs: tuple[str, ...], rhs: str) -> str:
    return f"""SELECT '{",".join(lhs)}' AS lhs, '{rhs}' AS rhs, count(*) AS groups, count(*) FILTER (WHERE d > 1) AS bad_groups, CAST(coalesce(sum(n) FILTER (WHERE d > 1), 0) AS BIGINT) AS bad_rows
FROM (SELECT count(DISTINCT {rhs}) + max(CASE WHEN {rhs} IS NULL THEN 1 ELSE 0 END) AS d, count(*) AS n FROM flat GROUP BY {", ".join(lhs)})"""


_PAIRS = "\nUNION ALL ".join(_pair_sql((a,), b) for a, b in permutations(FLAT, 2))
_TWO = "\nUNION ALL ".join(_pair_sql(s, b) for s in combinations(sorted(FLAT), 2) for b in sorted(FLAT) if b not in s)


@query(f"WITH {FLAT_SQL} {_PAIRS}")
def fd_violations_pairs(spark, sf_dir):
    return D.violations(flat(spark, sf_dir).select(*FLAT), [(c,) for c in FLAT], FLAT).drop("rows")


@query(f"WITH {FLAT_SQL} {_TWO}")
def fd_violations_two_columns(spark, sf_dir):
    return D.violations(flat(spark, sf_dir).select(*FLAT), list(combinations(sorted(FLAT), 2)), sorted(FLAT)).drop("rows")


@query(f"""WITH {FLAT_SQL}, one AS ({_PAIRS}), two AS ({_TWO}),
e1 AS (SELECT lhs, rhs FROM one WHERE bad_groups = 0), e2 AS (SELECT lhs, rhs FROM two WHERE bad_groups = 0
  AND NOT EXISTS (SELECT 1 FROM e1 WHERE e1.rhs = two.rhs AND list_contains(string_split(two.lhs, ','), e1.lhs)))
SELECT * FROM e1 UNION ALL SELECT * FROM e2""")
def fd_exact_minimal(spark, sf_dir):
    exact, _ = D.discover_fds(flat(spark, sf_dir).select(*FLAT), 2, 0.01)
    return spark.createDataFrame([(",".join(d.lhs), d.rhs) for d in exact], "lhs string, rhs string")


_P = "p_brand p_type p_size".split()
_PSQL = "\nUNION ALL ".join(_pair_sql(s, b) for k in (1, 2) for s in combinations(sorted(_P + ["p_name"]), k) for b in sorted(_P + ["p_name"]) if b not in s)


@query(f"""WITH flat AS (SELECT p_brand, p_type, p_size, p_name FROM part), v AS ({_PSQL}),
e AS (SELECT * FROM v WHERE bad_groups = 0), a AS (SELECT * FROM v WHERE bad_groups > 0 AND bad_groups / groups <= 0.9
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.rhs = v.rhs AND list_has_all(string_split(v.lhs, ','), string_split(e.lhs, ','))))
SELECT lhs, rhs, round(bad_groups / groups, 9) AS approx_error FROM a
WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.rhs = a.rhs AND b.lhs <> a.lhs AND list_has_all(string_split(a.lhs, ','), string_split(b.lhs, ',')))""")
def fd_approximate(spark, sf_dir):
    _, near = D.discover_fds(table(spark, sf_dir, "part").select(*_P, "p_name"), 2, 0.9)
    return spark.createDataFrame([(",".join(d.lhs), d.rhs, round(d.error, 9)) for d in near], "lhs string, rhs string, approx_error double")


_K = [c for k in (1, 2) for c in combinations(sorted(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), k)]


@query("\nUNION ALL ".join(f"SELECT '{','.join(c)}' AS lhs, count(*) = (SELECT count(*) FROM orders) AS is_unique, count(*) / (SELECT count(*) FROM orders) AS ratio_distinct, count(*) AS \"distinct\", (SELECT count(*) FROM orders) AS n FROM (SELECT DISTINCT {', '.join(c)} FROM orders)" for c in _K))
def key_profile(spark, sf_dir):
    return D.key_profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 2)


@query("SELECT 'o_orderkey' AS candidate_key UNION ALL SELECT 's_suppkey' UNION ALL SELECT 's_nationkey' WHERE (SELECT count(DISTINCT s_nationkey) = count(*) FROM supplier) UNION ALL SELECT 's_name' WHERE (SELECT count(DISTINCT s_name) = count(*) FROM supplier) UNION ALL SELECT 's_acctbal' WHERE (SELECT count(DISTINCT s_acctbal) = count(*) FROM supplier)")
def candidate_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    found = D.candidate_keys(orders, ["key"]) + D.candidate_keys(table(spark, sf_dir, "supplier"), ["key"])
    return spark.createDataFrame([(",".join(k),) for k in found], "candidate_key string")


_T = {"c_nationkey": False, "c_mktsegment": True, "acct_band": False, "c_custkey": False, "r_name": True}


@query(f"WITH {FLAT_SQL}, n AS (SELECT count(*) AS n FROM flat)\n" + "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN {text} OR d <= 30 THEN 'categorical' ELSE 'continuous' END AS kind, d / n >= 0.2 AS id_like, d AS \"distinct\", n FROM (SELECT count(DISTINCT {c}) AS d FROM flat), n" for c, text in _T.items()))
def column_types(spark, sf_dir):
    return D.column_types(flat(spark, sf_dir).select(*_T), Config())


@query(f"WITH {FLAT_SQL} SELECT r_name AS value, count(*) AS support, list_sort(list(DISTINCT n_name)) AS allowed FROM flat GROUP BY r_name HAVING count(*) >= 30 AND count(DISTINCT n_name) <= 20")
def domain_category_by_category(spark, sf_dir):
    return D.domain_of_categories(flat(spark, sf_dir), "n_name", "r_name", Config())


@query(f"WITH {FLAT_SQL} SELECT c_mktsegment AS value, count(*) AS support, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM flat GROUP BY 1 HAVING count(*) >= 30")
def domain_range_by_category(spark, sf_dir):
    return D.domain_of_range(flat(spark, sf_dir), "c_acctbal", "c_mktsegment", Config())


@query(f"WITH {FLAT_SQL} SELECT c_mktsegment AS value, count(*) AS support, quantile_cont(c_acctbal, 0.005) AS lo, quantile_cont(c_acctbal, 0.995) AS hi FROM flat GROUP BY 1 HAVING count(*) >= 30")
def domain_quantiles_by_category(spark, sf_dir):
    return D.domain_of_range(flat(spark, sf_dir), "c_acctbal", "c_mktsegment", Config(use_quantiles=True))


@query(f"""WITH {FLAT_SQL}, q AS (SELECT quantile_cont(c_acctbal, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM flat),
b AS (SELECT r_name, CAST(len(list_filter(e[2:10], lambda x: x < c_acctbal)) AS INTEGER) AS bin, e FROM flat, q)
SELECT bin, e[bin + 1] AS lo, e[bin + 2] AS hi, count(*) AS support, list_sort(list(DISTINCT r_name)) AS allowed FROM b GROUP BY bin, e HAVING count(*) >= 30""")
def domain_category_by_bin(spark, sf_dir):
    return D.domain_of_bins(flat(spark, sf_dir), "r_name", "c_acctbal", Config())


_BITS = """bits AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 3 ELSE 0 END AS h1, CASE WHEN l_returnflag = 'N' THEN 3 ELSE 0 END AS h2, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS h3,
 CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS b1, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS b2, CASE WHEN (l_linestatus = 'F') = (l_quantity > 25) THEN 1 ELSE 0 END AS b3 FROM lineitem)"""


def bits(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    flag = lambda v, k: F.when(F.col("l_returnflag") == v, k).otherwise(0)
    f, q = F.col("l_linestatus") == "F", F.col("l_quantity") > 25
    return df.select("l_orderkey", flag("A", 3).alias("h1"), flag("N", 3).alias("h2"), flag("R", 3).alias("h3"), f.cast("int").alias("b1"), q.cast("int").alias("b2"), (f == q).cast("int").alias("b3"))


@query(f"""WITH {_BITS}
SELECT 'h1,h2,h3' AS cols, 'onehot_m' AS kind, max(greatest(h1, h2, h3)) AS k, CAST(NULL AS INTEGER) AS parity_bit, min(h1 + h2 + h3) = 0 AS allow_zero FROM bits HAVING max(CAST(h1 > 0 AS INT) + CAST(h2 > 0 AS INT) + CAST(h3 > 0 AS INT)) = 1
UNION ALL SELECT 'b1,b2,b3', 'parity', NULL, CAST(min((b1 + b2 + b3) % 2) AS INTEGER), min(b1 + b2 + b3) = 0 FROM bits HAVING min((b1 + b2 + b3) % 2) = max((b1 + b2 + b3) % 2)
UNION ALL SELECT 'h1,h2', 'onehot_2', max(greatest(h1, h2)), NULL, min(h1 + h2) = 0 FROM bits HAVING max(CAST(h1 > 0 AS INT) + CAST(h2 > 0 AS INT)) = 1""")
def onehot_and_parity(spark, sf_dir):
    found = D.integrity(bits(spark, sf_dir), [("h1", "h2", "h3"), ("b1", "b2", "b3"), ("h1", "h2"), ("b1", "b2")])
    return spark.createDataFrame([(r["cols"], r["kind"], r["k"], r["parity_bit"], r["allow_zero"]) for r in found], "cols string, kind string, k int, parity_bit int, allow_zero boolean")


_BIT_COLUMNS = ("b1", "b2", "b3", "h1", "h2", "h3")


def _holds(lhs: tuple[str, ...], rhs: str) -> str:
    return f"(SELECT max(d) = 1 FROM (SELECT count(DISTINCT {rhs}) AS d FROM bits GROUP BY {', '.join(lhs)}))"


def _cycle_sql(s: tuple[str, ...]) -> str:
    """The set, where each column depends on all the others and on no fewer."""
    rest = {c: tuple(x for x in s if x != c) for c in s}
    fewer = [f"NOT {_holds((x,), c)}" for c in s for x in rest[c] if len(s) > 2]
    return f"SELECT '{','.join(s)}' AS cols WHERE {' AND '.join([*(_holds(rest[c], c) for c in s), *fewer])}"


@query(f"WITH {_BITS}\n" + "\nUNION ALL ".join(_cycle_sql(s) for k in (2, 3) for s in combinations(_BIT_COLUMNS, k)))
def cycle_detection(spark, sf_dir):
    exact, _ = D.discover_fds(bits(spark, sf_dir).select(*_BIT_COLUMNS), 2, 0.01)
    sets = D.full_cycles([(d.lhs, d.rhs) for d in exact])
    return spark.createDataFrame([(",".join(s),) for s in sets], "cols string")


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else repr(list(v)) if isinstance(v, (list, tuple)) else repr(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


#: What the driver's declared keys and references imply: key, kind, and the columns that follow, by hand (fixed values).
_SCHEMA_FDS = [
    ("r_regionkey", "pk", "r_name"), ("n_nationkey", "pk", "n_name n_regionkey"), ("n_regionkey", "fk", "r_name"),
    ("c_custkey", "pk", "c_name c_nationkey c_acctbal c_mktsegment"), ("c_name", "unique_nullable", "c_custkey c_nationkey c_acctbal c_mktsegment"), ("c_nationkey", "fk", "n_name n_regionkey"),
    ("s_suppkey", "pk", "s_name s_nationkey s_acctbal"), ("s_nationkey", "fk", "n_name n_regionkey"), ("p_partkey", "pk", "p_name p_brand p_type p_size p_retailprice"),
    ("o_orderkey", "pk", "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"), ("o_custkey", "fk", "c_name c_nationkey c_acctbal c_mktsegment"),
]


@query("SELECT [key] AS lhs, unnest(string_split(columns, ' ')) AS rhs, kind FROM (VALUES " + _values(_SCHEMA_FDS) + ") t(key, kind, columns)")
def schema_fds(spark, sf_dir):
    return S.schema_fd_frame(spark, DRIVER).select("lhs", "rhs", "kind")


#: Expected atoms of the driver catalog's checks, written out by hand (fixed values).
_ATOMS = [
    (1, 0, "o_orderstatus", "=", "F", "o_totalprice", ">=", ["1000"]), (2, 0, "o_totalprice", "<", "100000", "o_orderpriority", "IN", ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
    (3, 0, "o_orderstatus", "=", "P", "o_totalprice", ">=", ["5000"]), (3, 0, "o_orderstatus", "=", "P", "o_totalprice", "<=", ["200000"]),
]


@query("SELECT * FROM (VALUES " + _values(_ATOMS) + ") t(cid, group_id, lhs, op, value, rhs, domain_op, domain_value)")
def check_atoms(spark, sf_dir):
    return S.check_atom_frame(spark, DRIVER).drop("source")


@query("""
SELECT 'schema' AS source, 1 AS cid, count(*) FILTER (WHERE o_orderstatus = 'F') AS guarded, count(*) FILTER (WHERE o_orderstatus = 'F' AND NOT o_totalprice >= 1000) AS violated FROM orders
UNION ALL SELECT 'schema', 2, count(*) FILTER (WHERE o_totalprice < 100000), count(*) FILTER (WHERE o_totalprice < 100000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) FROM orders
UNION ALL SELECT 'schema', 3, count(*) FILTER (WHERE o_orderstatus = 'P'), count(*) FILTER (WHERE o_orderstatus = 'P' AND NOT o_totalprice BETWEEN 5000 AND 200000) FROM orders""")
def check_violations(spark, sf_dir):
    return I.violation_counts(table(spark, sf_dir, "orders"), I.load_rules(S.check_atoms(spark, DRIVER)[0]))


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS p0, o_totalprice AS t0, CASE WHEN o_orderstatus = 'F' THEN greatest(o_totalprice, 1000) ELSE o_totalprice END AS t1 FROM orders),
b AS (SELECT *, CASE WHEN t1 < 100000 AND p0 NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN '1-URGENT' ELSE p0 END AS o_orderpriority,
  CASE WHEN o_orderstatus = 'P' THEN least(greatest(t1, 5000), 200000) ELSE t1 END AS o_totalprice FROM a)
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_totalprice <> t0 AS INTEGER) + CAST(o_orderpriority <> p0 AS INTEGER) AS n_changed, 0 AS n_infeasible FROM b""")
def repair_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return I.repair(df, I.load_rules(S.check_atoms(spark, DRIVER)[0]))


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, 0 AS n_changed,
 CAST(o_orderstatus = 'F' AND NOT o_totalprice >= 1000 AS INTEGER) + CAST(o_orderstatus = 'P' AND NOT o_totalprice BETWEEN 5000 AND 200000 AS INTEGER) + CAST(o_totalprice < 100000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS INTEGER) AS n_infeasible FROM orders""")
def repair_with_fixed(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return I.repair(df, I.load_rules(S.check_atoms(spark, DRIVER)[0]), fixed=("o_totalprice", "o_orderpriority"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END AS l_tax, l_returnflag, CAST(l_returnflag = 'N' AND l_tax IS NOT NULL AS INTEGER) AS n_changed, 0 AS n_infeasible FROM lineitem""")
def repair_null_gate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_returnflag")
    return I.repair(df, I.load_rules([("hand", 1, 0, "l_returnflag", "=", "N", "l_tax", "IS_NULL", ["IS_NULL"])]))


@query(f"""WITH {_BITS}, m AS (SELECT l_orderkey, h1, CASE WHEN b2 = 1 THEN 3 ELSE h2 END AS h2, CASE WHEN b1 = 1 THEN 0 ELSE h3 END AS h3 FROM bits)
SELECT l_orderkey, h1, CASE WHEN h1 <> 0 THEN 0 WHEN h2 <> 0 THEN 3 WHEN h3 <> 0 THEN 0 ELSE 3 END AS h2, CASE WHEN h1 <> 0 THEN 0 WHEN h2 <> 0 THEN 0 WHEN h3 <> 0 THEN 3 ELSE 0 END AS h3, false AS infeasible FROM m""")
def repair_onehot(spark, sf_dir):
    df = bits(spark, sf_dir).select("l_orderkey", "h1", F.expr("case when b2 = 1 then 3 else h2 end").alias("h2"), F.expr("case when b1 = 1 then 0 else h3 end").alias("h3"))
    return I.repair_onehot(df, ["h1", "h2", "h3"], 3, fixed=("h1",))


@query(f"WITH {_BITS} SELECT l_orderkey, b1, CASE WHEN (b1 + b2 + b3) % 2 <> 0 THEN 1 - b2 ELSE b2 END AS b2, b3, false AS infeasible FROM bits")
def repair_parity(spark, sf_dir):
    return I.repair_parity(bits(spark, sf_dir).select("l_orderkey", "b1", "b2", "b3"), ["b1", "b2", "b3"], 0, fixed=("b3",))


#: Dependencies that the flattening queries imply, written out by hand (fixed values).
_QUERY_FDS = [("top_item_per_order", "o_orderkey", c, k) for c, k in (("n_items", "window_agg"), ("total_qty", "window_agg"), ("top_partkey", "top1"), ("top_price", "top1"))]
_QUERY_FDS += [("top_part_per_brand", "p_brand", c, "top1") for c in ("top_partkey", "top_price")]
_QUERY_FDS += [("tpch_supplier_profile", "n_name,r_name,s_suppkey", c, "group_by") for c in "n_lineitems n_orders n_customers n_parts gross_extendedprice revenue_net avg_discount avg_tax avg_quantity avg_ship_delay_days return_rate frac_urgent frac_high frac_low".split()]


@query("SELECT * FROM (VALUES " + _values(_QUERY_FDS) + ") t(query, lhs, rhs, kind)")
def query_fds(spark, sf_dir):
    rows = [(q, ",".join(a), b, k) for q in ("top_item_per_order", "top_part_per_brand", "tpch_supplier_profile") for a, b, k in Lineage(spark, _R[q], DRIVER).exported()]
    return spark.createDataFrame(rows, "query string, lhs string, rhs string, kind string")


#: Conditions of the predicate query, and the atoms they imply by hand (fixed values).
_PREDICATE = "SELECT o_orderkey FROM orders WHERE (o_orderstatus <> 'F' OR (o_totalprice BETWEEN 1 AND 9 AND o_orderpriority IN ('a', 'b'))) AND (CASE WHEN o_custkey = 7 THEN o_totalprice >= 3 ELSE TRUE END)"
_PREDICATE_ATOMS = [(1, "o_orderstatus", "=", "F", "o_totalprice", ">=", ["1"]), (1, "o_orderstatus", "=", "F", "o_totalprice", "<=", ["9"]), (1, "o_orderstatus", "=", "F", "o_orderpriority", "IN", ["a", "b"]), (2, "o_custkey", "=", "7", "o_totalprice", ">=", ["3"])]


@query("SELECT * FROM (VALUES " + _values(_PREDICATE_ATOMS) + ") t(cid, lhs, op, value, rhs, domain_op, domain_value)")
def query_conditional_domains(spark, sf_dir):
    rows = Lineage(spark, _PREDICATE, DRIVER).conditional_domains()
    return spark.createDataFrame(rows, S.ATOM_SCHEMA).drop("source", "group_id")


_CLOSURE_RULES = [(("c_custkey",), "c_nationkey"), (("c_nationkey",), "n_name"), (("c_nationkey",), "n_regionkey"), (("n_name",), "c_nationkey"), (("n_regionkey",), "r_name"), (("c_mktsegment", "r_name"), "desk")]


@query("""
WITH RECURSIVE rules(lhs, rhs) AS (VALUES (['c_custkey'], 'c_nationkey'), (['c_nationkey'], 'n_name'), (['c_nationkey'], 'n_regionkey'), (['n_name'], 'c_nationkey'), (['n_regionkey'], 'r_name'), (['c_mktsegment', 'r_name'], 'desk')),
seeds(seed) AS (SELECT DISTINCT s FROM (SELECT lhs AS s FROM rules UNION SELECT [unnest(lhs)] FROM rules UNION SELECT [rhs] FROM rules)),
c(seed, have, i) AS (SELECT seed, seed, 0 FROM seeds UNION ALL
  SELECT seed, list_sort(list_distinct(list_concat(have, (SELECT list(rhs) FROM rules WHERE list_has_all(c.have, lhs))))), i + 1 FROM c WHERE i < 7)
SELECT seed, list_sort(have) AS closure FROM c WHERE i = 7""")
def fd_closure_seeds(spark, sf_dir):
    return X.closure_frame(spark, _CLOSURE_RULES)


@query()
def merged_constraints(spark, sf_dir):
    df = flat(spark, sf_dir).select(*FLAT)
    exact, near = D.discover_fds(df, 2, 0.01)
    data = spark.createDataFrame([(list(d.lhs), d.rhs, "data", "fd", d.error) for d in exact + near], S.FD_SCHEMA)
    declared = S.schema_fd_frame(spark, DRIVER).filter(~F.col("kind").isin("unique_nullable"))
    fds = X.drop_columns(X.check_single_rhs(X.merge_fds([declared, data])), ["c_mktsegment"])
    atoms = X.merge_atoms([S.check_atom_frame(spark, DRIVER), spark.createDataFrame(D.domain_atoms(df, exact, Config()), S.ATOM_SCHEMA)])
    return X.unified(fds, atoms)
