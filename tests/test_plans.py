"""Dialect, lineage and declared constraints, against results worked out by hand."""

import pytest

from tesserae.operators import schema_constraints as S
from tesserae.plans import dialect
from tesserae.plans.lineage import Lineage
from tesserae.sources import catalog
from tesserae.sources.catalog import Catalog, Table
from tesserae.sources.tables import NETWORK_DDL, network

TOP_LINE = """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, l.l_partkey AS top_part, l.l_extendedprice AS top_price,
  COUNT(*) OVER (PARTITION BY o.o_orderkey) AS n_lines, SUM(l.l_quantity) OVER (PARTITION BY o.o_orderkey) AS quantity, o.o_totalprice,
FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey
WHERE o.o_totalprice >= 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY o.o_orderkey ORDER BY l.l_extendedprice DESC, l.l_linenumber ASC, l.l_partkey ASC) = 1;
"""
SF = "/root/testdata/sf0.001"


def test_windows_run_before_qualify(spark):
    read = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer", "lineitem")}
    got = dialect.run(spark, TOP_LINE, read).toPandas().set_index("o_orderkey").sort_index()
    lines = read["lineitem"].toPandas()
    want = lines.groupby("l_orderkey").agg(n=("l_quantity", "size"), q=("l_quantity", "sum"), p=("l_extendedprice", "max")).sort_index()
    want = want.loc[want.index.isin(got.index)]
    assert len(got) == len(want) > 100 and (got.n_lines == want.n).all() and abs(got.quantity - want.q).max() < 1e-6 and (got.top_price == want.p).all()


def test_expressions_take_the_place_of_the_column_they_name(spark):
    df = spark.createDataFrame([(1, -2, "x")], "k int, v int, t string")
    out = dialect.run(spark, "SELECT *, abs(v) AS v, FROM t9", {"t9": df})
    assert out.columns == ["k", "v", "t"] and tuple(out.first()) == (1, 2, "x")


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a, FROM t", "SELECT a FROM t"),
        ("SELECT 'x, FROM' AS s, b -- c, FROM\n, FROM t", "SELECT 'x, FROM' AS s, b \n FROM t"),
        ("SELECT date_diff('day', a, f(b, 1)) FROM t", "SELECT CAST(date_diff(CAST(f(b, 1) AS DATE), CAST(a AS DATE)) AS BIGINT) FROM t"),
        ("SELECT COUNT(DISTINCT x) OVER (PARTITION BY k) FROM t", "SELECT CAST(size(collect_set(x) OVER (PARTITION BY k)) AS BIGINT) FROM t"),
        ("SELECT k, rn FROM t QUALIFY rn = 1 ORDER BY k", "SELECT * FROM (SELECT k, rn FROM t) WHERE rn = 1 ORDER BY k"),
        ("SELECT COUNT(DISTINCT x) FROM t", "SELECT COUNT(DISTINCT x) FROM t"),
    ],
)
def test_rewrites(sql, want):
    assert dialect.to_spark(sql) == want


def test_qualify_in_two_blocks(spark):
    spark.createDataFrame([(1, 5), (1, 7), (2, 3)], "k int, v int").createOrReplaceTempView("t2")
    sql = "SELECT k, v FROM (SELECT k, v FROM t2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1) x QUALIFY row_number() OVER (ORDER BY v DESC) = 1"
    assert [tuple(r) for r in dialect.run(spark, sql).collect()] == [(1, 7)]
    with pytest.raises(ValueError):
        dialect.to_spark("SELECT date_diff('month', a, b) FROM t")


def names(fds):
    return {(",".join(a), b, k) for a, b, k in fds}


def test_window_and_top1_dependencies(spark):
    got = names(Lineage(spark, TOP_LINE, catalog.DRIVER).exported())
    assert got == {("o_orderkey", c, k) for c, k in (("n_lines", "window_agg"), ("quantity", "window_agg"), ("top_part", "top1"), ("top_price", "top1"))}


def test_group_by_keeps_the_key_alone(spark):
    sql = "SELECT s.sk AS suppkey, s.bal, n.name, COUNT(*) AS c, SUM(l.x * 2) - AVG(l.y) AS m FROM supp s JOIN nat n ON n.nk = s.nk JOIN line l ON l.sk = s.sk GROUP BY s.sk, s.bal, n.name"
    cat = Catalog([Table("supp", ("sk", "bal", "nk"), ("sk",)), Table("nat", ("nk", "name"), ("nk",))])
    found = Lineage(spark, sql, cat)
    assert names(found.exported()) == {("name,sk", "c", "group_by"), ("name,sk", "m", "group_by")}
    assert ("nat.nk", "supp.nk") in found.join_equalities()


def test_expressions_and_running_aggregates(spark):
    sql = "SELECT o.a - o.b AS gap, CAST(o.c AS INT) AS c2, o.d AS e, CASE WHEN o.a > o.b THEN 1 ELSE 0 END AS late, SUM(o.x) OVER (PARTITION BY o.k ORDER BY o.t) AS run FROM ord o"
    assert names(Lineage(spark, sql).exported()) == {("a,b", "gap", "projection_expression"), ("a,b", "late", "projection_expression")}
    assert ("c", "c2", "projection") in names(Lineage(spark, sql).fds())


def test_columns_through_subqueries(spark):
    sql = "SELECT m.id, t.best FROM movie m LEFT JOIN (SELECT g.id AS id, g.tag AS best FROM score g QUALIFY ROW_NUMBER() OVER (PARTITION BY g.id ORDER BY g.rel DESC, g.tag) = 1) t ON m.id = t.id"
    found = Lineage(spark, sql)
    assert names(found.exported()) == {("id", "best", "top1")}
    assert found.join_equalities() == [("movie.id", "score.id")]


def test_self_joins_get_output_names(spark):
    sql = "SELECT a.pid AS adviser, s.pid AS student, COUNT(*) AS n FROM advised d JOIN person a ON a.pid = d.x JOIN person s ON s.pid = d.y GROUP BY a.pid, s.pid"
    found = Lineage(spark, sql, Catalog([Table("person", ("pid",), ("pid",))]))
    assert found.self_join and names(found.exported()) == {("adviser,student", "n", "group_by")} or names(found.fds()) >= {("a.pid,s.pid", "n", "group_by")}


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("x <> 'v' OR (y BETWEEN 1 AND 3 AND z IN ('a', 'b'))", [("x", "=", "v", "y", ">=", ["1"]), ("x", "=", "v", "y", "<=", ["3"]), ("x", "=", "v", "z", "IN", ["a", "b"])]),
        ("NOT (x = 'v') OR y >= -5", [("x", "=", "v", "y", ">=", ["-5"])]),
        ("CASE WHEN x = 1 THEN y < 4 ELSE TRUE END", [("x", "=", "1", "y", "<", ["4"])]),
        ("CASE WHEN NOT (x = 1) THEN TRUE ELSE y < 4 END", [("x", "=", "1", "y", "<", ["4"])]),
        ("IF(x = 1, y != 4, TRUE)", [("x", "=", "1", "y", "!=", ["4"])]),
        ("x = 1 AND y > 2", [("x", "=", "1", "y", ">", ["2"])]),
        ("x > 1 AND y > 2", []),
    ],
)
def test_conditional_domains(spark, where, want):
    got = [r[3:] for r in Lineage(spark, f"SELECT x FROM t WHERE {where}").conditional_domains()]
    assert got == want


@pytest.mark.parametrize(
    ("check", "want"),
    [
        ("a >= 10 OR b = 3", [("a", "<", "10", "b", "=", ["3"])]),
        ("a <= 10 OR b IS NULL", [("a", ">", "10", "b", "IS_NULL", ["IS_NULL"])]),
        ("a <= 17 OR (b BETWEEN 1 AND 5)", [("a", ">", "17", "b", ">=", ["1"]), ("a", ">", "17", "b", "<=", ["5"])]),
        ("17 <= a OR b IN (1, 2)", [("a", "<", "17", "b", "IN", ["1", "2"])]),
        ("a < 5 OR b >= 2", [("a", ">=", "5", "b", ">=", ["2"])]),
        ("a <> 4 OR b = 'x'", [("a", "=", "4", "b", "=", ["x"])]),
        ("a IS NOT NULL OR b IS NULL", [("a", "IS_NULL", "IS_NULL", "b", "IS_NULL", ["IS_NULL"])]),
        ("(a IS NOT NULL AND c IS NOT NULL) OR b IS NULL", [("a", "IS_NULL", "IS_NULL", "b", "IS_NULL", ["IS_NULL"]), ("c", "IS_NULL", "IS_NULL", "b", "IS_NULL", ["IS_NULL"])]),
        ("a <> 'v' OR (b >= -2.5 AND b <= 3)", [("a", "=", "v", "b", ">=", ["-2.5"]), ("a", "=", "v", "b", "<=", ["3"])]),
        ("a + 1 > b", None),
    ],
)
def test_checks(spark, check, want):
    rows, left = S.check_atoms(spark, Catalog([Table("t", ("a", "b", "c"), checks=[check])]))
    assert [r[3:] for r in rows] == (want or []) and left == ([check] if want is None else [])


def test_declared_dependencies():
    cat = catalog.from_ddl(NETWORK_DDL)
    assert [len(t.checks) for t in cat.values()] == [6, 0, 0]
    got = {(",".join(a), b, k) for a, b, _, k, _ in S.schema_fds(cat)}
    assert ("slot,visit_id", "grade", "pk") in got and ("log_key", "visit_id", "unique") in got
    assert ("station_id", "height", "fk") in got and ("visit_id", "mean_rain", "fk") in got
    loose = catalog.from_ddl("CREATE TABLE t (k INT PRIMARY KEY, u INT UNIQUE, v INT); CREATE TABLE c (v INT REFERENCES t(u))")
    assert {x[3] for x in S.schema_fds(loose)} == {"pk", "unique_nullable"}  # a reference to no key says nothing


def test_network_obeys_its_checks(spark):
    from tesserae.operators.integrity import load_rules, violation_counts

    rows, left = S.check_atoms(spark, catalog.from_ddl(NETWORK_DDL))
    assert len(rows) == 9 and not left
    made = network(spark)
    out = violation_counts(made["Station"], load_rules(rows)).collect()
    assert len(out) == 6 and all(r["violated"] == 0 and r["guarded"] > 0 for r in out)
    assert made["Visit"].count() == 4000 and 4000 < made["Gauge"].count() < 24000


def test_foreign_ddl():
    sql = "CREATE TABLE `p` (`id` int(11) NOT NULL AUTO_INCREMENT, `k` enum('a','b') DEFAULT NULL, `t` datetime, PRIMARY KEY (`id`), KEY `ix` (`k`)) ENGINE=InnoDB DEFAULT CHARSET=utf8;"
    got = catalog.from_ddl(catalog.normalize_ddl(sql))["p"]
    assert got.columns == ("id", "k", "t") and got.primary_key == ("id",)
