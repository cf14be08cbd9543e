"""Queries of the relational operators. Sums run over decimals, so that results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import relational as R
from tesserae.plans.dialect import run

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both(name: str, sql: str, tables: str):
    """A query in the wider dialect, run as it is by both engines."""

    def f(spark, sf_dir):
        return run(spark, sql, {t: table(spark, sf_dir, t) for t in tables.split()})

    f.__name__ = name
    QUERIES[name], ORACLES[name] = f, sql


both("tpch_supplier_profile", """
SELECT s.s_suppkey AS suppkey, s.s_acctbal AS supp_acctbal, n.n_name AS supp_nation, r.r_name AS supp_region,
  COUNT(l.l_orderkey) AS n_lineitems, COUNT(DISTINCT l.l_orderkey) AS n_orders,
  COUNT(DISTINCT o.o_custkey) AS n_customers, COUNT(DISTINCT l.l_partkey) AS n_parts,
  CAST(SUM(CAST(ROUND(l.l_extendedprice, 4) AS DECIMAL(18,4))) AS DOUBLE) AS gross_extendedprice,
  CAST(SUM(CAST(ROUND(l.l_extendedprice * (1 - l.l_discount), 4) AS DECIMAL(18,4))) AS DOUBLE) AS revenue_net,
  ROUND(CAST(SUM(CAST(l.l_discount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 6) AS avg_discount,
  ROUND(CAST(SUM(CAST(l.l_tax AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 6) AS avg_tax,
  ROUND(CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 6) AS avg_quantity,
  ROUND(CAST(SUM(CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS BIGINT)) AS DOUBLE) / COUNT(*), 6) AS avg_ship_delay_days,
  ROUND(CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS return_rate,
  ROUND(CAST(SUM(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS frac_urgent,
  ROUND(CAST(SUM(CASE WHEN o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS frac_high,
  ROUND(CAST(SUM(CASE WHEN o.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS frac_low
FROM supplier s
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
JOIN lineitem l ON l.l_suppkey = s.s_suppkey
JOIN orders o ON o.o_orderkey = l.l_orderkey
GROUP BY s.s_suppkey, s.s_acctbal, n.n_name, r.r_name
ORDER BY s.s_suppkey
""", "supplier nation region lineitem orders")

both("top_item_per_order", """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, l.l_partkey AS top_partkey, l.l_extendedprice AS top_price,
  COUNT(*) OVER (PARTITION BY o.o_orderkey) AS n_items,
  CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY o.o_orderkey) AS DOUBLE) AS total_qty,
FROM orders AS o
JOIN customer AS c ON o.o_custkey = c.c_custkey
JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey
WHERE o.o_totalprice >= 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY o.o_orderkey
  ORDER BY l.l_extendedprice DESC, l.l_linenumber ASC, l.l_partkey ASC, l.l_suppkey ASC, l.l_quantity ASC) = 1
""", "orders customer lineitem")

both("order_windows_by_alias", """
SELECT o.o_orderkey, o.o_orderstatus, t.top_partkey, t.n_items, t.n_parts, t.n_suppliers, t.max_qty, t.sum_price,
  CASE WHEN t.last_ship > o.o_orderdate THEN 1 ELSE 0 END AS is_late
FROM orders o
LEFT JOIN (
  SELECT l.l_orderkey, l.l_partkey AS top_partkey,
    COUNT(*) OVER (PARTITION BY l.l_orderkey) AS n_items,
    COUNT(DISTINCT l.l_partkey) OVER (PARTITION BY l.l_orderkey) AS n_parts,
    COUNT(DISTINCT l.l_suppkey) OVER (PARTITION BY l.l_orderkey) AS n_suppliers,
    MAX(l.l_quantity) OVER (PARTITION BY l.l_orderkey) AS max_qty,
    MAX(l.l_shipdate) OVER (PARTITION BY l.l_orderkey) AS last_ship,
    CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l.l_orderkey) AS DOUBLE) AS sum_price,
    ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_extendedprice DESC, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity) AS rn
  FROM lineitem AS l
  WHERE l.l_orderkey IS NOT NULL
  QUALIFY rn = 1
) AS t ON o.o_orderkey = t.l_orderkey
WHERE o.o_orderstatus <> 'P'
""", "orders lineitem")

both("top_part_per_brand", """
SELECT p.p_partkey, p.p_brand, p.p_size, t.top_partkey, t.top_price
FROM part AS p
LEFT JOIN (
  SELECT q.p_brand AS brand, q.p_partkey AS top_partkey, q.p_retailprice AS top_price
  FROM part AS q
  QUALIFY ROW_NUMBER() OVER (PARTITION BY q.p_brand ORDER BY q.p_retailprice DESC, q.p_partkey ASC) = 1
) AS t ON p.p_brand = t.brand
""", "part")

both("role_join_nations", """
SELECT c.c_custkey, s.s_suppkey, cn.n_name AS customer_nation, sn.n_name AS supplier_nation, COUNT(*) AS n_lines,
  COUNT(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_orderkey END) AS n_returned_orders,
  COUNT(DISTINCT CASE WHEN l.l_discount > 0.05 THEN l.l_orderkey END) AS n_discounted_orders
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation cn ON cn.n_nationkey = c.c_nationkey
JOIN nation sn ON sn.n_nationkey = s.s_nationkey
GROUP BY c.c_custkey, s.s_suppkey, cn.n_name, sn.n_name
""", "lineitem orders customer supplier nation")

both("pivot_by_constant_joins", """
WITH period AS (SELECT 'A' AS period UNION ALL SELECT 'N' UNION ALL SELECT 'R'),
use AS (SELECT l_suppkey, l_returnflag AS period, COUNT(*) AS n, MAX(l_quantity) AS most FROM lineitem GROUP BY l_suppkey, l_returnflag)
SELECT s.s_suppkey, s.s_name, a.n AS n_a, a.most AS most_a, b.n AS n_n, b.most AS most_n, c.n AS n_r, c.most AS most_r
FROM supplier AS s
LEFT JOIN period AS pa ON pa.period = 'A' LEFT JOIN use AS a ON a.l_suppkey = s.s_suppkey AND a.period = pa.period
LEFT JOIN period AS pb ON pb.period = 'N' LEFT JOIN use AS b ON b.l_suppkey = s.s_suppkey AND b.period = pb.period
LEFT JOIN period AS pc ON pc.period = 'R' LEFT JOIN use AS c ON c.l_suppkey = s.s_suppkey AND c.period = pc.period
""", "supplier lineitem")

both("using_join_and_anti", """
SELECT n_name, n_suppliers, n_customers FROM (
  SELECT n_nationkey, n_name FROM nation
) JOIN (SELECT s_nationkey AS n_nationkey, COUNT(*) AS n_suppliers FROM supplier GROUP BY s_nationkey) USING (n_nationkey)
  JOIN (SELECT c_nationkey AS n_nationkey, COUNT(*) AS n_customers FROM customer GROUP BY c_nationkey) USING (n_nationkey)
""", "nation supplier customer")

both("timestamp_arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days,
  CASE WHEN l_shipdate - o_orderdate > INTERVAL '30' DAY THEN 1 ELSE 0 END AS over_month
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL
""", "lineitem orders")

both("having_distinct", """
SELECT p_brand, COUNT(DISTINCT p_type) AS n_types, COUNT(DISTINCT p_size) AS n_sizes FROM part
GROUP BY p_brand HAVING COUNT(DISTINCT p_type) > 1
""", "part")

both("union_distinct_keys", """
SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation
""", "supplier customer nation")

both("scalar_functions", """
SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size_d, p_partkey::BIGINT AS big, TRY_CAST(p_brand AS INTEGER) AS no_number, TRIM(p_name) AS name,
  ABS(p_size - 25) AS off, CAST(CEIL(p_retailprice) AS BIGINT) AS up, p_retailprice * (1 - 0.05) AS net,
  CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE NULL END AS class, p_type IS NULL AS no_type, COALESCE(NULLIF(p_type, 'x'), '-') AS kind
FROM part WHERE p_size IN (1, 5, 20, 41) AND p_brand IS NOT NULL
""", "part")

both("view_and_any_value", """
WITH v AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer)
SELECT v.c_nationkey, MIN(v.c_mktsegment) AS any_segment, COUNT(*) AS n, COUNT(v.balance) AS n_balance, MAX(v.balance) AS most,
  CAST(SUM(CAST(v.balance AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean_balance
FROM v GROUP BY v.c_nationkey
""", "customer")

both("sort_limit_nulls_last", """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status
FROM orders ORDER BY status DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 100
""", "orders")


@query("""
SELECT l_orderkey, 'quantity' AS measure, l_quantity AS amount, l_linenumber AS line FROM lineitem
UNION ALL SELECT l_orderkey, 'price', l_extendedprice, l_linenumber FROM lineitem
UNION ALL SELECT l_orderkey, 'tax', l_tax, l_linenumber FROM lineitem
""")
def unpivot_measures(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    groups = {"quantity": "l_quantity", "price": "l_extendedprice", "tax": "l_tax"}
    return R.unpivot(df, ["l_orderkey"], {k: {"amount": c, "line": "l_linenumber"} for k, c in groups.items()}, "measure")


@query("""
SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS n_check,
  max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A_l_quantity", max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "R_l_quantity"
FROM lineitem GROUP BY l_suppkey
""")
def pivot_returns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    wide = R.pivot_back(df, ["l_suppkey"], "l_returnflag", ["A", "R"], ["l_quantity"])
    n = df.groupBy("l_suppkey").agg(F.count(F.when(F.expr("l_linestatus = 'F' and l_returnflag = 'A'"), 1)).alias("n_check"))
    return wide.join(n, "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_line_keys(spark, sf_dir):
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1
""")
def first_line_per_key(spark, sf_dir):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return R.keep_first(table(spark, sf_dir, "lineitem").select(*cols), cols[:2], [F.col(c) for c in cols[2:]])


@query("""
SELECT 'orders.o_custkey' AS fk, count(*) AS n_violations FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'events.user_id', count(*) FROM events e WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id)
""")
def fk_violation_report(spark, sf_dir):
    checks = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "supplier", "s_suppkey")]
    parts = [R.fk_violations(table(spark, sf_dir, c), table(spark, sf_dir, p), [k], [q]).withColumn("fk", F.lit(f"{c}.{k}")) for c, k, p, q in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Price classes of the nearest-interval query: id, label, bounds and whether they belong to it (fixed values).
PRICE_RULES = ((1, "[900-1100]", 900.0, 1100.0, True, True), (2, "(1200-1500]", 1200.0, 1500.0, False, True), (3, "[1600-1700)", 1600.0, 1700.0, True, False))


@query(f"""
WITH rules(rule_id, label, lo, hi, li, hinc) AS (VALUES {", ".join(str(r) for r in PRICE_RULES)}),
m AS (SELECT p_partkey, p_retailprice AS v, r.*, (CASE WHEN li THEN p_retailprice >= lo ELSE p_retailprice > lo END) AND (CASE WHEN hinc THEN p_retailprice <= hi ELSE p_retailprice < hi END) AS inside FROM part, rules r)
SELECT p_partkey, label AS bucket FROM m
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE least(abs(v - lo), abs(v - hi)) END, lo, rule_id) = 1
""")
def nearest_bucket_price(spark, sf_dir):
    rules = spark.createDataFrame(list(PRICE_RULES), "rule_id int, label string, lo double, hi double, lo_inclusive boolean, hi_inclusive boolean")
    return R.nearest_bucket(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", rules, "bucket").drop("p_retailprice")


@query("SELECT p_partkey, CASE WHEN p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.5) FROM part) THEN 1 ELSE 0 END AS high FROM part")
def median_split_label(spark, sf_dir):
    return R.median_label(table(spark, sf_dir, "part"), "p_retailprice", "high").select("p_partkey", "high")


@query("""
WITH q AS (SELECT quantile_cont(s_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM supplier)
SELECT s_suppkey, CASE WHEN s_acctbal <= e[2] THEN 0 WHEN s_acctbal <= e[3] THEN 1 WHEN s_acctbal <= e[4] THEN 2 ELSE 3 END AS risk FROM supplier, q
""")
def quartile_risk_label(spark, sf_dir):
    return R.quantile_label(table(spark, sf_dir, "supplier"), "s_acctbal", "risk", 4).select("s_suppkey", "risk")


@query("SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS brand_code FROM part")
def brand_codes(spark, sf_dir):
    return R.dense_codes(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "brand_code")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def priority_mode(spark, sf_dir):
    return R.mode_value(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CAST('0x' || substr(md5('2026:' || c_custkey), 1, 8) AS BIGINT), c_custkey) AS i,
  count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN i <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r
""")
def stratified_split(spark, sf_dir):
    return R.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.2, 2026)


@query("SELECT o_orderkey FROM orders ORDER BY CAST('0x' || substr(md5('7:' || o_orderkey), 1, 8) AS BIGINT), o_orderkey LIMIT 200")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200, 7)


@query(f"SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('7:' || o_orderkey), 1, 8) AS BIGINT) < {int(0.025 * 2**32)}")
def fraction_sample(spark, sf_dir):
    return R.fraction_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.025, 7)


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem)
SELECT a.l_partkey AS id, list_sort(list(DISTINCT b.l_partkey)) AS partners
FROM d a JOIN d b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus
  AND a.l_discount IS NOT DISTINCT FROM b.l_tax AND a.l_tax IS NOT DISTINCT FROM b.l_discount AND a.l_partkey <> b.l_partkey GROUP BY 1
""")
def reciprocal_match(spark, sf_dir):
    """Parts of one supplier, in lines of the same state, with discount and tax exchanged."""
    keep = ["l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), *keep).distinct()
    return R.reciprocal_partners(df, "id", keep[:3], [("l_discount", "l_tax")])


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return R.exclude(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_discount > 0.05 AND l_quantity > 40 THEN 0.05 ELSE l_discount END AS l_discount FROM lineitem
""")
def conditional_updates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = R.conditional_update(df, [("l_tax", F.expr("l_returnflag = 'N'"), F.lit(None)), ("l_discount", F.expr("l_discount > 0.05 and l_quantity > 40"), F.lit(0.05))])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")


@query("""
WITH e AS (SELECT DISTINCT event_type, user_id % 10 AS u FROM events)
SELECT event_type, string_agg(CAST(u AS VARCHAR), '|' ORDER BY u) AS users FROM e GROUP BY event_type
""")
def token_lists(spark, sf_dir):
    from tesserae.functions.scalars import sorted_tokens

    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_join(F.collect_set((F.col("user_id") % 10).cast("string")), " | ").alias("raw"))
    return e.select("event_type", sorted_tokens(F.col("raw")).alias("users"))


@query("SELECT row_number() OVER (ORDER BY c_mktsegment NULLS LAST, c_custkey) AS id, c_mktsegment, c_custkey FROM customer")
def surrogate_ids(spark, sf_dir):
    return R.surrogate_ids(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"], "id")


@query("""
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus FROM orders o
WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND (CASE WHEN c.c_acctbal < 0 THEN 'F' ELSE 'O' END) = o.o_orderstatus)
""")
def rows_in_other_frame(spark, sf_dir):
    """Orders whose (customer, status) is a row of another frame."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, "F").otherwise("O").alias("o_orderstatus"))
    return R.matching_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), c.distinct())


@query("""
SELECT s_suppkey, s_name, n_parts FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1) USING (s_suppkey)
""")
def one_to_one_merge(spark, sf_dir):
    many = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("n_parts"))
    return R.merge_one_to_one(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), many, ["s_suppkey"])


@query("SELECT n_nationkey, n_name, r_name, row_number() OVER (ORDER BY r_name DESC, n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def restored_order(spark, sf_dir):
    """Nations in the order of a list of keys; `place` is where each row came out."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    by_region = named.select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("r_name"), "n_name")).alias("ordinal"))  # 25 rows
    return R.in_key_order(named, by_region, "n_nationkey").withColumn("place", F.monotonically_increasing_id() + 1).coalesce(1)


@query("""
SELECT n_nationkey, coalesce(n, 0) AS n_suppliers, coalesce(most, 0.0) AS most FROM nation
LEFT JOIN (SELECT s_nationkey, count(*) AS n, max(CASE WHEN s_acctbal >= 0 THEN s_acctbal END) AS most FROM supplier WHERE s_acctbal < 5000 GROUP BY 1) ON s_nationkey = n_nationkey
""")
def nulls_as_zero(spark, sf_dir):
    """A left join's gaps filled with 0."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 5000").groupBy(F.col("s_nationkey").alias("n_nationkey"))
    per = s.agg(F.count("*").alias("n_suppliers"), F.max(F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))).alias("most"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(per, "n_nationkey", "left").fillna(0, ["n_suppliers", "most"])


@query("""
WITH l AS (SELECT DISTINCT '[' || CAST(p_size - p_size % 5 AS VARCHAR) || '-' || CAST(p_size - p_size % 5 + 4 AS VARCHAR) || CASE WHEN p_size >= 25 THEN ')' ELSE ']' END AS label FROM part),
b AS (SELECT label, CAST(regexp_extract(label, '([0-9]+)-', 1) AS DOUBLE) AS lo, CAST(regexp_extract(label, '-([0-9]+)', 1) AS DOUBLE) AS hi, label LIKE '%]' AS hi_inclusive FROM l)
SELECT CAST(row_number() OVER (ORDER BY lo, hi, label) AS INTEGER) AS rule_id, label, lo, hi, true AS lo_inclusive, hi_inclusive FROM b
""")
def bucket_rules_of_labels(spark, sf_dir):
    """Interval rules read from a column's labels."""
    low = F.col("p_size") - F.col("p_size") % 5
    label = F.concat(F.lit("["), low.cast("string"), F.lit("-"), (low + 4).cast("string"), F.when(F.col("p_size") >= 25, ")").otherwise("]"))
    rules = R.bucket_rules(table(spark, sf_dir, "part").select(label.alias("size_band"), "p_size"), "size_band", "p_size")
    return rules.drop("bucket_col", "base_col")


@query("SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal) FROM customer")
def star_with_same_name(spark, sf_dir):
    sql = "SELECT *, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, FROM customer"
    return run(spark, sql, {"customer": table(spark, sf_dir, "customer")})
