"""Queries of coalitions, provenance, attribution and models. Scores are whole numbers, so that sums are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import canonical
from tesserae.operators import attribution as A
from tesserae.operators import coalitions as C
from tesserae.operators import models as M
from tesserae.operators import provenance as P
from tesserae.operators.relational import seeded_sample, stratified_split
from tesserae.plans.q_relational import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FEATURES = ["qty", "disc", "tax", "size"]
#: disc tells tax, and qty with disc tells size: rules of the closed queries.
RULES = [(("disc",), "tax"), (("qty", "disc"), "size")]


#: Background rows of the queries, which explain every part.
BACKGROUND = 16


def _numbers(spark, sf_dir):
    """Parts as rows of small whole numbers."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") * 7 % 50).cast("int").alias("qty"), (F.col("p_size") % 11).cast("int").alias("disc"), (F.length("p_name") % 9).cast("int").alias("tax"), F.col("p_size").cast("int").alias("size"))


def every_part(spark, sf_dir):
    """All rows to explain, and a seeded sample of BACKGROUND of them as background, whatever the table's size."""
    p = _numbers(spark, sf_dir)
    return p, seeded_sample(p, "row_id", BACKGROUND, 2026)


_PARTS = f"""p AS (SELECT p_partkey AS row_id, CAST(p_partkey * 7 % 50 AS INTEGER) AS qty, p_size % 11 AS disc, CAST(length(p_name) % 9 AS INTEGER) AS tax, p_size AS size, p_brand AS brand FROM part),
e AS (SELECT * FROM p), b AS (SELECT * FROM p ORDER BY CAST('0x' || substr(md5('2026:' || row_id), 1, 8) AS BIGINT), row_id LIMIT {BACKGROUND})"""


def score(x):
    return (2 * x["qty"] + F.when((x["disc"] > 5) & (x["qty"] > 25), 100).otherwise(0) - 3 * x["tax"] * F.when(x["size"] > 20, 1).otherwise(0)).cast("double")


def _values(masks: str) -> str:
    """v(row_id, mask, value) for masks (row_id, mask)."""
    pick = lambda f, i: f"CASE WHEN m.mask & {1 << i} <> 0 THEN e.{f} ELSE b.{f} END AS {f}"
    return f"""v AS (SELECT row_id, mask, avg(CAST(2 * qty + CASE WHEN disc > 5 AND qty > 25 THEN 100 ELSE 0 END - 3 * tax * CASE WHEN size > 20 THEN 1 ELSE 0 END AS DOUBLE)) AS value
FROM (SELECT m.row_id, m.mask, {", ".join(pick(f, i) for i, f in enumerate(FEATURES))} FROM {masks} m JOIN e ON e.row_id = m.row_id, b) GROUP BY row_id, mask)"""


_ALL = "a AS (SELECT row_id, mask FROM e, (SELECT unnest(range(16)) AS mask))"
_CANON = "(mask | CASE WHEN mask & 2 = 2 THEN 4 ELSE 0 END | CASE WHEN mask & 3 = 3 THEN 8 ELSE 0 END)"
_FACT = "list_value(1, 1, 2, 6, 24)"


def _phi(joined: str) -> str:
    one = lambda i, f: f"SELECT row_id, '{f}' AS feature, sum(CASE WHEN mask & {1 << i} <> 0 THEN f[bit_count(mask)] * f[5 - bit_count(mask)] ELSE -f[bit_count(mask) + 1] * f[4 - bit_count(mask)] END * value) / 24.0 AS phi FROM {joined}, (SELECT {_FACT} AS f) GROUP BY row_id"
    return "\nUNION ALL ".join(one(i, f) for i, f in enumerate(FEATURES))


@query(f"SELECT {_CANON} AS canon, count(*) AS n_masks FROM (SELECT unnest(range(16)) AS mask) GROUP BY 1")
def coalition_classes(spark, sf_dir):
    return C.classes(C.all_masks(spark, 4), C.rule_masks(RULES, FEATURES))


@query("SELECT CAST(bit_count(m) AS INTEGER) AS size, count(*) AS n FROM (SELECT unnest(range(1024)) AS m) GROUP BY 1")
def coalition_size_hist(spark, sf_dir):
    return C.size_histogram(C.all_masks(spark, 10))


@query(f"WITH {_PARTS}, {_ALL}, {_values('a')} SELECT * FROM v")
def value_function(spark, sf_dir):
    e, b = every_part(spark, sf_dir)
    masks = e.select("row_id").join(F.broadcast(C.all_masks(spark, 4)), F.lit(True), "inner")
    return A.values(e, "row_id", masks, b, FEATURES, score)


@query(f"WITH {_PARTS}, {_ALL}, {_values('a')} {_phi('v')}")
def shapley_exact(spark, sf_dir):
    e, b = every_part(spark, sf_dir)
    return A.exact(e, "row_id", b, FEATURES, score)


@query(f"WITH {_PARTS}, {_ALL}, c AS (SELECT row_id, mask AS m0, {_CANON} AS mask FROM a), d AS (SELECT DISTINCT row_id, mask FROM c), {_values('d')}, j AS (SELECT c.row_id, m0 AS mask, value FROM c JOIN v ON v.row_id = c.row_id AND v.mask = c.mask) {_phi('j')}")
def shapley_fd_closed(spark, sf_dir):
    e, b = every_part(spark, sf_dir)
    return A.exact(e, "row_id", b, FEATURES, score, C.rule_masks(RULES, FEATURES))


@query(f"WITH {_PARTS}, {_ALL}, {_values('a')}, s AS ({_phi('v')}) SELECT row_id, feature, round(phi, 5) + 0.0 AS phi FROM s")
def shapley_by_regression(spark, sf_dir):
    e, b = every_part(spark, sf_dir)
    return A.regression(e, "row_id", b, FEATURES, score).withColumn("phi", F.round("phi", 5) + 0.0)


#: disc and qty of a part that one brand alone has tell its size.
_CANDIDATES = """w AS (SELECT DISTINCT disc, qty, brand FROM p),
n AS (SELECT a.row_id, a.mask, count(DISTINCT w.brand) AS n FROM a JOIN e ON e.row_id = a.row_id JOIN w ON (a.mask & 1 = 0 OR w.qty IS NOT DISTINCT FROM e.qty) AND (a.mask & 2 = 0 OR w.disc IS NOT DISTINCT FROM e.disc) WHERE a.mask & 3 <> 0 GROUP BY ALL),
c AS (SELECT a.row_id, a.mask AS m0, CASE WHEN a.mask & 3 = 3 AND n.n = 1 THEN a.mask | 8 ELSE a.mask END AS mask FROM a LEFT JOIN n ON n.row_id = a.row_id AND n.mask = a.mask), d AS (SELECT DISTINCT row_id, mask FROM c)"""


@query(f"WITH {_PARTS}, {_ALL}, {_CANDIDATES}, {_values('d')}, j AS (SELECT c.row_id, m0 AS mask, value FROM c JOIN v ON v.row_id = c.row_id AND v.mask = c.mask) {_phi('j')}")
def shapley_by_provenance(spark, sf_dir):
    """Coalitions are widened where the values in them single out one brand."""
    e, b = every_part(spark, sf_dir)
    brands = e.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), "p_brand"), "row_id").select("p_brand", "qty", "disc").distinct()
    canon = P.canon_by_provenance(e, "row_id", brands, "p_brand", FEATURES, [(("qty", "disc"), ("size",))])
    return A.exact(e, "row_id", b, FEATURES, score, canon=canon)


@query()
def shapley_monte_carlo(spark, sf_dir):
    e, b = every_part(spark, sf_dir)
    return A.monte_carlo(e, "row_id", b, FEATURES, score, n=100, seed=2026, closure=C.rule_masks(RULES, FEATURES))


@query()
def shapley_leverage_budget(spark, sf_dir):
    e, b = every_part(spark, sf_dir)
    return A.regression(e, "row_id", b, FEATURES, score, samples=8, seed=2026, closure=C.rule_masks(RULES, FEATURES), max_skips=100)


@query("""
WITH i AS (SELECT DISTINCT n_regionkey AS id, 'first' AS feature, CAST(substr(n_name, 1, 1) AS VARCHAR) AS value FROM nation UNION SELECT DISTINCT n_regionkey, 'long', CAST(length(n_name) AS VARCHAR) FROM nation),
q AS (SELECT n_nationkey AS key, 'first' AS feature, substr(n_name, 1, 1) AS value FROM nation UNION ALL SELECT n_nationkey, 'long', CAST(length(n_name) AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0),
n AS (SELECT key, count(*) AS n FROM q GROUP BY key)
SELECT q.key, i.id FROM q JOIN i ON q.feature = i.feature AND CASE WHEN lower(q.value) IN ('1', 't', 'y') THEN 'true' WHEN lower(q.value) IN ('0', 'f', 'n') THEN 'false' ELSE q.value END = CASE WHEN lower(i.value) IN ('1', 't', 'y') THEN 'true' WHEN lower(i.value) IN ('0', 'f', 'n') THEN 'false' ELSE i.value END JOIN n ON n.key = q.key GROUP BY q.key, i.id, n.n HAVING count(*) = n.n""")
def provenance_candidates(spark, sf_dir):
    n, index, asked = _provenance(spark, sf_dir)
    return P.candidates(index, asked)


def _provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.substring("n_name", 1, 1).alias("first"), F.length("n_name").alias("long"))
    index = P.inverted_index(n, "n_regionkey", ["first", "long"])
    asked = n.select(F.col("n_nationkey").alias("key"), F.lit("first").alias("feature"), canonical(F.col("first")).alias("value"))
    asked = asked.union(n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("long"), canonical(F.col("long").cast("string"))))
    return n, index, asked


@query("""
WITH x AS (SELECT n_nationkey AS key, n_regionkey AS id, substr(n_name, 1, 1) AS first FROM nation),
c AS (SELECT a.key, count(DISTINCT b.id) AS n FROM x a JOIN x b ON a.first = b.first GROUP BY a.key)
SELECT key, CAST(1 AS BIGINT) AS mask, n AS n_candidates, CAST(CASE WHEN n = 1 THEN 5 ELSE 1 END AS BIGINT) AS expanded FROM c""")
def provenance_expand(spark, sf_dir):
    n, index, _ = _provenance(spark, sf_dir)
    asked = n.select(F.col("n_nationkey").alias("key"), F.lit("first").alias("feature"), canonical(F.col("first")).alias("value"))
    masks = n.select(F.col("n_nationkey").alias("key"), F.lit(1).cast("long").alias("mask"))
    return P.expand(masks, P.candidates(index, asked), index, ["first", "long", "region"], [(("first",), ("region",))])


@query("""
WITH d AS (SELECT CAST(quality AS INTEGER) AS y, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS p FROM labels),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn FROM d)
SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(fp AS DOUBLE) / (fp + tn) AS fpr, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), (F.col("toxic") == 0).cast("int").alias("p"))
    return M.confusion(d, "y", "p")


@query("""
WITH d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS s FROM lineitem),
g AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM d GROUP BY s),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM g)
SELECT CAST(sum(pos * (2 * less + neg)) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc FROM w""")
def auc_by_rank(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("s"))
    return M.auc(d, "y", "s")


@query()
def model_scores(spark, sf_dir):
    """Test accuracy of a logistic model of urgent orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).cast("int").alias("label"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    d = stratified_split(o, "o_orderkey", "label", 0.2, 2026)
    keep = ["label", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    model = M.train(d.filter("split = 'train'").select(*keep), "label", "logreg", maxIter=10)
    return M.confusion(M.scored(model, d.filter("split = 'test'").select(*keep)), "label", "prediction")


@query("""
WITH t AS (SELECT event_id, trim(regexp_extract(props, ':\\s*(.*)\\}', 1)) AS v FROM events)
SELECT event_id, CASE WHEN v IN ('', 'nan') THEN NULL WHEN regexp_replace(v, '^([+-]?[0-9]+)\\.0*$', '\\1') IN ('true', 't', '1', 'yes', 'y') THEN 'true' WHEN regexp_replace(v, '^([+-]?[0-9]+)\\.0*$', '\\1') IN ('false', 'f', '0', 'no', 'n') THEN 'false' ELSE regexp_replace(v, '^([+-]?[0-9]+)\\.0*$', '\\1') END AS canon FROM t""")
def canonical_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", canonical(F.regexp_extract("props", r":\s*(.*)\}", 1)).alias("canon"))
