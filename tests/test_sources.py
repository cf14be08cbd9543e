from pyspark.sql import functions as F

from tesserae.functions import scalars as V
from tesserae.operators import relational as R
from tesserae.plans import workflow as W
from tesserae.sources import catalog, sinks, tables
from tesserae.sources.config import Config, load


def test_numbers_are_found_again(spark):
    df = spark.createDataFrame([("1", "1.5", "x", " 7 ", None), ("2", "nan", "3", "", None)], "a string, b string, c string, d string, e string")
    out = tables.as_numbers(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "bigint", "e": "string"}
    assert [tuple(r) for r in out.collect()] == [(1, 1.5, "x", 7, None), (2, None, "3", None, None)]
    assert tables.without_nan(spark.createDataFrame([(float("nan"),)], "x double")).first()["x"] is None


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"q')], "k int, t string")
    sinks.write_flat(df, f"{tmp_path}/flat", "csv")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/flat").collect())) == [(1, "a,b"), (2, 'q"q')]
    (tmp_path / "fd_add.csv").write_text('lhs,rhs\n"z, y",w\n')
    sinks.write_fds(spark.createDataFrame([(["b", "a"], "c,d")], "lhs array<string>, rhs string"), f"{tmp_path}/fd.csv")
    got = {(",".join(r["lhs"]), r["rhs"]) for r in tables.read_fds(spark, f"{tmp_path}/fd.csv").collect()}
    assert got == {("a,b", "c"), ("a,b", "d"), ("y,z", "w")}
    left = tables.without_excluded(tables.read_fds(spark, f"{tmp_path}/fd.csv"), [tables.read_fds(spark, f"{tmp_path}/fd_add.csv")])
    assert left.count() == 2
    atoms = spark.createDataFrame([("data", c, 0, "a", "=", "1", "b", "IN", ["x", "y"]) for c in (1, 2)], "source string, cid int, group_id int, lhs string, op string, value string, rhs string, domain_op string, domain_value array<string>")
    sinks.write_atoms(atoms, f"{tmp_path}/atoms.csv")
    assert tables.read_csv(spark, f"{tmp_path}/atoms.csv").count() == 1
    sinks.write_denials(spark, [{"kind": "onehot_m", "cols": "a,b", "k": 1, "parity_bit": None}, {"kind": "parity", "cols": "c,d", "k": None, "parity_bit": 0}], f"{tmp_path}/d.csv")
    assert sorted(r["kind"] for r in tables.read_csv(spark, f"{tmp_path}/d.csv").collect()) == ["onehot", "xor"]
    for _ in range(2):
        sinks.append_closures(spark.createDataFrame([(["a"], ["a", "b"])], "seed array<string>, closure array<string>"), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 1
    (tmp_path / "q.sql").write_text("SELECT 1 AS x,\nFROM t")
    assert tables.read_sql(spark, f"{tmp_path}/q.sql") == "SELECT 1 AS x,\nFROM t"
    (tmp_path / "c.yaml").write_text("LABEL_COL: [y]\nMAX_LHS_SIZE: 1\n")
    assert load(f"{tmp_path}/c.yaml").max_lhs_size == 1


def test_canonical_values(spark):
    texts = ["3.0", "3", " yes ", "T", "NaN", None, "0", "1.50", "", "1.0", "-2.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(V.canonical(F.col("t"))).collect()] == ["3", "3", "true", "true", None, None, "false", "1.50", None, "true", "-2"]
    assert [r[0] for r in df.select(V.as_bit(F.col("t"))).collect()] == [None, None, 1, 1, None, None, 0, None, None, 1, None]
    assert [r[0] for r in df.select(V.as_number(F.col("t"))).collect()][:2] == [3.0, 3.0]


def test_small_functions(spark):
    one = spark.range(1)
    b = one.select(V.interval_bounds(F.lit("(3-5.5]")).alias("b"), V.interval_bounds(F.lit("x")).alias("n"), V.interval_bounds(F.lit("[.5-+3)")).alias("s")).first()
    assert tuple(b["b"]) == (3.0, 5.5, False, True) and b["n"] is None and tuple(b["s"]) == (0.5, 3.0, True, False)
    assert one.select(V.normal_lhs(F.lit(' b, "a" ,,c'))).first()[0] == ["a", "b", "c"]
    assert V.columns_of(V.mask_of(["C", "a", "zz"], ["a", "b", "c"]), ["a", "b", "c"]) == ["a", "c"]
    p = V.id_name_pattern(["id", "code"])
    assert [bool(p.search(x)) for x in ("ID", "row_id", "paid", "zip_Code")] == [True, True, False, True]
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    edges = V.quantile_edges(df, "x", 2)
    assert edges == [0, 5, 10] and [r[0] for r in df.select(V.bin_of(F.col("x"), edges)).collect()] == [0] * 6 + [1] * 5


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 1), (3, "b", None)], "k int, t string, v int")
    assert R.matching_rows(df, df.select("t", "v").filter("v is null")).count() == 2
    assert R.exclude(df, df.filter("v is null"), ["t", "v"]).count() == 1
    assert [r["code"] for r in R.dense_codes(df, "t", "code").orderBy("k").collect()] == [1, 0, 1]
    try:
        R.merge_one_to_one(df, df, ["t"])
        raise AssertionError
    except ValueError:
        pass
    assert R.merge_one_to_one(df, df.select("k", F.lit(1).alias("z")), ["k"]).count() == 3
    order = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "k int, ordinal int")
    assert [r["k"] for r in R.in_key_order(df, order, "k").collect()] == [3, 1, 2]
    assert R.mode_value(df, "t").first()["value"] == "b"
    labels = spark.createDataFrame([("[1-3]",), ("(3-9]",), ("odd",)], "b string")
    assert [(r["lo"], r["hi"], r["lo_inclusive"]) for r in R.bucket_rules(labels, "b", "x").orderBy("rule_id").collect()] == [(1, 3, True), (3, 9, False)]


def test_wide_and_long_and_back(spark):
    rows = [(i, float(i), i * 2, float(i * 3), i + 7) for i in range(20)]
    wide = spark.createDataFrame(rows, "k int, day_min double, day_n int, eve_min double, eve_n int")
    long = R.unpivot(wide, ["k"], {p: {"min": f"{p}_min", "n": f"{p}_n"} for p in ("day", "eve")}, "period")
    back = R.pivot_back(long, ["k"], "period", ["day", "eve"], ["min", "n"]).select(*wide.columns)
    assert long.count() == 40 and back.exceptAll(wide).count() == 0 and wide.exceptAll(back).count() == 0


def test_the_whole_way(spark, tmp_path):
    t = tables.network(spark, 60, 300)
    flat = tables.noisy_label(t["Station"], "station_id", F.col("height") / 800).cache()
    config = Config(label_col=["y"], drop_cols=["station_id"], min_group_support=5, max_lhs_size=1, sample_n=40)
    assert "y" not in W.discovery_frame(flat, config, "full").columns and W.discovery_frame(flat, config, "train", "station_id").count() == 40
    found = W.mine(flat.drop("y", "station_id"), config, catalog.from_ddl(tables.NETWORK_DDL))
    pairs = {(",".join(r["lhs"]), r["rhs"]) for r in found.fds.collect()}
    assert {("height", "site"), ("soil", "climate"), ("station_id", "height")} <= pairs
    features = ["height", "site", "climate", "soil"]
    score = lambda v: v["height"] + F.when(v["climate"] == "wet", 20).otherwise(0).cast("double")
    x, z = flat.filter("station_id <= 4"), flat.filter("station_id > 40").limit(8)
    phi = W.explain(x, "station_id", z, features, score, found, "exact", repair=True)
    assert phi.count() == 16
    total = {r[0]: r[1] for r in phi.groupBy("station_id").agg(F.sum("phi")).collect()}
    assert len(total) == 4
    W.ship(spark, found, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/constraints").count() > 10
    sinks.write_attributions(phi, f"{tmp_path}/phi", {"seed": 1})
    assert spark.read.parquet(f"{tmp_path}/phi/phi").count() == 16
    # With provenance: what a height singles out tells the rest of its station, whatever the estimator.
    held = flat.select("station_id", *features)
    for estimator in ("exact", "monte_carlo", "leverage"):
        wide = W.explain(x, "station_id", z, features, score, found, estimator, samples=40, max_skips=50, entities=held, id_cols=["station_id"])
        assert wide.count() == 16


def test_rows_are_numbered_in_order(spark):
    from tesserae.sources.store import numbered

    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "k int, _place string").repartition(9)
    got = [(r["k"], r["n"], r["_place"]) for r in numbered(df, [F.col("k")], "n", 0).collect()]
    assert sorted(got) == [(i, i, "x") for i in range(1000)]
    assert numbered(df.limit(0), [F.col("k")], "n").count() == 0


def test_labels_of_any_size_are_split(spark):
    from tesserae.operators import models as M

    df = spark.createDataFrame([(i, "a" if i % 10 else None) for i in range(1000)], "k int, y string").repartition(7)
    out = R.stratified_split(df, "k", "y", 0.2, 5).groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in out} == {("a", "test"): 180, ("a", "train"): 720, (None, "test"): 20, (None, "train"): 80}
    again = M.folds(df, "k", "y", 3, 5).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in again} == {("a", 0): 300, ("a", 1): 300, ("a", 2): 300, (None, 0): 34, (None, 1): 33, (None, 2): 33}
    assert R.stratified_split(df.limit(0), "k", "y", 0.2, 5).count() == 0
