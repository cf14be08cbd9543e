"""Reading tables, queries and constraint files, and a synthetic weather network. Paths may be any that Spark opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalars import normal_lhs, seeded

#: The driver's tables (fixed values).
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with the schema given, or an inferred one, which costs a second reading. multi_line: values may hold line
    ends, at the cost that no file can be split."""
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def as_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a number, cast: whole numbers if all are. One aggregation for all columns;
    empty texts and NaN are null; columns of nulls alone stay text."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    aggs = []
    for c in texts:
        v = F.trim(F.col(c))
        x = F.when((v != "") & (F.lower(v) != "nan"), v)
        number = x.try_cast("double")
        aggs.append(F.struct(F.count(x).alias("n"), F.count(number).alias("num"), F.count(x.try_cast("bigint")).alias("int")).alias(c))
    got = df.agg(*aggs).first()
    kinds = {c: None if got[c]["n"] == 0 or got[c]["num"] < got[c]["n"] else "bigint" if got[c]["int"] == got[c]["n"] else "double" for c in texts}

    def cast(c: str, kind: str):
        x = F.trim(F.col(c)).try_cast(kind)
        return F.when(~F.isnan(x), x) if kind == "double" else x

    return df.withColumns({c: cast(c, k) for c, k in kinds.items() if k})


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def register_all(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    for n in names:
        register(spark.read.parquet(f"{sf_dir}/{n}.parquet"), n)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database; partition = (column, lower, upper, number) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(k, v)
    return reader.load()


def read_sql(spark: SparkSession, path: str) -> str:
    """Text of a query file."""
    return spark.read.text(path, wholetext=True).first()["value"]


def read_fds(spark: SparkSession, path: str) -> DataFrame:
    """(lhs array, rhs) of a CSV (lhs, rhs, ...): names trimmed, left sides sorted, right sides with commas split."""
    raw = spark.read.option("header", True).csv(path)
    if not {"lhs", "rhs"} <= set(raw.columns):
        raise ValueError("the file needs the columns lhs and rhs")
    out = raw.select(normal_lhs(F.col("lhs")).alias("lhs"), F.explode(F.split("rhs", ",")).alias("rhs")).withColumn("rhs", F.trim(F.regexp_replace("rhs", "[\"'`]", "")))
    return out.filter((F.col("rhs") != "") & (F.size("lhs") > 0)).distinct()


def without_excluded(fds: DataFrame, excluded: list[DataFrame]) -> DataFrame:
    """Dependencies that no exclusion list, as read_fds() returns it, names."""
    for e in excluded:
        fds = fds.join(e.select("lhs", "rhs"), ["lhs", "rhs"], "left_anti")
    return fds


#: Heights in metres and soils that a weather station's site has in the synthetic network.
SITES = {"coast": (0, 60), "plain": (61, 400), "ridge": (401, 2600)}
SOILS = {"dry": ("sand", "gravel"), "mild": ("loam", "clay", "chalk"), "wet": ("peat", "silt")}
#: Its declared structure.
NETWORK_DDL = """
CREATE TABLE Station (station_id INTEGER PRIMARY KEY, height INTEGER, site VARCHAR, climate VARCHAR, soil VARCHAR, sheltered BOOLEAN,
  CHECK (site <> 'coast' OR (height BETWEEN 0 AND 60)), CHECK (site <> 'plain' OR (height BETWEEN 61 AND 400)), CHECK (site <> 'ridge' OR (height BETWEEN 401 AND 2600)),
  CHECK (climate <> 'dry' OR soil IN ('sand', 'gravel')), CHECK (climate <> 'mild' OR soil IN ('loam', 'clay', 'chalk')), CHECK (climate <> 'wet' OR soil IN ('peat', 'silt')));
CREATE TABLE Visit (visit_id INTEGER PRIMARY KEY, log_key VARCHAR NOT NULL UNIQUE, station_id INTEGER REFERENCES Station(station_id), weekday INTEGER, mean_rain DOUBLE);
CREATE TABLE Gauge (visit_id INTEGER, slot INTEGER, grade VARCHAR, rain DOUBLE, hours INTEGER, PRIMARY KEY (visit_id, slot), FOREIGN KEY (visit_id) REFERENCES Visit(visit_id));
"""


def network(spark: SparkSession, stations: int = 500, visits: int = 4000, seed: int = 11) -> dict[str, DataFrame]:
    """Stations, visits and gauge readings of a synthetic weather network that obey its declared checks; every value
    follows from the row's number and the seed, in parallel."""
    draw = lambda key, what, many: seeded(F.concat_ws("/", key.cast("string"), F.lit(what)), seed) % many
    one_of = lambda key, what, options: F.element_at(F.array(*map(F.lit, options)), (draw(key, what, len(options)) + 1).cast("int"))
    by = lambda column, table, make: F.coalesce(*[F.when(F.col(column) == k, make(v)) for k, v in table.items()])
    i = F.col("id")
    s = spark.range(1, stations + 1).withColumns({"site": one_of(i, "site", list(SITES)), "climate": one_of(i, "climate", list(SOILS))})
    height = by("site", SITES, lambda v: draw(i, "height", v[1] - v[0] + 1) + v[0])
    station = s.select(i.cast("int").alias("station_id"), height.cast("int").alias("height"), "site", "climate", by("climate", SOILS, lambda v: one_of(i, "soil", v)).alias("soil"), (draw(i, "sheltered", 3) == 0).alias("sheltered"))
    v = spark.range(1, visits + 1)
    slots = v.select(i.alias("visit"), F.explode(F.sequence(F.lit(1), (draw(i, "slots", 6) + 1).cast("int"))).alias("slot"))
    key = F.concat_ws("/", F.col("visit").cast("string"), F.col("slot").cast("string"))
    gauge = slots.select(F.col("visit").cast("int").alias("visit_id"), "slot", one_of(key, "grade", ["A", "B"]).alias("grade"), (draw(key, "rain", 900) / 10).alias("rain"), (draw(key, "hours", 24) + 1).cast("int").alias("hours"))
    mean = gauge.groupBy("visit_id").agg(F.avg(F.col("rain").cast("decimal(10,1)")).cast("double").alias("mean_rain"))
    heads = v.select(i.cast("int").alias("visit_id"), F.sha1(i.cast("string")).alias("log_key"), (draw(i, "station", stations) + 1).cast("int").alias("station_id"), (draw(i, "weekday", 7) + 1).cast("int").alias("weekday"))
    return {"Station": station, "Visit": heads.join(mean, "visit_id"), "Gauge": gauge}


def noisy_label(df: DataFrame, key: str, score, out: str = "y", noise: float = 0.05, seed: int = 7) -> DataFrame:
    """1 where the score, a column in 0 to 1, exceeds one half, turned over in a seeded share of the rows."""
    flip = seeded(F.concat_ws("|", F.col(key).cast("string"), F.lit("flip")), seed) < int(noise * 2**32)
    return df.withColumn(out, ((score > 0.5) != flip).cast("int"))
