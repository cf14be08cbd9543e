"""URL filters by a Bloom filter cascade.

The first filter holds the listed keys, the second those keys of the corpus that the first takes by mistake, the
third the listed keys that the second takes, and so on until a level takes none by mistake. Over the corpus's
complete key universe the first level that misses a key decides, so membership is exact and needs no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: One level may take so many bits (64 MiB); a longer list has to be split.
MAX_BITS = 1 << 29
#: A level of at most so many bits (8 KiB) is put into the plan as a constant.
CONSTANT_BITS = 1 << 16

#: (host, path, verdict) of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    m = F.lit(bits).cast("long")
    a, b = F.pmod(F.xxhash64(key, F.lit(2 * level)), m), F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), m)
    return [F.pmod(a + b * i, m) for i in range(hashes)]


class BloomCascade:
    """Exact membership of the keys that occur in `universe` (a column key; repeats allowed) in `listed` (same)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = checkpointed(listed.filter("key is not null").select("key").distinct())
        others = universe.filter("key is not null").select("key").distinct().join(listed, "key", "left_anti")
        others = checkpointed(others)
        self.levels: list[tuple[int, int, Column]] = []
        inside, outside = listed, others
        n_in, n_out = inside.count(), outside.count()
        while n_in:
            # First as few false positives as half the keys, then one in two.
            rate = min(0.5, max(1e-6, math.sqrt(0.5) * n_in / max(1, n_out))) if not self.levels else 0.5
            self._add(inside, n_in, rate)
            outside = checkpointed(outside.filter(self._in_level(F.col("key"), len(self.levels) - 1)))
            inside, outside = outside, inside
            n_in, n_out = inside.count(), n_in

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        hashes = max(1, round(-math.log2(rate)))
        bits = -(-max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)) // 64) * 64
        if bits > MAX_BITS:
            raise ValueError(f"{n} keys need {bits} bits in one level; split the list")
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), len(self.levels), bits, hashes))).alias("p"))
        parts = at.select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("set"))
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
        words = parts.union(every).groupBy("word").agg(F.bit_or("set").alias("set"))
        # In order of place, in blocks first: each word is looked at a few times, whatever their number.
        blocks = words.groupBy(F.shiftright("word", 12).alias("block")).agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("part"))
        blocks = blocks.select("block", F.transform("part", lambda x: x["set"]).alias("part"))
        row = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("b"))
        row = checkpointed(row.select(F.flatten(F.transform("b", lambda x: x["part"])).alias("words")))
        # A short filter is a constant of the plan; a long one is read once, by a scalar subquery.
        words_ = F.array(*[F.lit(w).cast("long") for w in row.first()["words"]]) if bits <= CONSTANT_BITS else row.scalar()
        self.levels.append((bits, hashes, words_))

    def _in_level(self, key: Column, level: int) -> Column:
        bits, hashes, words = self.levels[level]
        found = F.lit(True)
        for p in _positions(key, level, bits, hashes):
            word = F.element_at(words, ((p / 64).cast("long") + 1).cast("int"))
            found = found & (F.getbit(word, (p % 64).cast("int")) == 1)
        return found

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that misses it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._in_level(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty if it is null or has no "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The keys that could be a rule for the url, one for each shape (labels of a rule's host, length of its path);
    null where the url is too short for the shape."""
    labels = F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))
    return [F.when((labels >= n) & (F.length(path) >= k), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k))) for n, k in shapes]


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages' columns and host, path, rule, verdict for rules (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with its path; the longest rule wins and a
    url that none fits gets `default`: it is on no list. Columns of pages with the new names are replaced. Null and
    malformed urls have empty host and path and fit no rule; repeated pages are judged each; of rules with the
    same key and both verdicts, block wins. The path of a rule begins with "/"; rules with a null are left out.
    """
    rules = rules.filter("host is not null and path is not null and verdict is not null")
    shape = [F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("k")]
    shapes = sorted(tuple(r) for r in rules.select(*shape).distinct().collect())
    host, path = url_parts(F.col(url_col))
    parts = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = parts.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    every = BloomCascade(listed.select("key"), universe)
    block = BloomCascade(listed.filter("verdict = 'block'").select("key"), listed.select("key"))  # asked about rules alone
    hits = [F.when(every.contains(k), F.struct(F.length(k).alias("n"), k.alias("key"))) for k in keys]
    parts = parts.withColumn("rule", F.greatest(*hits, *hits[:1])["key"])
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(block.contains(F.col("rule")), F.lit("block")).otherwise("allow")
    return parts.withColumn("verdict", verdict)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(rhost, rpath, rverdict)),
p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT row_number() OVER () AS i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT i, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
      FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM q LEFT JOIN m USING (i)
"""
