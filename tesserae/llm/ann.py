"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred, rotated so that their signs lose least (iterative quantisation, several rotations side by
side) and coded as bits, cut into substrings as long as the logarithm of the number of rows. Each substring is an
index of its own: its buckets are dealt by table and leading bits, and a query is sent to just those shares of a
table that hold buckets within `reach` bits of its own substring, which are enumerated and looked up one by one.
Codes within m * (reach + 1) - 1 bits agree within reach bits in one of m substrings, so all of them are retrieved.
What is retrieved and lies within `radius` bits of the query's whole code is ranked by the exact inner product.

How many substrings, and which reach and radius, is learned: a bounded number of sampled queries gets its true
neighbours from all rows, and the cheapest choice that finds them is taken. Equal vectors are one query, and a
group of equal rows is cut to those that can be in a result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_small, partitions, sampled

#: Rows at most that the rotations are learned from, and queries whose true neighbours set reach and radius.
SAMPLE, QUERIES = 8192, 256
#: Rotations; each gives one bit a dimension.
ROTATIONS = 8
#: Sampled queries' true neighbours that probing has to reach, and that the radius has to keep of these.
RECALL, KEPT = 0.955, 0.985
#: Entries of a share of a table, about, and rows that a task gathers before it deals them.
SHARE, GATHER = 1 << 16, 1 << 16
#: Tasks that share a query's ranking, so that one near a large group is no task's burden.
SPLIT = 8
#: Candidates looked at in one go.
CHUNK = 1 << 20


def usable(vector) -> F.Column:
    """Whether a vector has components, none null, not finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of so many bits with at most so many set, fewest first."""
    out = [sum(1 << i for i in c) for n in range(min(flips, bits) + 1) for c in combinations(range(bits), n)]
    return np.array(out, "i8")


class Codes:
    """Learned binary codes for the largest inner product.

    Vectors are divided by the largest component `unit` and then by the largest length `scale`, and get one more
    component that makes all lengths equal; queries get 0 there, so that the nearest by angle is the largest inner
    product.
    """

    def __init__(self, sample: np.ndarray, unit: float, scale: float, rows: int, rotations: int = ROTATIONS, rounds: int = 30):
        self.unit, self.scale = unit, scale
        x = self._same_length(sample)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(sample.shape[1] + 1)
        d = x.shape[1]
        spread, axes = np.linalg.eigh(np.cov((x - self.mean).T) if len(x) > 1 else np.eye(d))
        axes = axes[:, np.argsort(-spread)][:, : max(1, d - 1)]
        v, turned = (x - self.mean) @ axes, []
        for seed in range(rotations):
            r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turned.append(axes @ r)
        self.turn = np.hstack(turned)
        self.bits = min(self.turn.shape[1], 24, max(8, int(rows).bit_length()))
        self.rows, self.tables, self.reach, self.radius = rows, self.turn.shape[1] // self.bits, self.bits, self.turn.shape[1]

    def _same_length(self, x: np.ndarray) -> np.ndarray:
        x = x / self.unit / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])

    def words(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(rows, words) of 64 bits: the substrings of all tables, one after the other, least bit first."""
        if query:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        else:
            x = self._same_length(x)
        packed = np.packbits((x - self.mean) @ self.turn[:, : self.tables * self.bits] >= 0, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")

    def part(self, words: np.ndarray, table: int) -> np.ndarray:
        """Substring of one table as a number."""
        word, bit = divmod(table * self.bits, 64)
        out = words[:, word] >> np.uint64(bit)
        if bit + self.bits > 64:
            out = out | (words[:, word + 1] << np.uint64(64 - bit))
        return (out & np.uint64((1 << self.bits) - 1)).astype("i8")

    def parts(self, words: np.ndarray) -> np.ndarray:
        """(rows, tables) numbers of `bits` bits."""
        return np.stack([self.part(words, t) for t in range(self.tables)], axis=1)

    def learn(self, apart_near: np.ndarray, apart_any: np.ndarray) -> None:
        """Sets tables, reach and radius from the distances by substring, (pairs, tables) each, of queries to their
        true neighbours and to any rows: the least work that reaches RECALL of the neighbours."""
        best = None
        for reach in range(self.bits + 1):
            near, any_ = apart_near <= reach, apart_any <= reach
            found = np.logical_or.accumulate(near, axis=1).mean(axis=0)
            for tables in (np.flatnonzero(found >= RECALL)[:64:8] + 1).tolist():
                radius = int(np.quantile(apart_near[:, :tables].sum(axis=1), KEPT, method="higher"))
                looked = any_[:, :tables]
                ranked = looked.any(axis=1) & (apart_any[:, :tables].sum(axis=1) <= radius)
                lookups = tables * sum(comb(self.bits, i) for i in range(reach + 1))
                # A product of floats, with its row fetched, costs about as much as 30 comparisons of codes.
                work = lookups + self.rows * (2 * float(looked.sum(axis=1).mean()) + 30 * float(ranked.mean()))
                if best is None or work < best[0]:
                    best = work, tables, reach, radius
        if best:
            _, self.tables, self.reach, self.radius = best

    @property
    def prefix(self) -> int:
        """Leading bits of a substring that deal a table's buckets."""
        return min(self.bits, max(0, (-(-self.rows // SHARE) - 1).bit_length()))

    def shares(self, query: bool, words: np.ndarray):
        """(row, table, leading bits, flips spent) of what each row (of a query: each share within reach) is dealt by."""
        rest = self.bits - self.prefix
        flips = masks(self.prefix, self.reach) if query else np.zeros(1, "i8")
        lead = (self.parts(words) >> rest)[:, :, None] ^ flips
        row, table, _ = np.indices(lead.shape, "i4")
        spent = np.broadcast_to(np.bitwise_count(flips).astype("i4"), lead.shape)
        return row.ravel(), table.ravel(), lead.ravel(), spent.ravel()


class Share:
    """One share of a table: its buckets by number, with their rows' numbers and whole codes."""

    def __init__(self, codes: Codes, table: int, rid: np.ndarray, words: np.ndarray):
        rest = codes.bits - codes.prefix
        own = codes.part(words, table) & ((1 << rest) - 1)
        order = np.argsort(own, kind="stable")
        self.codes, self.table, self.rest, self.rid, self.words = codes, table, rest, rid[order], words[order]
        self.begin = np.searchsorted(own[order], np.arange((1 << rest) + 1))

    def search(self, words: np.ndarray, spent: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, row number) of the rows in buckets within reach whose whole code lies within the radius, and how
        many rows were in these buckets; `spent`: bits in which the share itself is away from the queries."""
        near = masks(self.rest, self.codes.reach - spent)
        number = (self.codes.part(words, self.table) & ((1 << self.rest) - 1))[:, None] ^ near
        low, many = self.begin[number], self.begin[number + 1] - self.begin[number]
        query, bucket = np.nonzero(many)
        low, many = low[query, bucket], many[query, bucket]
        total = np.cumsum(many)
        found, at = [], 0
        while at < len(many):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            size = many[at:end]
            q = np.repeat(query[at:end], size)
            i = np.arange(size.sum()) + np.repeat(low[at:end] - np.cumsum(size) + size, size)
            apart = np.zeros(len(q), "i4")
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[q, w] ^ self.words[i, w])
            near_ = apart <= self.codes.radius
            found.append((q[near_], self.rid[i[near_]]))
            at = end
        if not found:
            return np.empty(0, "i8"), np.empty(0, "i8"), 0
        return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found]), int(total[-1])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal vectors get equal sums."""
    return (x * q).sum(axis=1)


def _calibrate(codes: Codes, index: DataFrame, sample: np.ndarray, k: int) -> None:
    """Sets the codes' reach and radius by sampled queries' true neighbours among all rows: one scan for all of them,
    a task keeps its best k + 1 a query."""
    asked = sample[:: max(1, len(sample) // QUERIES)][:QUERIES]

    def scan(batches):
        best = [(np.empty(0), np.empty((0, asked.shape[1])))] * len(asked)
        for b in batches:
            x = _matrix(b.column("v"))
            dots = asked @ x.T
            for i in range(len(asked)):
                some = np.argpartition(-dots[i], k)[: k + 1] if len(x) > k + 1 else np.arange(len(x))
                score = np.concatenate([best[i][0], dots[i, some]])
                rows = np.concatenate([best[i][1], x[some]])
                top = np.argsort(-score, kind="stable")[: k + 1]
                best[i] = score[top], rows[top]
        q = np.repeat(np.arange(len(asked)), [len(s) for s, _ in best])
        if q.size:
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([s for s, _ in best])), pa.array(list(np.concatenate([v for _, v in best])), pa.list_(pa.float64()))], ["q", "score", "v"])

    order = Window.partitionBy("q").orderBy(F.col("score").desc())
    top = index.select("v").mapInArrow(scan, "q long, score double, v array<double>").withColumn("i", F.row_number().over(order))
    near = top.filter((F.col("i") > 1) & (F.col("i") <= k + 1)).select("q", "v").toArrow()  # the nearest is the query itself
    if not near.num_rows:
        return
    own, rows = codes.parts(codes.words(asked, query=True)), codes.parts(codes.words(_matrix(near.column("v"))))
    any_ = codes.parts(codes.words(sample[:: max(1, len(sample) // 512)][:512]))
    pairs = np.bitwise_count(own[:, None, :] ^ any_[None]).reshape(-1, codes.tables)
    codes.learn(np.bitwise_count(own[near.column("q").to_numpy()] ^ rows), pairs)


def _deal(codes: Codes, df: DataFrame, query: bool) -> DataFrame:
    """(share, tbl, spent, n, rid, words) for rows (rid, v): their numbers and codes as bytes, by share of a table."""
    names = ["share", "tbl", "spent", "n", "rid", "words"]

    def flush(rid, words):
        row, table, lead, spent = codes.shares(query, words)
        order = np.lexsort((lead, spent, table))
        row, table, lead, spent = row[order], table[order], lead[order], spent[order]
        cut = np.flatnonzero((np.diff(table) != 0) | (np.diff(lead) != 0) | (np.diff(spent) != 0)) + 1
        out = [[] for _ in names]
        for a, b in zip([0, *cut], [*cut, len(row)], strict=True):
            part = row[a:b]
            values = (int(table[a]) << codes.bits | int(lead[a]), int(table[a]), int(spent[a]), b - a, rid[part].tobytes(), words[part].tobytes())
            for c, x in zip(out, values, strict=True):
                c.append(x)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def run(batches):
        rids, words, size = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            rids.append(b.column("rid").to_numpy())
            words.append(codes.words(_matrix(b.column("v")), query))
            size += b.num_rows
            if size >= GATHER:
                yield flush(np.concatenate(rids), np.concatenate(words))
                rids, words, size = [], [], 0
        if size:
            yield flush(np.concatenate(rids), np.concatenate(words))

    return df.select("rid", "v").mapInArrow(run, "share long, tbl int, spent int, n int, rid binary, words binary")


def candidates(codes: Codes, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, rid, looked): what probing retrieves within the radius for queries (rid, v) among rows (rid, v), once a
    table; and, with null qid and rid, how many rows were in the buckets that were looked up."""
    entries, probes = _deal(codes, index, False), checkpointed(_deal(codes, asked, True))
    # A share with many rows, near copies of one vector say, goes to several tasks, and its queries to each of them.
    entries = checkpointed(entries)
    sizes = entries.groupBy("share").agg(F.ceil(F.sum("n") / (2 * SHARE)).cast("int").alias("slices"))
    slice_ = F.pmod(F.xxhash64("rid"), F.col("slices")).cast("int")
    entries = join_small(entries, sizes, "share", F.xxhash64("rid"), "inner").withColumn("slice", slice_)
    probes = join_small(probes, sizes, "share", F.xxhash64("rid"), "inner").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    names = pa.schema([("qid", pa.int64()), ("rid", pa.int64()), ("looked", pa.int64())])
    read = lambda t: (np.frombuffer(b"".join(t.column("rid").to_pylist()), "i8"), np.frombuffer(b"".join(t.column("words").to_pylist()), "<u8").reshape(-1, -(-codes.tables * codes.bits // 64)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        share = Share(codes, left.column("tbl")[0].as_py(), *read(left))
        qids, rids, looked = [], [], 0
        for spent in np.unique(right.column("spent").to_numpy()).tolist():
            qid, words = read(right.filter(pa.compute.equal(right.column("spent"), spent)))
            for at in range(0, len(qid), 256):
                q, r, n = share.search(words[at : at + 256], spent)
                qids.append(qid[at + q])
                rids.append(r)
                looked += n
        qid, rid = pa.array(np.concatenate(qids)), pa.array(np.concatenate(rids))
        found = pa.table([qid, rid, pa.nulls(len(qid), pa.int64())], schema=names)
        return pa.concat_tables([found, pa.table([[None], [None], [looked]], schema=names)])

    keys = ["share", "slice"]
    cells = entries.select(*keys, "tbl", "rid", "words").groupBy(*keys).cogroup(probes.select(*keys, "spent", "rid", "words").groupBy(*keys))
    return cells.applyInArrow(run, "qid long, rid long, looked long")


def _rank(pairs: DataFrame, index: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """(qid, id, score): for each query (qid, v) and each of SPLIT shares of its candidates (qid, rid) the best 2 k, at most
    k of one id. That is enough for the k best whichever id is left out."""
    n = partitions(index.sparkSession)
    bucket = lambda split: F.pmod(F.xxhash64("qid", split), F.lit(4 * n)).cast("int").alias("bucket")
    rows = pairs.join(index, "rid").select(bucket(F.pmod("rid", F.lit(SPLIT)).cast("int")), F.pmod("rid", F.lit(SPLIT)).cast("int").alias("split"), "qid", "id", "v")
    ask = asked.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))).select(bucket(F.col("split")), "qid", "v").distinct()
    schema = f"qid long, id {kind}, score double"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        vectors, place = _matrix(right.column("v")), {q: i for i, q in enumerate(right.column("qid").to_pylist())}
        qid = left.column("qid").to_numpy()
        at = np.array([place[q] for q in qid.tolist()])
        score, x = np.empty(len(qid)), left.column("v")
        for i in range(0, len(qid), 1 << 14):
            score[i : i + (1 << 14)] = _scores(_matrix(x.slice(i, 1 << 14)), vectors[at[i : i + (1 << 14)]])
        t = pa.table({"qid": qid, "split": left.column("split"), "id": left.column("id"), "minus": -score})
        t = t.take(pa.compute.sort_indices(t, [("qid", "ascending"), ("split", "ascending"), ("minus", "ascending"), ("id", "ascending")]))
        keep, last, taken, many = [], None, 0, {}
        groups = zip(t.column("qid").to_pylist(), t.column("split").to_pylist(), strict=True)
        for i, (q, key) in enumerate(zip(groups, t.column("id").to_pylist(), strict=True)):
            if q != last:
                last, taken, many = q, 0, {}
            if taken < 2 * k and many.get(key, 0) < k:
                keep.append(i)
                taken += 1
                many[key] = many.get(key, 0) + 1
        t = t.take(pa.array(keep, pa.int64()))
        return pa.table([t.column("qid"), t.column("id"), pa.compute.negate(t.column("minus"))], schema=target)

    return rows.groupBy("bucket").cogroup(ask.groupBy("bucket")).applyInArrow(run, schema)


def _scan(index: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """(qid, rid): every row for every query of a stated set, a task a block of rows."""
    blocks = -(-rows // SHARE)
    left = index.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), "rid")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "qid")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        q, r = b.column("qid").to_numpy(), a.column("rid").to_numpy()
        return pa.table({"qid": np.repeat(q, len(r)), "rid": np.tile(r, len(q))})

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, "qid long, rid long")


def prepare(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int):
    """The learned codes, the rows (rid, id, v) that can be in a result, the queries (id, v) and the distinct query
    vectors (rid, v); None without rows."""
    pick = lambda t: t.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = pick(df), pick(queries)
    largest = F.array_max(F.transform("v", F.abs))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(largest).alias("unit"))
    top = sizes.orderBy(F.col("n").desc(), "d").first()
    if top is None:
        return None
    d, unit = top["d"], top["unit"]
    rows, asked = rows.filter(F.size("v") == d), asked.filter(F.size("v") == d)
    # Of equal vectors only the first 2 k in order of id, at most k of one id, can be in a result.
    same, equal = Window.partitionBy("v", "id").orderBy(F.lit(0)), Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("i", F.row_number().over(same)).filter(F.col("i") <= k)
    index = index.withColumn("i", F.row_number().over(equal)).filter(F.col("i") <= 2 * k)
    index = checkpointed(index.select(F.monotonically_increasing_id().alias("rid"), "id", "v"))
    length = (largest / unit) * F.sqrt(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x))
    total, scale = index.agg(F.count("*"), F.max(length)).first()

    sample = index.filter(sampled(F.xxhash64("rid"), SAMPLE / total)).select("v").limit(2 * SAMPLE).toArrow()
    sample = np.unique(_matrix(sample.column("v")), axis=0)  # copies would make the neighbours look near
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    codes = Codes(sample.reshape(-1, d), unit, scale or 1.0, total)
    _calibrate(codes, index, sample, k)
    vectors = checkpointed(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("rid"), "v"))
    return codes, index, asked, vectors, total


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products found for each row of queries among df's other rows.

    Ranks count from 1, ties go to the smaller id. Vectors that are null, zero, or hold nulls or non-finite
    components take no part, nor do rows with null ids and vectors of another length than the most common one.
    Rows with the query's id are its own. Equal vectors get equal scores; rows that repeat an id are candidates each.
    A query for which probing finds fewer than k rows is compared with all of them; where there are fewer, it gets
    those; empty tables give an empty result. Other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    ready = prepare(df, queries, id_col, vector_col, k)
    if ready is None:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    codes, index, asked, vectors, total = ready
    found = candidates(codes, index, vectors).filter("qid is not null").select("qid", "rid").distinct()
    ask = vectors.withColumnRenamed("rid", "qid")
    best = checkpointed(_rank(found, index, ask, k, kind))
    # Where fewer than k rows would be left without the query's own id, whichever it is, the query meets every row.
    of_id = best.groupBy("qid", "id").count().groupBy("qid").agg((F.sum("count") - F.max("count")).alias("sure"))
    short = checkpointed(ask.join(of_id.filter(F.col("sure") >= k), "qid", "left_anti"))
    if not short.isEmpty():
        best = best.join(short.select("qid"), "qid", "left_anti").unionByName(_rank(_scan(index, short, total), index, short, k, kind))
    lists = best.groupBy("qid").agg(F.collect_list(F.struct("score", "id")).alias("top"))  # at most 2 k SPLIT each
    by_vector = asked.select(F.col("id").alias("query_id"), "v").join(ask, "v").select("query_id", "qid")
    out = by_vector.join(lists, "qid").withColumn("top", F.filter("top", lambda x: x["id"] != F.col("query_id")))
    ordered = F.array_sort("top", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    out = out.select("query_id", F.posexplode(F.slice(ordered, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def op3_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
