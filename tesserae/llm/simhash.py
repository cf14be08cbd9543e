"""SimHash near-duplicates with pivot distance tables.

Fingerprints within `radius` bits agree in all but `radius` of radius + 2 bit blocks, so they meet under a pair of
equal blocks. Under such a key they are sorted by their Hamming distance to a first reference fingerprint; only
those whose distances differ by at most the radius are paired, pairs whose distances to any other reference differ
by more are discarded (the triangle inequality keeps every link), and the survivors are compared bit by bit. Equal
fingerprints are one node throughout, and a task hands on a spanning forest of its links, never all pairs.

The pipeline's stage takes the same way with wider fingerprints of the sets of shingles, whose blocks are as many as
pairs of the similarity asked for need; what they find are candidates, and links are decided on the sets.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_small, partitions, tidy, with_row_ids
from .components import Forest, components

#: Number of reference fingerprints; they follow from their number alone.
PIVOTS = 16
#: A key with more fingerprints than this is split into tiles, each pair of which is a group of its own.
TILE_ROWS = 20_000
#: The same for groups of sets of shingles.
TILE_SETS = 2_000
#: 64-bit words of a wide fingerprint that are compared; all its bits make keys.
WORDS = 4
#: Share of pairs at the similarity itself that meet under no key.
MISSED = 5e-6
#: Groups of more fingerprints are searched from row to row; of a group of copies all pairs would be too many.
LARGE = 1 << 10
#: Shingles of a set that is looked up by its own shingles, so that no pair of such sets is missed.
SHORT = 25
#: Pairs held at a time.
CHUNK = 1 << 21

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed=i) for i in range(n)], dtype="u8")


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, most significant first. The bits of one place in all eight bytes are
    summed in one word, 255 words at a time, before a byte can overflow."""
    planes = (h[None, :] >> np.arange(8, dtype="u8")[:, None]) & np.uint64(0x0101010101010101)
    sums = np.add.reduceat(planes, np.arange(0, len(h), 255), axis=1).astype("<u8")
    return sums.view("u1").reshape(8, -1, 8).sum(axis=1, dtype="i8").T.reshape(64)[::-1]


def fingerprint(text: str | None, shingle: int) -> bytes:
    """Bit i is 1 if it is set in over half the shingles' XXH64 (seed 42); no words: 0. Most significant bit first."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(sizes + 1)
    n = max(1, len(words) - shingle + 1)
    starts = (ends - sizes - 1)[:n].tolist()
    last = ((ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1).tolist()
    digest, h = xxhash.xxh64_intdigest, np.empty(n, "u8")
    h[:] = [digest(joined[a:b], 42) for a, b in zip(starts, last, strict=True)]
    return np.packbits(sum(bit_counts(h[i : i + (1 << 16)]) for i in range(0, n, 1 << 16)) * 2 > n).tobytes()


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): 64-bit fingerprints as signed longs. Null texts have no words and so fingerprint 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.frombuffer(b"".join(fingerprint(t.as_py(), shingle) for t in b.column(1)), ">i8").astype("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, fp long").withColumnRenamed("id", id_col)


def block_masks(radius: int) -> list[int]:
    """One mask for each pair of radius + 2 blocks of the 64 bits."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def _near_pairs(group: np.ndarray, fp: np.ndarray, radius: int):
    """Chunks (i, j) of pairs within the radius whose groups are equal; fp has a row of 64-bit words each."""
    refs = pivots(PIVOTS * fp.shape[1]).reshape(PIVOTS, -1)
    table = sum(np.bitwise_count(fp[:, k, None] ^ refs[None, :, k]).astype("i2") for k in range(fp.shape[1]))
    order = np.lexsort((table[:, 0], group))
    fp, table = fp[order], table[order]
    dense = np.cumsum(np.concatenate([[0], np.diff(group[order]) != 0])).astype("i8")
    wide = 64 * fp.shape[1] + radius + 1
    place = dense * wide + table[:, 0]
    upto = np.searchsorted(place, place + radius, "right")
    many = upto - np.arange(len(fp)) - 1
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(fp):
        end = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
        i = np.repeat(np.arange(at, end), many[at:end])
        j = i + 1 + np.arange(i.size) - np.repeat(total[at:end] - total[at], many[at:end])
        for p in range(1, PIVOTS):
            keep = np.abs(table[i, p] - table[j, p]) <= radius
            if p > 2 and keep.mean() > 0.9 if i.size else True:  # the references that are left discard too few
                break
            i, j = i[keep], j[keep]
        apart = sum(np.bitwise_count(fp[i, k] ^ fp[j, k]).astype("i2") for k in range(fp.shape[1])) if i.size else i
        keep = apart <= radius
        yield order[i[keep]], order[j[keep]]
        at = end


def _forest(batches, radius: int):
    """Reads a whole partition of (bucket, node, fp), a share of all buckets, and yields its spanning links."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    fp = t.column("fp").combine_chunks()
    fp = fp.to_numpy().view("u8")[:, None]
    nodes, local = np.unique(t.column("node").to_numpy(), return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in _near_pairs(t.column("bucket").to_numpy(), fp, radius):
        forest.link(local[i], local[j])
    roots = forest.roots(np.arange(len(nodes)))
    tied = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[roots[tied]])], ["a", "b"])


def near_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs of nodes (node, fp) within the radius connect; fps are distinct."""
    masks = block_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])
    return _links(nodes.select("node", "fp", F.explode(keys).alias("key")), lambda b: _forest(b, radius), TILE_ROWS)


def _links(rows: DataFrame, links, tile_rows: int) -> DataFrame:
    """The links that links(batches of bucket, node, fp) finds among rows (key, node, fp) that share a key."""
    sizes = rows.groupBy("key").count()
    hot = checkpointed(sizes.filter(F.col("count") > tile_rows).withColumn("tiles", F.ceil(F.col("count") / tile_rows).cast("int")))
    n = partitions(rows.sparkSession)
    if hot.isEmpty():
        rows = rows.withColumn("bucket", F.col("key"))
    else:  # every tile meets every other in a bucket of its own
        rows = rows.join(hot.select("key", "tiles"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.withColumn("bucket", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")))
    return rows.select("bucket", "node", "fp").repartition(n, "bucket").mapInArrow(tidy(links), "a long, b long")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each distinct shingle, in order; the shingles are those of fingerprint()."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "u8")
    found = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), "u8", len(found)))


def angle(similarity: float) -> float:
    """Chance that a bit of two sets' fingerprints differs, at most: sets of that similarity are nearest to orthogonal
    if they are of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def blocks(rows: int, similarity: float) -> tuple[int, int]:
    """(number, bits) of a wide fingerprint's blocks, each a key: longer for more rows, so that unlike rows of one key
    stay few, and as many that of pairs of that similarity only MISSED differ in every block."""
    bits = max(12, rows.bit_length() - 6)
    equal = (1 - angle(similarity)) ** bits
    return (math.ceil(math.log(MISSED) / math.log1p(-equal)) if equal < 1 else 1), bits


def reach(similarity: float) -> int:
    """Bits of WORDS words in which similar sets differ at most: six standard deviations over what is expected."""
    n, q = 64 * WORDS, angle(similarity)
    return math.ceil(n * q + 6 * math.sqrt(n * q * (1 - q)))


def wide_fingerprint(h: np.ndarray, words: int) -> bytes:
    """SimHash of a set of shingles in so many 64-bit words: a bit is 1 if it is set in over half the shingles' hashes,
    of which each word mixes its own. Empty sets: 0."""
    if not len(h):
        return bytes(8 * words)
    counts, seeds = 0, pivots(words)
    for at in range(0, len(h), 255 * 8):
        x = (h[at : at + 255 * 8, None] ^ seeds) * _M1
        x = (x ^ (x >> _S29)) * _M2
        x ^= x >> _S32
        planes = (x[None] >> np.arange(8, dtype="u8")[:, None, None]) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(planes, np.arange(0, x.shape[0], 255), axis=1)  # as in bit_counts()
        counts = counts + sums.view("u1").reshape(8, -1, 8 * words).sum(axis=1, dtype="i8")
    return np.packbits(counts.T.reshape(-1) * 2 > len(h)).tobytes()


def block_keys(fp: np.ndarray, number: int, bits: int) -> np.ndarray:
    """The keys of fingerprints (a row of bytes each): the number of a block, and its bits."""
    x = np.unpackbits(fp, axis=1)[:, : number * bits].reshape(len(fp), number, bits)
    return x @ (1 << np.arange(bits, dtype="i8")) + (np.arange(number, dtype="i8") << bits)


def prefix(h: np.ndarray, similarity: float) -> np.ndarray:
    """The least shingles of a set, as many that two sets of that similarity always share one of theirs."""
    return h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def _groups(bucket: np.ndarray):
    """The order that sorts the buckets, and (begin, end) of those of two rows and more."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    begin, end = np.concatenate([[0], cut]), np.append(cut, len(bucket))
    return order, [(int(a), int(b)) for a, b in zip(begin, end, strict=True) if b - a > 1]


def _reached(n: int, near):
    """Links (i, j) that connect what near connects among 0 to n - 1. near(i, others) says which of the others are near
    i; a row that is reached is not looked at again, so a group of copies costs little more than its size."""
    rest = np.arange(1, n)
    queue = [0]
    while rest.size:
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        i = queue.pop()
        hit = near(i, rest)
        for j in rest[hit].tolist():
            yield i, j
            queue.append(j)
        rest = rest[~hit]


def _forest_of(batches, links):
    """Reads a whole partition of (bucket, node, fp), a share of all buckets, and yields the links that links(list of a
    bucket's fp) finds."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    node, fp = t.column("node").to_numpy(), t.column("fp").combine_chunks()
    order, groups = _groups(t.column("bucket").to_numpy())
    a, b = [], []
    for begin, end in groups:
        rows = order[begin:end]
        for i, j in links(fp.take(pa.array(rows)).to_pylist()):
            a.append(node[rows[i]])
            b.append(node[rows[j]])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _wide_forest(batches, radius: int):
    """_forest() of wide fingerprints. Groups over LARGE are searched from row to row, by the same tables."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "u8").reshape(t.num_rows, -1)
    nodes, local = np.unique(t.column("node").to_numpy(), return_inverse=True)
    _, group, size = np.unique(t.column("bucket").to_numpy(), return_inverse=True, return_counts=True)
    forest = Forest(len(nodes))
    rows = np.flatnonzero((size[group] > 1) & (size[group] <= LARGE))
    if rows.size:
        for i, j in _near_pairs(group[rows], fp[rows], radius):
            forest.link(local[rows[i]], local[rows[j]])
    refs = pivots(PIVOTS * fp.shape[1]).reshape(PIVOTS, -1)
    for g in np.flatnonzero(size > LARGE).tolist():
        own = np.flatnonzero(group == g)
        x = fp[own]
        table = np.stack([np.bitwise_count(x ^ r).sum(axis=1, dtype="i2") for r in refs])

        def near(i, rest, x=x, table=table):
            at = np.arange(len(rest))
            for d in table:
                keep = np.abs(d[rest[at]] - d[i]) <= radius
                if keep.mean() > 0.9:  # as in _near_pairs()
                    break
                at = at[keep]
                if not at.size:
                    break
            hit = np.zeros(len(rest), bool)
            hit[at] = np.bitwise_count(x[rest[at]] ^ x[i]).sum(axis=1, dtype="i2") <= radius
            return hit

        if links := list(_reached(len(own), near)):
            i, j = np.array(links).T
            forest.link(local[own[i]], local[own[j]])
    roots = forest.roots(np.arange(len(nodes)))
    tied = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[roots[tied]])], ["a", "b"])


def similar(fps: list[bytes], similarity: float):
    """Links (i, j) that connect exactly what pairs of sets of that similarity (Jaccard) connect."""
    sizes = np.array([len(x) // 8 for x in fps], "i8")
    ids = np.unique(np.frombuffer(b"".join(fps), "u8"), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(int(ids.max()) + 1 if ids.size else 0, bool)
    held = {"rest": np.arange(len(fps)), "ids": ids, "owner": np.repeat(np.arange(len(fps)), sizes)}

    def near(i, rest):
        if 2 * len(rest) < len(held["rest"]):  # words of rows that are done are put away
            wanted = np.zeros(len(fps), bool)
            wanted[rest] = True
            keep = wanted[held["owner"]]
            held.update(rest=rest, ids=held["ids"][keep], owner=held["owner"][keep])
        own = ids[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        both = np.bincount(held["owner"][mark[held["ids"]]], minlength=len(fps))[rest]
        mark[own] = False
        return both / np.maximum(1, sizes[i] + sizes[rest] - both) >= similarity

    return _reached(len(fps), near)


def similar_links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, number: int, bits: int) -> DataFrame:
    """Links (a, b) among nodes (node, fp: the wide fingerprint, short: the set if it is small) whose texts (_rid, _text)
    have sets of shingles of that similarity, decided on the sets themselves; they connect what all such pairs connect.

    Fingerprints that share a block (see blocks()) are compared by pivot distance tables, then bit by bit; those within
    reach() are candidates. Candidates that links reach are one group, to which the sets of its texts are sent
    once; a group over TILE_SETS goes in tiles. Sets of at most SHORT shingles also meet under each shingle of their
    prefix, where they are compared themselves: of these no pair is missed.
    """

    def keyed(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.frombuffer(b"".join(part.column("fp").to_pylist()), "u1").reshape(part.num_rows, -1)
                keys = block_keys(x, number, bits)
                fp = pa.array([r.tobytes() for r in x[:, : 8 * WORDS]], pa.binary())
                for k in range(number):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])), part.column("node"), fp], ["key", "node", "fp"])

    def sets(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                fp = [shingle_set(t, shingle).tobytes() for t in b.column("_text").slice(i, 256).to_pylist()]
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("node"), pa.array(fp, pa.binary())], ["key", "node", "fp"])

    def short(batches):
        for b in batches:
            key, node, fp = [], [], []
            for n, raw in zip(b.column("node").to_pylist(), b.column("short").to_pylist(), strict=True):
                keys = prefix(np.frombuffer(raw, "i8").view("u8"), similarity).view("i8").tolist()
                key += keys
                node += [n] * len(keys)
                fp += [raw] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(fp, pa.binary())], ["key", "node", "fp"])

    exact = lambda b: _forest_of(b, lambda x: similar(x, similarity))
    radius = reach(similarity)
    rows = nodes.select("node", "fp").mapInArrow(tidy(keyed), "key long, node long, fp binary")
    groups = components(_links(rows, lambda b: _wide_forest(b, radius), TILE_ROWS))
    asked = texts.join(groups.withColumnRenamed("node", "_rid"), "_rid").select(F.col("component").alias("key"), F.col("_rid").alias("node"), "_text")
    members = checkpointed(asked.mapInArrow(tidy(sets), "key long, node long, fp binary"))
    small = nodes.filter("short is not null").select("node", "short").mapInArrow(tidy(short), "key long, node long, fp binary")
    return _links(members, exact, TILE_SETS).union(_links(small, exact, TILE_ROWS))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without rows that are near-duplicates of an earlier row: of each group the row with the least id stays.

    Near: the sets of the texts' distinct shingles have that similarity (Jaccard) or more, which is decided on the
    sets; groups are connected components. Rows go by (id, nulls last, then text). Null, empty and wordless texts are
    one group. All columns are kept as they are.
    """
    rest = tuple(c for c in df.columns if c not in (id_col, text_col))
    rows, _ = with_row_ids(df, id_col, text_col, rest)
    number, bits = blocks(rows.count(), similarity)
    words = max(WORDS, -(-number * bits // 64))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingle_set(t, shingle) for t in b.column(1).slice(at, 256).to_pylist()]
                same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                fp = [wide_fingerprint(x, words) for x in sets]
                short = [x.tobytes() if 0 < len(x) <= SHORT else None for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *[pa.array(c, pa.binary()) for c in (same, fp, short)]], ["_rid", "same", "fp", "short"])

    fps = checkpointed(rows.select("_rid", "_text").mapInArrow(tidy(run), "_rid long, same binary, fp binary, short binary"))
    nodes = checkpointed(fps.groupBy("same").agg(F.min("_rid").alias("node"), F.first("fp").alias("fp"), F.first("short").alias("short")))
    roots = components(similar_links(nodes, rows.select("_rid", "_text"), shingle, similarity, number, bits))
    firsts = nodes.select("node").join(roots.filter("component <> node"), "node", "left_anti")
    kept = rows.join(firsts.withColumnRenamed("node", "_rid"), "_rid", "left_semi")
    named = {id_col: F.col("_id"), text_col: F.col("_text")} | {c: F.col("_carry")[c] for c in rest}
    return kept.select(*[named[c].alias(c) for c in df.columns])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the least id that links reach.

    Null and empty texts and texts without words have fingerprint 0 and link like others; a text of fewer words
    than a shingle is one shingle. Repeated rows share a fingerprint. Where ids are null, repeated or no whole
    numbers, the least id of a component is that of its first row in order (id, nulls last, text). An empty table
    gives an empty result; other columns are left out.
    """
    rows, plain = with_row_ids(df, id_col, text_col)
    fps = fingerprints(rows.select(F.struct("_rid", "_id").alias("k"), "_text"), "k", "_text", shingle)
    fps = checkpointed(fps.select("k._rid", "k._id", "fp"))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("_rid").alias("node")))
    roots = components(near_links(nodes, radius))
    named = checkpointed(nodes.join(roots, "node", "left").select("fp", F.coalesce("component", "node").alias("root")))
    # Of equal texts and of large components there may be any number: their rows are spread.
    if plain:
        named = named.withColumn("component_id", F.col("root"))
    else:
        ids = fps.join(named.select(F.col("root").alias("_rid")).distinct(), "_rid").select(F.col("_rid").alias("root"), F.col("_id").alias("component_id"))
        named = checkpointed(join_small(named, checkpointed(ids), "root", F.col("fp"), "inner"))
    out = join_small(fps, named, "fp", F.col("_rid"), "inner")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(df.schema[id_col].dataType).alias("component_id"))


def op10_simhash(spark, sf_dir):
    from .common import documents

    return near_duplicates(documents(spark, sf_dir))
