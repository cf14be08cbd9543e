from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm import simhash as S
from tesserae.llm.components import components

from .helpers import corpus, frame, odd_ids, ordered


def plain(text, n):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = raw.split()
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_like_brute_force(spark):
    for rows in (corpus(150), odd_ids(corpus(60, seed=6))):
        out = S.near_duplicates(frame(spark, rows)).collect()
        order = ordered(rows)
        fps = [plain(t, 3) for _, t, *_ in order]
        want = sorted((str(r[0]), f"{f:016x}", str(order[c][0])) for r, f, c in zip(order, fps, classes(fps, 3), strict=True))
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == want
    assert S.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [20_000, 10])
def test_dense_groups_and_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE_ROWS", tile)
    rng = np.random.default_rng(1)
    fps = {0}
    for base in rng.integers(0, 2**63, 6).tolist():
        for _ in range(60):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = {r["node"]: r["component"] for r in components(S.near_links(nodes, 3)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == classes(fps, 3)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_a_key(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    assert any(fp & m == other & m for m in S.block_masks(3))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (None, 1), (20, 19), (19, 18), (18, 17), (17, 16)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{i: 16 for i in range(16, 21)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = np.random.default_rng(4)  # a hub, a long chain in random order, and random links
    many = [(1000, 1001 + i) for i in range(300)] + [(5000 + int(i), 5001 + int(i)) for i in rng.permutation(80)]
    many += [tuple(map(int, e)) for e in rng.integers(10_000, 10_300, (240, 2))]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for x, y in many:
        if x != y:
            x, y = sorted((find(x), find(y)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(many, "a long, b long").repartition(5)).collect()}
    assert got == {i: find(i) for i in parent}


def test_similar_documents_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(900)]
    base = [[str(w) for w in rng.choice(words, 300)] for _ in range(25)]
    rows, gone = [], set()
    for i, w in enumerate(base):
        rows.append((10 * i, " ".join(w), "en", "s", 1))
        for k in range(1, 4):  # 1 to 3 changed words of 300: over 0.9 of the shingles stay
            v = list(w)
            for at in rng.choice(300, k, replace=False).tolist():
                v[at] = "other"
            rows.append((10 * i + k, " ".join(v), "en", "s", 1))
            gone.add(10 * i + k)
        rows.append((10 * i + 5, " ".join(str(x) for x in rng.permutation(w)), "en", "s", 1))
    df = frame(spark, rows)
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows} - gone
    odd = frame(spark, odd_ids(corpus()))
    kept = S.drop_near_duplicates(odd).collect()
    assert 0 < len(kept) < odd.count() and len({r["text"] or "" for r in kept}) == len(kept)
    assert S.drop_near_duplicates(df.limit(0)).count() == 0


def similarity(x, y, n=5):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_a_repeated_line_makes_no_near_duplicates(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    rows = []
    for k, (times, own) in enumerate([(10, 100), (20, 200)] * 5):
        line = text(14)
        for i in range(2):
            rows.append((10 * k + i, " ".join([text(own), *[line] * times]), "en", "s", 1))
        assert similarity(rows[-1][1], rows[-2][1]) < 0.1
    assert {r["doc_id"] for r in S.drop_near_duplicates(frame(spark, rows)).collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("tile", [2000, 3])
def test_like_all_pairs_around_the_threshold(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE_SETS", tile)
    rng = np.random.default_rng(7)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    texts = []
    for n in [5, 6, 7, 8, 9, 10, 12, 15, 20, 24, 28, 29, 30, 34] * 4:  # short: a word is added, or changed at an end
        w = text(n)
        texts += [w, [*w, "added"], ["changed", *w[1:]], [*w[:-1], "other"]]
    for n in (60, 200, 600):
        for share in np.linspace(0.7, 0.9, 21):  # long: a tail of its own, similarity share
            w = text(n + 4)
            cut = round(2 * share / (1 + share) * n) + 4
            texts += [w, [*w[:cut], *text(n + 4 - cut)]]
    texts += [["Same", "WORDS"], ["same", "words"], []]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)]
    sets = [{tuple(x.lower() for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert {r["doc_id"] for r in S.drop_near_duplicates(frame(spark, rows)).collect()} == set(root)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_joins_spread_hot_keys_only(spark, monkeypatch, how):
    big = spark.range(5000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    small = spark.range(4500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    plain = sorted(map(tuple, big.join(small, "k", how).select("k", "row", "x").collect()))
    for rows, hot in ((100_000, 100), (1000, 100), (1000, 10_000), (0, 1)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", max(1, rows))
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        out = common.join_small(big, small, "k", F.col("row"), how)
        assert sorted(map(tuple, out.select("k", "row", "x").collect())) == plain
    assert common.join_small(big.limit(0), small, "k", F.col("row"), how).count() == 0


def plain_wide(h, words):
    def word(x, seed):
        x = (int(x) ^ seed) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 29) * 0xC2B2AE3D27D4EB4F % 2**64
        return x ^ x >> 32

    hashes = [sum(word(x, int(s)) << 64 * w for w, s in enumerate(S.pivots(words))) for x in h]
    return sorted(i for i in range(64 * words) if 2 * sum(x >> i & 1 for x in hashes) > len(h))


def test_wide_fingerprints_are_majorities_of_bits():
    """The pipeline's stage takes SimHash too: bits that over half the shingles set, in some fixed order."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n).astype("u8") for n in (1, 2, 7, 254, 255, 256, 2041, 5000)]
    got = np.array([np.unpackbits(np.frombuffer(S.wide_fingerprint(h, 5), "u1")) for h in sets])
    want = np.zeros_like(got)
    for k, h in enumerate(sets):
        want[k, plain_wide(h, 5)] = 1
    assert sorted(map(tuple, got.T.tolist())) == sorted(map(tuple, want.T.tolist()))
    assert S.wide_fingerprint(np.empty(0, "u8"), 5) == bytes(40)


@pytest.mark.parametrize("rows", [200_000, 13_000_000])
@pytest.mark.parametrize("n", [26, 40, 200])
def test_pairs_at_the_similarity_share_a_block_and_are_in_reach(n, rows):
    rng = np.random.default_rng(n)
    number, bits = S.blocks(rows, 0.8)
    words = -(-number * bits // 64)
    for _ in range(200):
        u = rng.integers(0, 2**63, 2 * n).astype("u8")
        both = -(-8 * n // 9)  # 0.8 of all that the two sets hold
        x = np.array([np.frombuffer(S.wide_fingerprint(h, words), "u1") for h in (u[:n], np.concatenate([u[:both], u[n : 2 * n - both]]))])
        a, b = S.block_keys(x, number, bits)
        assert (a == b).any() and np.bitwise_count(x[0, : 8 * S.WORDS] ^ x[1, : 8 * S.WORDS]).sum() <= S.reach(0.8)


@pytest.mark.parametrize("large", [1, 1000])
def test_wide_links_like_all_pairs(monkeypatch, large):
    monkeypatch.setattr(S, "LARGE", large)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (12, 64 * S.WORDS))
    fps = np.array([b ^ (rng.random(b.size) < p) for b in base for p in (0, 0.1, 0.2, 0.25, 0.3, 0.35)], "u1")
    bucket, radius = rng.integers(0, 3, len(fps)), S.reach(0.8)
    raw = [np.packbits(x).tobytes() for x in fps]
    t = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.arange(len(fps))), pa.array(raw, pa.binary())], ["bucket", "node", "fp"])
    roots = {i: i for i in range(len(fps))}
    for i, j in combinations(range(len(fps)), 2):
        if bucket[i] == bucket[j] and (fps[i] ^ fps[j]).sum() <= radius and roots[i] != roots[j]:
            a, b = sorted((roots[i], roots[j]))
            roots = {k: a if r == b else r for k, r in roots.items()}
    got = {i: i for i in range(len(fps))}
    for out in S._wide_forest(iter([t]), radius):
        got |= dict(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    assert got == roots and 1 < len(set(got.values())) < len(fps)
