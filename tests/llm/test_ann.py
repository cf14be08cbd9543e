import numpy as np

from tesserae.llm import ann as A


def brute(ids, x, q, k):
    out = {}
    for i in q:
        s = (x * x[ids.index(i)]).sum(axis=1)
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
        out[i] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_ties_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    x = centres[rng.integers(0, 12, 3000)] * rng.uniform(0.5, 2, (3000, 1)) + 0.6 * rng.normal(size=(3000, 32))
    x[100:700] = x[99]  # a large group of equal vectors
    ids = list(range(0, 6000, 2))
    rows = [(i, v, "x") for i, v in zip(ids, x.tolist(), strict=True)] + [(None, x[0].tolist(), "x"), (1, None, "x"), (3, [0.0] * 32, "x"), (5, [float("nan")] * 32, "x"), (7, [None] + [1.0] * 31, "x"), (9, [1.0], "x"), (11, [float("inf")] * 32, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    out = A.nearest(df, df.filter("vec_id % 40 = 0 or vec_id < 12"), k=20).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    q = [i for i in ids if i % 40 == 0 or i < 12]
    assert sorted(got) == q and all(len(v) == 20 for v in got.values())
    want = brute(ids, x, q, 20)
    assert sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in q) >= 0.9 * 20 * len(q)
    at = {i: n for n, i in enumerate(ids)}
    for i in q:
        assert all(np.isclose(s, (x[at[i]] * x[at[j]]).sum(), rtol=1e-12) for j, s in got[i])
        assert got[i] == sorted(got[i], key=lambda t: (-t[1], t[0]))


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (21, [1.0, 1.0])], schema)
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    assert out == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 2.0), (20, 2, 0, 0.0)]
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
    assert A.nearest(df, df.limit(0)).count() == 0


def test_repeated_ids_and_tiny_vectors(spark):
    tiny = [[1e-200 * (i + 1), 1e-200] for i in range(5)]
    rows = [(20, [1.0, float(i)]) for i in range(60)] + [(21 + i, v) for i, v in enumerate(tiny)] + [(40, [0.0, 1e-220])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = A.nearest(df, df.filter("vec_id % 20 = 0"), k=5).collect()
    got = {}
    for r in out:
        got.setdefault((r["query_id"], r["rank"]), []).append(r)
    # All 60 rows of id 20 are each other's own; they find the six others.
    assert len(got[20, 1]) == 60 and all(r["vec_id"] == 25 for r in got[20, 1] if r["score"] > 1e-199)
    assert {r["vec_id"] for r in out if r["query_id"] == 40} == {20}


def small_codes(rows=500, reach=2):
    x = np.random.default_rng(0).normal(size=(rows, 24))
    codes = A.Codes(x, 1.0, float(np.linalg.norm(x, axis=1).max()), rows)
    codes.tables, codes.reach = 6, reach
    return codes, x


def test_probing_returns_every_code_within_the_radius():
    codes, x = small_codes()
    codes.radius = codes.tables * (codes.reach + 1) - 1
    words, asked = codes.words(x), codes.words(x[:20], query=True)
    apart = np.bitwise_count(words[None] ^ asked[:, None]).sum(axis=2)
    found = set()
    for t in range(codes.tables):
        q, r, looked = A.Share(codes, t, np.arange(500), words).search(asked, 0)
        found |= set(zip(q.tolist(), r.tolist(), strict=True))
        assert len(q) <= looked < 20 * 500  # buckets are looked up, not all rows
    assert found == set(zip(*[a.tolist() for a in np.nonzero(apart <= codes.radius)], strict=True))


def test_shares_hold_the_buckets_that_the_whole_table_has(monkeypatch):
    codes, x = small_codes()
    words, asked = codes.words(x), codes.words(x[:20], query=True)
    whole = A.Share(codes, 0, np.arange(500), words)
    codes.radius = codes.tables * codes.bits
    q, r, _ = whole.search(asked, 0)
    want = set(zip(q.tolist(), r.tolist(), strict=True))
    monkeypatch.setattr(A, "SHARE", 64)
    assert codes.prefix == 3
    row, table, lead, _ = codes.shares(False, words)
    held = {n: row[(table == 0) & (lead == n)] for n in set(lead.tolist())}
    found = []
    qrow, qtable, qlead, spent = codes.shares(True, asked)
    for i in np.flatnonzero(qtable == 0).tolist():
        if (rid := held.get(int(qlead[i]))) is not None and len(rid):
            _, r, _ = A.Share(codes, 0, rid, words[rid]).search(asked[qrow[i] : qrow[i] + 1], int(spent[i]))
            found += [(int(qrow[i]), n) for n in r.tolist()]
    assert len(found) == len(set(found)) and set(found) == want


def test_share_of_rows_looked_up_and_recall_on_the_tables(spark, capsys):
    from pyspark.sql import functions as F

    for name, path in (("sf0.1", "/root/testdata/sf0.1"), ("check_h", "/root/testdata/check_h")):
        df = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding")
        asked = df.filter("vec_id % 20 = 0")
        got = A.nearest(df, asked).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()
        t = df.toArrow()
        ids, x = t.column("vec_id").to_numpy(), A._matrix(t.column("embedding"))
        hit, at = 0, {i: n for n, i in enumerate(ids.tolist())}
        for r in got:
            s = A._scores(x, x[at[r["query_id"]]])
            s[at[r["query_id"]]] = -np.inf
            kth = np.sort(s)[-20]
            hit += sum(s[at[i]] >= kth for i in r["ids"])
        codes, index, _, vectors, total = A.prepare(df, asked, "vec_id", "embedding", 20)
        found = A.candidates(codes, index, vectors)
        many = total * vectors.count()
        looked = found.agg(F.sum("looked")).first()[0] / codes.tables / many
        ranked = found.filter("qid is not null").select("qid", "rid").distinct().count() / many
        recall = hit / (20 * len(got))
        with capsys.disabled():
            print(f"\n{name}: recall {recall:.3f}, {codes.tables} tables of {codes.bits} bits, reach {codes.reach}; a table's lookups meet {looked:.3f} of the rows, {ranked:.3f} are ranked")
        assert recall >= 0.9 and looked < 0.2 and ranked < 0.25
