import zlib

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import quality as Q

from .helpers import corpus, frame, odd_ids


def labelled(n=400):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [str(x) for x in rng.choice(words, rng.integers(3, 60))]
        bad = i % 4 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad and i % 8 else " ".join([w[0]] * 30 + w[:5]) if bad else " ".join(w).capitalize() + "."
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_held_out_texts_are_told_apart(spark):
    docs, labels = labelled()
    df = frame(spark, docs)
    model = Q.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in Q.score(df, model).collect()}
    assert len(got) == len(docs)
    test = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 50 and np.mean([(s >= 0.7) == y for s, y in test]) >= 0.95
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", Q.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in docs}
    kept = Q.keep_quality(df, model).collect()
    assert {r["doc_id"] for r in kept} == {i for i, s in got.items() if s >= 0.7} and kept[0]["score"] == "x"


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    docs, labels = labelled(120)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    renamed = [(i, t, "xx", f"q{labels[i][1]}", 0) for i, t, *_ in docs]
    a = Q.train(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    b = Q.train(frame(spark, renamed), spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_awkward_rows(spark):
    df = frame(spark, odd_ids(corpus()))
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None), (3, 0), (3, 1), (999, 0)], "doc_id long, quality int")
    model = Q.train(df, labels)
    out = Q.score(df, model).collect()
    assert len(out) == df.count() and all(0 <= r["score"] <= 1 for r in out)
    none = Q.train(df, labels.limit(0))
    assert none[1] == 0 and {r["score"] for r in Q.score(df, none).collect()} == {0.5}
    assert Q.score(df.limit(0), model).count() == 0 and Q.keep_quality(df.limit(0), model).columns == df.columns


def test_scores_are_sparse_dot_products():
    f, weights = Q.Featurizer(), np.random.default_rng(1).normal(size=1 << Q.BITS).astype("f4")
    for text in ("", "one", "One two, THREE!! two two " * 9):
        kinds = f.kinds(text)
        slots, values = Q.sparse(kinds)
        assert np.isclose(sum(float(weights[k].mean(dtype="f8")) for k in kinds), float(weights[slots].astype("f8") @ values), atol=1e-4)
