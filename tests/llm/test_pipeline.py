import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tesserae.llm import queries
from tests.oracle import compare

from .helpers import corpus, odd_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in corpus(120)]
    rows += [(1000 + i, " ".join(["JUNK!!"] * (20 + i)), "en", "a", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 0 if r[0] >= 1000 else 1) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages_in_order(spark, sf):
    d, rows = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        seen[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "packing":
            assert docs.columns == columns
    got = {n: {r["doc_id"]: r for r in x.collect()} for n, x in seen.items() if n != "packing"}
    assert not any(i >= 1000 for i in got["quality"]) and len(got["quality"]) > 100
    texts = [r["text"] or "" for r in got["near_duplicates"].values()]
    assert len(set(texts)) == len(texts) < len(got["quality"])
    assert set(got["repeats"]) == set(got["near_duplicates"])
    assert any((got["repeats"][i]["text"] or "") != (got["near_duplicates"][i]["text"] or "") for i in got["repeats"])
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got["repeats"].values())
    copies = Counter(r["doc_id"] for r in seen["mix"].collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(got["repeats"])
    pieces = seen["packing"].collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == copies
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_stages_on_awkward_documents(spark, sf):
    d, _ = sf
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None)] * 3, odd_ids(corpus(40))):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (docs.count() > 0) == (len(rows) > 3) or len(rows) == 3


def test_run_is_the_stages(spark, sf):
    d, _ = sf
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_like_their_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


def test_contract_columns(spark):
    want = {
        "op1_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature tiles", "op2_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op3_neighbours": "query_id rank vec_id score", "op4_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256", "op5_quality": "doc_id held_out score predicted",
        "op6_mix": "doc_id size source_size target taken", "op8_substrings": "doc_id n_words n_removed kept_sha256", "op9_urls": "page_id host path rule verdict", "op10_simhash": "doc_id fingerprint component_id",
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns == columns.split(), name
    held = {r["doc_id"]: r["held_out"] for r in queries.QUERIES["op5_quality"](spark, SF).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in held.items())
