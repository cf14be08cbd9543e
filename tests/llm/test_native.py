"""Mixing, preference formatting and URL filters: DataFrame operators."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing as M
from tesserae.llm import preference as C
from tesserae.llm import url_filter as U

from .helpers import corpus, frame, odd_ids


def water(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w, cap, total = {s: 1 + i % 3 for i, s in enumerate(order)}, {s: 3 * sizes[s] for s in order}, sum(sizes.values())
    fixed, target = set(), {}
    while True:
        left, weight = total - sum(cap[s] for s in fixed), sum(w[s] for s in order if s not in fixed)
        target = {s: cap[s] if s in fixed else left * w[s] / weight for s in order}
        over = {s for s in order if target[s] > cap[s] + 1e-9} - fixed
        if not over:
            return target
        fixed |= over


def test_targets_and_takes(spark):
    for rows in (corpus(200), odd_ids(corpus(90, seed=4))):
        out = M.mix_sources(frame(spark, rows).drop("n_chars")).collect()
        sizes, many = Counter(), Counter()
        for _, text, _, source, _ in rows:
            sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        want = water(sizes)
        assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
        by = defaultdict(list)
        for r in out:
            assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
            by[r["source_size"], r["target"]].append(r)
            many[r["repeats"]] += 1
        assert sorted(round(t, 6) for _, t in by) == sorted(round(t, 6) for t in {(sizes[s], want[s]) for s in want} for t in t[1:])
        for (_, target), rs in by.items():
            assert abs(sum(r["taken"] for r in rs) - target) <= 2 * max(r["size"] for r in rs)
        again = M.mix_sources(frame(spark, rows[::-1])).collect()
        assert Counter((r["doc_id"], r["taken"]) for r in out) == Counter((r["doc_id"], r["taken"]) for r in again)


@pytest.mark.parametrize("broadcast", [0, 8])
def test_a_hot_source_and_long_lists_of_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr("tesserae.llm.common.BROADCAST_ROWS", broadcast)  # no broadcast; at 8 the hot source is salted
    monkeypatch.setattr("tesserae.llm.common.HOT_ROWS", 50)
    rows = [(i, "w " * (i % 7 + 1), "en", "hot" if i % 3 else f"s{i % 30}", 1) for i in range(600)]
    out = M.mix_sources(frame(spark, rows)).collect()
    assert len(out) == 600
    source = {i: s for i, _, _, s, _ in rows}
    taken, target = Counter(), {}
    for r in out:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert len(target) == 11 and all(abs(taken[s] - target[s]) <= 7 for s in target)
    assert M.mix_sources(frame(spark, [])).count() == 0


def test_applied_mix_keeps_columns(spark):
    df = frame(spark, corpus(80))
    want = Counter({r["doc_id"]: r["repeats"] for r in M.mix_sources(df).collect()})
    out = M.apply_mix(df)
    assert out.columns == df.columns and Counter(r["doc_id"] for r in out.collect()) == +want


def render(turns):
    text, spans = "", []
    for role, t in turns:
        if role == "assistant":
            spans.append((len(text) + len(role) + 5, len(text) + len(role) + 5 + len(t) + 7))
        text += f"<|{role}|>\n{t}<|end|>\n"
    return text, spans


def test_preference_pairs(spark):
    a = [("system", "s"), ("user", "q é"), ("assistant", "good\nanswer"), ("user", "more"), ("assistant", "yes")]
    b = [("system", "s"), ("user", "q é"), ("assistant", "bad"), ("user", "more"), ("assistant", "yes")]
    talks = {0: a, 1: b, 2: a, 3: a, 4: [("user", "hi")], 6: [("user", "x")], 7: [("assistant", "y"), ("assistant", "")]}
    rows = [(c, n, r, t, "x") for c, ts in talks.items() for n, (r, t) in enumerate(ts)]
    rows += [(8, None, None, None, "x"), (8, 1, "user", "u", "x"), (8, 1, "user", "u", "x"), (None, 0, "user", "lost", "x")]
    talks[8] = [("user", "u"), ("user", "u"), ("unknown", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(3)
    out = {r["pair_id"]: r for r in C.format_adjacent(df).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4]
    for p, r in out.items():
        x, y = talks.get(2 * p, []), talks.get(2 * p + 1, [])
        n = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
        assert (r["n_prompt_turns"], r["prompt"]) == (n, render(x[:n])[0])
        for side, turns in (("chosen", x), ("rejected", y)):
            text, spans = render(turns[n:])
            assert r[side] == text and r[f"{side}_mask"] == ",".join(f"{u}:{v}" for u, v in spans)
            assert all(text[u:v].endswith("<|end|>") for u, v in spans)
    pairs = spark.createDataFrame([(5, 0, 1), (6, 1, None), (7, 0, 99)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in C.format_preferences(df, pairs).collect()}
    assert got[5]["chosen"] == out[0]["chosen"] and got[6]["rejected"] == "" and got[7]["n_prompt_turns"] == 0
    assert C.format_adjacent(df.limit(0)).count() == 0


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule[0], rule[1]


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x=/fr/", "https://example.com/en/", "https://example.com/en", "http://a.b.net/es/2#f", "x://net/fr/", "http://internet/es/", "http://É.com/ä", "no scheme", "://", "http:///en/", None, "", "http://com", "http://com/", "http://com?/", "a\nb://x.com/\n", "http://org/es/"]
    urls = urls * 2 + [f"http://h{i % 50}.example.{t}/{x}/{i}" for i in range(300) for t, x in (("com", "en"), ("net", "fr"), ("org", "de"))]
    df = spark.createDataFrame([(i if i != 3 else None, u, "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, key string").repartition(3)
    rules = [*U.RULES, ("example.org", "/de/1", "block"), ("h7.example.org", "/de/17", "allow")]
    out = U.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert Counter((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out) == Counter((u, *judge(u, rules)) for u in urls)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in U.filter_urls(df, none).collect()} == {"allow"}
    assert U.filter_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


@pytest.mark.parametrize("constant", [1 << 16, 64])
def test_the_cascade_is_exact_over_its_universe(spark, monkeypatch, constant):
    monkeypatch.setattr(U, "CONSTANT_BITS", constant)
    universe = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.filter(F.substring("key", 2, 9).cast("int") % 3 == 0).union(universe.limit(4))
    cascade = U.BloomCascade(listed, universe)
    assert len(cascade.levels) > 1
    got = {r["key"] for r in universe.filter(cascade.contains(F.col("key"))).collect()}
    assert got == {r["key"] for r in listed.collect()}
    empty = U.BloomCascade(listed.limit(0), universe)
    assert universe.filter(empty.contains(F.col("key"))).count() == 0


def test_workers_keep_one_memory_and_give_it_back():
    from tesserae.llm.common import remembered, tidy

    first = remembered("first", dict)
    assert remembered("first", dict) is first
    second = remembered("second", dict)
    assert remembered("first", dict) is not first
    assert second is not remembered("second", dict)  # it was dropped when the first was asked for again
    kept = remembered("kept", dict)
    assert list(tidy(lambda b: (x + 1 for x in b), "kept")([1, 2])) == [2, 3]
    assert remembered("kept", dict) is kept
    assert list(tidy(iter)([])) == []
    assert remembered("kept", dict) is not kept
