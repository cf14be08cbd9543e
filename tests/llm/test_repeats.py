import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import repeats, substring_dedup, suffix_dedup
from tesserae.llm.substring_dedup import dedup_words
from tesserae.llm.suffix_dedup import COVER, PERIOD, Suffixes, dedup_substrings, remove_repeats, shifts

from .helpers import corpus, frame, odd_ids, ordered


def byte_brute(rows):
    seen, out = set(), []
    for i, text, *_ in ordered(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def word_brute(rows):
    first, out = {}, []
    for n, (i, text, *_) in enumerate(ordered(rows)):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), n) != n:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(c for c, g in zip(w, gone, strict=True) if not g).decode()))
    return out


key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def test_bytes_like_brute_force(spark):
    for rows in (corpus(), odd_ids(corpus(seed=2))):
        out = dedup_substrings(frame(spark, rows)).collect()
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out]
        assert sorted(got, key=key) == sorted(byte_brute(rows), key=key)
        assert all(r["n_removed"] == sum(s["end"] - s["begin"] for s in r["spans"]) for r in out)
    assert dedup_substrings(frame(spark, [])).count() == 0


def test_words_like_brute_force(spark):
    for rows in (corpus(), odd_ids(corpus(seed=3))):
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in dedup_words(frame(spark, rows)).collect()]
        assert sorted(got, key=key) == sorted(word_brute(rows), key=key)
    assert dedup_words(frame(spark, [])).count() == 0


def test_negative_ids(spark):
    rows = [(r[0] - 100, *r[1:]) for r in corpus(seed=4)]
    out = dedup_substrings(frame(spark, rows)).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out]
    assert sorted(got, key=key) == sorted(byte_brute(rows), key=key)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in dedup_words(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(word_brute(rows), key=key)


def test_probes_hit_blocks_of_other_rows_only(monkeypatch):
    a, b = ([f"{x}{i}".encode() for i in range(30)] for x in "ab")
    rows = [a, b, b[5:20], a + a]  # the last repeats the first, and itself
    tried = []
    whole = substring_dedup.hits
    monkeypatch.setattr(substring_dedup, "hits", lambda *x: tried.append(whole(*x)) or tried[-1])
    for texts, want in ((rows, True), ([a + a, b], False)):
        block = repeats.Segments([1] * len(texts), range(-1, len(texts) - 1), [0] * len(texts), [b" ".join(t) for t in texts])
        seg, place, old = substring_dedup.earlier_windows(block)
        first, expected = {}, []
        for n, t in enumerate(texts):
            expected += [first.setdefault(tuple(t[k : k + 13]), n) != n for k in range(len(t) - 12)]
        assert old.tolist() == expected and any(expected) == want
        assert tried[-1].any() == want and not tried[-1].all()


def in_process(kind, earlier, texts, buckets=8, split=3):
    """Spans by row, and the load of the buckets in steps 1 and 2, with all steps run here, where limits can be set."""
    across = isinstance(kind, repeats.Words)
    tasks = lambda schema, *columns: [pa.RecordBatch.from_arrays([pa.array(c[i::split], t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema]) for i in range(split)]
    run = lambda f, parts: pa.Table.from_batches([b for p in parts for b in f(p)]) if any(parts) else None
    ints = pa.list_(pa.int64())
    sent = run(repeats.send_grams(kind, buckets), [[b] for b in tasks([("_rid", pa.int64()), ("_text", pa.string())], list(range(len(texts))), texts)])
    of = lambda t, b: t.filter(pa.compute.equal(t.column("bucket"), b)).to_batches()
    told, first, second = {}, np.zeros(buckets, "i8"), np.zeros(buckets, "i8")
    for b in range(buckets):
        first[b] = sum(n for n, kept in zip(sent.column("n").to_pylist(), [x == b and y != repeats.TOLD for x, y in zip(sent.column("bucket").to_pylist(), sent.column("sort").to_pylist(), strict=True)], strict=True) if kept)
        for out in repeats.match_grams(across)(of(sent, b)):
            for rid, gram, hot in zip(*[c.to_pylist() for c in out.columns], strict=True):
                told.setdefault(rid, ([], []))[0].append(gram)
                told[rid][1].extend([gram] * hot)
    rids, spans = sorted(told), {}
    shown = tasks([("_rid", pa.int64()), ("_text", pa.string()), ("_grams", ints), ("_hot", ints)], rids, [texts[i] for i in rids], [told[i][0] for i in rids], [told[i][1] for i in rids])
    parts = [b for t in shown for b in repeats.send_segments(kind, buckets, across)([t])]
    if parts:
        sent = pa.Table.from_batches(parts)
        second = np.bincount(sent.column("bucket").to_numpy(), sent.column("n").to_numpy(), buckets)
        for b in range(buckets):
            for out in repeats.join_spans(repeats.match_segments(kind, 4, across, earlier)(of(sent, b))):
                for r in out.to_pylist():
                    spans.setdefault(r["_rid"], []).extend(r["spans"])
    return spans, first, second, len(rids)


BOTH = ((repeats.Bytes(), suffix_dedup.earlier_windows), (repeats.Words(), substring_dedup.earlier_windows))


def removed(kind, spans, texts):
    out = []
    for i, t in enumerate(texts):
        begin, end = repeats.covered(len(kind.load(t)[1]), spans.get(i), kind.window)
        out.append(int((end - begin).sum()))
    return out


def brute(kind, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r[2] for r in (word_brute if isinstance(kind, repeats.Words) else byte_brute)(rows)]


def test_small_batches_blocks_and_buckets_change_nothing(monkeypatch):
    for name, value in (("BATCH", 500), ("PIECE", 700), ("FLUSH_GRAMS", 40), ("FLUSH_BYTES", 900)):
        monkeypatch.setattr(repeats, name, value)
    monkeypatch.setattr(repeats.Bytes, "block", 50)
    monkeypatch.setattr(repeats.Words, "block", 50)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 20)
    texts = [r[1] for r in corpus(60, seed=5)]
    for kind, earlier in BOTH:
        assert removed(kind, in_process(kind, earlier, texts)[0], texts) == brute(kind, texts)


def test_hot_grams_change_nothing(monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH_GRAMS", 400)
    for seed, local, hot in ((6, 2, 3), (7, 1, 1 << 14), (8, 1 << 14, 2), (9, 4, 30)):
        monkeypatch.setattr(repeats, "LOCAL", local)
        monkeypatch.setattr(repeats, "HOT", hot)
        texts = [r[1] for r in corpus(80, seed=seed)]
        for kind, earlier in BOTH:
            assert removed(kind, in_process(kind, earlier, texts)[0], texts) == brute(kind, texts)


def test_common_phrase_is_no_task_s_burden():
    # A phrase of 89 bytes, 12 words, in every document, which repeats nothing by itself.
    phrase = "the same few words are found on each and every page of this site we made ourselves so yes"
    assert len(phrase) == 89
    for kind, earlier in BOTH:
        rng = np.random.default_rng(2)
        prose = lambda: " ".join("".join(map(chr, rng.integers(97, 123, 7).tolist())) for _ in range(20))  # noqa: E731, B023
        words = phrase.split()[:12] if isinstance(kind, repeats.Words) else phrase.split()
        texts = [f"{prose()} {' '.join(words)} {prose()}" for _ in range(3000)]
        spans, first, second, told = in_process(kind, earlier, texts, buckets=64)
        assert not spans and told > 2900  # nothing as long as a window repeats
        assert first.max() < 4 * np.median(first) and second.max() < 4 * np.median(second)


def test_only_hits_in_the_block_index_are_looked_at(monkeypatch):
    # Without reference blocks no probe hits, and nothing is found.
    kind, earlier = BOTH[1]
    texts = [r[1] for r in corpus()]
    monkeypatch.setattr(repeats, "LOCAL", 1 << 30)
    assert removed(kind, in_process(kind, earlier, texts)[0], texts) == brute(kind, texts) and any(brute(kind, texts))
    whole = repeats.Words.asked
    monkeypatch.setattr(repeats.Words, "asked", lambda *a: (*(w := whole(*a))[:2], np.zeros(len(w[2]), bool)))
    assert not any(removed(kind, in_process(kind, earlier, texts)[0], texts))


def test_probes_meet_blocks_at_every_place():
    kind = repeats.Words()
    a = np.arange(100, 140, dtype="u8") * np.uint64(0x1234567)
    for shift in range(7):
        b = np.concatenate([np.arange(shift, dtype="u8"), a[3:16]])
        text, h, ref = kind.asked([a, b], [0, 0])
        index = set(h[ref & (text == 0)].tolist())
        assert index & set(h[text == 1].tolist()) and np.count_nonzero(ref & (text == 0)) == 5


def test_whole_documents_keep_their_columns_and_characters(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = remove_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(got[i]["source"] == s and got[i]["kept"] == "x" for i, _, _, s, _ in rows)
    assert got[21]["text"] is None and got[24]["text"] == "" and got[0]["text"] == rows[0][1]


def test_every_difference_has_a_shift():
    table = shifts()
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert {(i + table[i, j]) % PERIOD, (j + table[i, j]) % PERIOD} <= set(COVER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"aab" * 40, b"b" * 110, b"abcabd" * 20]), min_size=1, max_size=12), st.lists(st.integers(0, 12), min_size=4, max_size=4))
def test_classes_are_equal_strings(parts, phases):
    texts = [t for t in (b"".join(parts[i::4]) for i in range(4)) if len(t) >= 100]
    s = Suffixes(texts, np.array(phases[: len(texts)], "i8"))
    at = np.array([s.base[i] + k for i, t in enumerate(texts) for k in range(len(t) - 99)], "i8")
    strings = [t[k : k + 100] for t in texts for k in range(len(t) - 99)]
    label = s.classes(at, 100)
    assert len(set(zip(label.tolist(), strings, strict=True))) == len(set(strings)) == len(set(label.tolist()))


def test_ties_are_resolved_by_the_ranks_alone():
    # Equal in the first 16 and last 24 bytes: only the cover sample tells them apart.
    texts = [b"x" * 50 + bytes([c]) + b"y" * 49 for c in b"abcab"]
    s = Suffixes(texts, np.arange(5))
    assert len(set(s.classes(s.base, 100).tolist())) == 3
    s.rank = np.zeros_like(s.rank)
    assert len(set(s.classes(s.base, 100).tolist())) == 1


def test_ranks_sort_like_the_bytes():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 99, n).astype("u1").tobytes() for n in (300, 150, 200)]
    s = Suffixes(texts, np.array([0, 5, 12]))
    raw, at = s.data.tobytes() + bytes(100), [13 * i + r for i in range(s.periods) for r in COVER]
    strings = [raw[i : i + 78] for i in at]
    assert np.array_equal(np.argsort(np.array([sorted(set(strings)).index(x) for x in strings]), kind="stable"), np.argsort(s.rank, kind="stable"))


def test_buckets_are_ranges_in_order(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 16)
    data = np.random.default_rng(5).integers(97, 101, 500).astype("u1").tobytes()
    s = Suffixes([data], np.zeros(1, "i8"))
    at = np.arange(401)
    got = [[data[i : i + 8] for i in part.tolist()] for part in s.buckets(at)]
    assert len(got) > 8 and sum(map(len, got)) == 401
    assert all(max(a) < min(b) for a, b in zip(got, got[1:], strict=False) if a and b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=80), st.integers(0, 60))
def test_equal_windows_pick_equal_anchors(symbols, shift):
    kind = repeats.Words()
    a = np.array(symbols, "u8") * np.uint64(0x1234567)
    b = np.concatenate([np.arange(shift, dtype="u8"), a])
    batch = repeats.Batch(kind, [a, b])
    first, last, h = batch.runs()
    text = batch.text(first)
    first, last = first - batch.base[text], last - batch.base[text]
    pick = {}
    for t, x, y, g in zip(text.tolist(), first.tolist(), last.tolist(), h.tolist(), strict=True):
        for w in range(x, y + 1):
            pick[t, w] = g
    assert sorted(k for k in pick if k[0] == 0) == [(0, w) for w in range(len(a) - 12)]
    assert all(pick[0, w] == pick[1, w + shift] for w in range(len(a) - 12))
