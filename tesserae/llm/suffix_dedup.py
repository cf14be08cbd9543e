"""Suffix-array dedup: difference-cover blockwise construction.

A task holds the segments of its grams (see repeats.py) and works on a block of them at a time. First the ranks of a
difference-cover sample of the block's places are found, by doubling steps of the cover's period. Then the suffixes
are dealt into buckets, ranges of their first bytes, and one bucket after the other is sorted: by the first 16 bytes,
and where these tie by the sample, as for any two places some shift below the period brings both onto sampled places,
whose ranks compare all the next bytes at once. So ties of any kind cost one look at two ranks, and memory is that of
one block's text, its sample and a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, with_row_ids
from .repeats import Bytes, Segments, covered, repeat_spans

#: Period of the difference cover, and its residues: every difference modulo the period is one of two residues.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes that a sample's rank compares: six periods, by doubling 1, 2, 4 and adding 2.
RANKED = 6 * PERIOD
#: Suffixes of a bucket, about; those that share eight bytes stay together.
BUCKET = 1 << 17

_SLOT = np.array([COVER.index(r) if r in COVER else -1 for r in range(PERIOD)])


def shifts(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """shifts[i, j]: the least d below the period for which i + d and j + d both are in the cover."""
    inside = np.isin(np.arange(period), cover)
    d = np.arange(period)
    both = inside[(np.arange(period)[:, None, None] + d) % period] & inside[(np.arange(period)[None, :, None] + d) % period]
    return both.argmax(axis=2)


_SHIFTS = shifts()


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row by its keys, first key first; equal rows share a rank."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), "i8")
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), "i8")
    out[order] = np.cumsum(new)
    return out


class Suffixes:
    """Strings one after the other, each from a place with its own phase in the period, and their sample's ranks."""

    def __init__(self, parts: list[bytes], phase: np.ndarray):
        size = np.array([len(p) for p in parts], "i8")
        slots = -(-(phase + size) // PERIOD)
        self.periods = int(slots.sum())
        self.base = PERIOD * (np.cumsum(slots) - slots) + phase
        gap, after = bytes(2 * PERIOD), (PERIOD * slots - phase - size).tolist()
        self.data = np.frombuffer(b"".join([x for p, f, a in zip(parts, phase.tolist(), after, strict=True) for x in (gap[:f], p, gap[:a])]) + gap, "u1")
        self.word = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,))
        self.rank = self.sample_ranks()

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as a number that sorts like them."""
        return self.word[at].astype("u8")

    def sample_ranks(self) -> np.ndarray:
        """Rank, among all sampled places, of the RANKED bytes from each; four places a period, in order."""
        at = (np.arange(self.periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        many = len(COVER)

        def both(head: np.ndarray, tail: np.ndarray, periods: int) -> np.ndarray:
            later = np.concatenate([tail[periods * many :], np.zeros(min(len(tail), periods * many), "i8")])
            return _dense(head * (int(tail.max(initial=0)) + 1) + later)

        one = _dense(self.eight(at), self.eight(at + PERIOD - 8))
        two = both(one, one, 1)
        four = both(two, two, 2)
        return both(four, two, 4).astype("i4")

    def compare(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Order (-1, 0, 1) of the RANKED bytes from some place below the period on, the same for both."""
        d = _SHIFTS[i % PERIOD, p % PERIOD]
        at = lambda x: x // PERIOD * len(COVER) + _SLOT[x % PERIOD]
        return np.sign(self.rank[at(i + d)].astype("i8") - self.rank[at(p + d)])

    def classes(self, at: np.ndarray, window: int) -> np.ndarray:
        """A number for each suffix, at places `at`, that is the same for those with equal first `window` bytes."""
        label = np.arange(len(at))
        if not len(at):
            return label
        first, second = self.eight(at), self.eight(at + 8)
        order = np.lexsort((second, first))
        new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        tied = size[group] > 1
        todo, group = order[tied], group[tied]
        tails = (window - 24, window - 16, window - 8)
        while todo.size:  # quicksort of all groups at once: each against its middle suffix
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(head, len(group)))
            pivot = np.repeat(todo[head + size // 2], size)
            i, p = at[todo], at[pivot]
            less = self.compare(i, p)
            for t in tails:
                open_ = np.flatnonzero(less == 0)
                x, y = self.eight(i[open_] + t), self.eight(p[open_] + t)
                less[open_] = (x > y).astype("i8") - (x < y)
            same = less == 0
            label[todo[same]] = pivot[same]
            rest = ~same
            todo, key = todo[rest], group[rest] * 2 + (less[rest] > 0)
            back = np.argsort(key, kind="stable")
            todo, key = todo[back], key[back]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if key.size else np.empty(0, bool)
            group = np.cumsum(new) - 1
            size = np.bincount(group) if group.size else np.empty(0, "i8")
            tied = size[group] > 1 if group.size else np.empty(0, bool)
            todo, group = todo[tied], group[tied]
        return label

    def buckets(self, at: np.ndarray):
        """The suffixes at places `at`, by number, in buckets: ranges of their first eight bytes, least first."""
        many = -(-len(at) // BUCKET)
        if many < 2:
            yield np.arange(len(at))
            return
        first = self.eight(at)
        some = np.sort(first[:: max(1, len(first) // (64 * many))])
        cuts = np.unique(some[:: max(1, len(some) // many)][1:])
        bucket = np.searchsorted(cuts, first, "right").astype("u2" if len(cuts) < 65535 else "u4")
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(len(cuts) + 2))
        for a, b in zip(ends, ends[1:], strict=False):
            yield order[a:b]


def earlier_windows(block: Segments, window: int = Bytes.window):
    """Whether each window of the block's segments has an equal one in an earlier segment or place."""
    suffixes = Suffixes(block.data, block.start % PERIOD)
    many = np.array([len(d) for d in block.data], "i8") - window + 1
    owner = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at, old = suffixes.base[owner] + place, np.zeros(len(owner), bool)
    for part in suffixes.buckets(at):
        label = suffixes.classes(at[part], window)
        first = np.full(len(part), len(at))
        np.minimum.at(first, label, part)
        old[part] = first[label] != part
    return owner, place, old


def without(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """The UTF-8 text without the runs of bytes, each shrunk to whole characters."""
    out, at = [], 0
    for a, z in runs:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]]).decode()


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept, text[, _carry]) of every row: bytes covered by a 100-byte
    string of one row that also starts earlier, in a row with a smaller id or at an earlier place, are removed.

    spans: the removed runs as array of (begin, end) byte offsets; kept: the other bytes, joined; text: the same, but characters cut by the ends of a run stay. Strings are
    judged on the input. Null texts are empty; texts under 100 bytes stay as they are; very long texts are worked
    on in overlapping pieces. Rows go by (id, nulls last, then text), so of repeated rows the first stays. An empty
    table gives an empty result; columns other than those to carry, which come as one struct _carry, are left out.
    """
    rows, _ = with_row_ids(df, id_col, text_col, carry)
    marked = repeat_spans(rows, Bytes(), False, earlier_windows)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary, text string"
    extra = ["_carry"] if carry else []
    schema += f", _carry {rows.schema['_carry'].dataType.simpleString()}" if carry else ""

    def run(batches):
        for b in batches:
            out = []
            for text, copy, spans in zip(b.column("_text").to_pylist(), b.column("copy").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                n = len(raw)
                if copy and n >= Bytes.window:
                    begin, end = np.array([0]), np.array([n])
                else:
                    begin, end = covered(n, spans, Bytes.window)
                kept = b"".join(raw[a:z] for a, z in zip([0, *end.tolist()], [*begin.tolist(), n], strict=True))
                runs = list(zip(begin.tolist(), end.tolist(), strict=True))
                out.append((n, n - len(kept), len(begin), [{"begin": a, "end": z} for a, z in runs], kept, without(raw, runs)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[pa.array(c, t) for c, t in zip(columns, target.types[1:7], strict=True)], *[b.column(c) for c in extra]], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    out = marked.select("_id", "_text", "copy", "spans", *extra).mapInArrow(tidy(run), schema)
    return out.withColumnRenamed("id", id_col)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeats of 100 bytes and more cut from the text, and its other columns as they were.

    Characters that a run cuts stay. A null text stays null; a text that repeats wholly is empty, its row stays.
    """
    rest = tuple(c for c in df.columns if c not in (id_col, text_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.col(text_col).isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"))
    out = dedup_substrings(rows, "id", "text", ("row",)).withColumn("_row", F.col("_carry.row"))
    named = {id_col: F.col("id"), text_col: F.when(~F.col("_row.none"), F.col("text"))} | {c: F.col(f"_row.c{i}") for i, c in enumerate(rest)}
    return out.select(*[named[c].alias(c) for c in df.columns])


def op4_suffixes(spark, sf_dir):
    from .common import documents

    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(0, len(x) // 2 - 99), lambda i: {'i': i, 'm': md5(substr(x, 2 * i + 1, 200))})) AS g FROM d),
f AS (SELECT doc_id, g.i AS i, row_number() OVER (PARTITION BY g.m ORDER BY doc_id, g.i) AS n FROM g),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM f WHERE n > 1),
h AS (SELECT doc_id, i AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE before IS NULL OR before + 100 < i),
t AS (SELECT doc_id, i + 100 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s WHERE after IS NULL OR i + 100 < after),
r AS (SELECT doc_id, r, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY r), 0) AS begin FROM h JOIN t USING (doc_id, r)),
k AS (SELECT doc_id, string_agg(substr(x, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY r) AS head, max(z) AS z, sum(z - a) AS n, count(*) AS spans FROM r JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
