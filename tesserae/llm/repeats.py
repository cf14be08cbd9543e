"""Exact repeats of W consecutive symbols (bytes or words) over all texts.

1. Texts send hashed grams of k symbols, dealt by hash, to find those that may be part of a repeat. Of bytes these
   are anchors: each window of W picks its k-gram of least hash, equal windows pick equal grams, and a gram that
   occurs once rules out every window that picked it. Of words these are the non-overlapping reference blocks of all
   texts, an index that every rolling window of k words probes; what hits no block of another text is ruled out.
2. Windows that are left go to buckets in segments, runs of windows that share an anchor: by the anchor's hash, so
   that equal windows meet, or, where a gram is hot, one by one by the whole window's hash. A bucket finds the windows
   that occur earlier, by the method of the operator;
3. the spans of these windows go back to their texts.

Texts are moved once, by row id; all three steps read that one exchange. Copies of a text are set aside first, and a
task sends equal segments once. A gram that a task sees over LOCAL times, or a bucket over HOT times, is hot: what
its bucket gets is a mark a task, and its windows are spread, so that neither a common passage nor a common phrase
between different texts is the burden of one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, remembered, tidy

#: Symbols that are worked on at a time, at least one text.
BATCH = 1 << 18
#: Texts longer than this many symbols are cut into overlapping pieces; a multiple of every gram's length.
PIECE = 7 << 23
#: Grams or bytes of segments that a task gathers before it sends them.
FLUSH_GRAMS, FLUSH_BYTES = 1 << 19, 1 << 23
#: A gram is hot that occurs more often than this among the grams that a task sends at a time, or in its bucket.
LOCAL, HOT = 128, 1 << 14
#: Words whose hash a worker remembers, and under which name.
CACHE, MEMORY = 1 << 18, "word hashes"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
_POS = np.uint64((1 << 28) - 1)


class Bytes:
    """Windows of bytes of the UTF-8 text; `block`: symbols of segments that a bucket's task works on at a time."""

    window, gram, block = 100, 32, 1 << 21

    def load(self, text: str | None) -> tuple[bytes, np.ndarray]:
        raw = (text or "").encode()
        return raw, np.frombuffer(raw, "u1")

    def cut(self, loaded: bytes, begin: int, end: int) -> bytes:
        return loaded[begin:end]

    def windows(self, data: bytes) -> int:
        return len(data) - self.window + 1

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        """Hash of the 32 bytes from each position."""
        padded = np.concatenate([symbols, np.zeros(8, "u1")])
        h = np.ndarray(len(symbols) - 7, "<u8", padded, strides=(1,)) * _M1
        h ^= h >> _S29
        h = h[:-8] * _M2 + h[8:]
        h ^= h >> _S32
        h = h[:-16] * _M1 + h[16:]
        h ^= h >> _S29
        h *= _M2
        h ^= h >> _S32
        return h

    def asked(self, symbols: list[np.ndarray], offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, whether it is a reference) of the grams that texts send: their anchors."""
        batch = Batch(self, symbols)
        first, _, h = batch.runs()
        return batch.text(first), h, np.zeros(len(h), bool)

    def left(self, batch: Batch, told: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, hash) of the runs whose anchor repeats."""
        first, last, h = batch.runs()
        hit = np.isin(keys(h, buckets), told)
        return first[hit], last[hit], h[hit]

    def copies(self, joined: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether the windows at two places are equal, place by place."""
        view = np.lib.stride_tricks.sliding_window_view(joined, self.window)
        parts = [(view[at[i : i + 65536]] == view[of[i : i + 65536]]).all(axis=1) for i in range(0, len(at), 65536)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Words:
    """Windows of words; a segment is its words with a space between. A gram is a block: the most words for which each
    window holds a whole one of those at multiples of its length."""

    window, gram, block = 13, 7, 1 << 18

    def load(self, text: str | None) -> tuple[tuple[bytes, np.ndarray], np.ndarray]:
        words = (text or "").encode().split()
        cache = remembered(MEMORY, _Hashes)
        if len(cache) > CACHE:
            cache.clear()
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
        return (b" ".join(words), np.concatenate([[0], ends])), np.fromiter([cache[w] for w in words], "u8", len(words))

    def cut(self, loaded: tuple[bytes, np.ndarray], begin: int, end: int) -> bytes:
        joined, at = loaded
        return joined[at[begin] : at[end] - 1]

    def windows(self, data: bytes) -> int:
        return data.count(b" ") - self.window + 2

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols) - self.gram + 1
        h = symbols[:n].copy()
        for i in range(1, self.gram):
            h = h * _M1 + symbols[i : i + n]
            h ^= h >> _S29
        h *= _M2
        h ^= h >> _S32
        return h

    def asked(self, symbols: list[np.ndarray], offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every rolling gram; those at multiples of its length are the reference blocks."""
        batch = Batch(self, symbols)
        at = batch.inside(self.gram)
        text = batch.text(at)
        return text, batch.g[at], (at - batch.base[text] + np.array(offsets)[text]) % self.gram == 0

    def left(self, batch: Batch, told: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of windows that hold a block, or a rolling window, with a hit."""
        at = batch.inside(self.gram)
        hit = at[np.isin(keys(batch.g[at], buckets), told)]
        step = np.zeros(len(batch.joined) + 2, "i8")
        np.add.at(step, np.maximum(0, hit - (self.window - self.gram)), 1)
        np.add.at(step, hit + 1, -1)
        return batch.runs(np.cumsum(step)[: len(batch.joined)] > 0)

    def copies(self, joined: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.zeros(len(at), bool)  # hashes of words don't prove it; the texts are compared later


def window_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the place of the least, leftmost in ties (by the hash's leading 36 bits)."""
    m = (g & ~_POS) | np.arange(len(g), dtype="u8")
    done = 1
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[: len(m) - (width - done)], m[width - done :])
    return (m & _POS).astype("i8")


class Batch:
    """Symbols of several texts one after the other; places count over all of them."""

    def __init__(self, kind, symbols: list[np.ndarray]):
        self.kind, lengths = kind, np.array([len(s) for s in symbols], "i8")
        self.ends = np.cumsum(lengths)
        self.base, self.joined = self.ends - lengths, np.concatenate(symbols)
        self.g = kind.grams(self.joined) if len(self.joined) >= kind.window else np.empty(0, "u8")

    def text(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def inside(self, size: int) -> np.ndarray:
        """Places from which so many symbols are of the same text."""
        step = np.zeros(len(self.joined) + 1, "i8")
        np.add.at(step, np.maximum(self.base, self.ends - size + 1), 1)
        np.add.at(step, self.ends, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) == 0)

    def runs(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, hash) of the runs of windows with a common anchor, of all windows or those to keep."""
        starts = self.inside(self.kind.window)
        if keep is not None:
            starts = starts[keep[starts]]
        if not starts.size:
            return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u8")
        at = window_minima(self.g, self.kind.window - self.kind.gram + 1)[starts]
        edge = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1))
        head = np.concatenate([[0], edge + 1])
        return starts[head], starts[np.concatenate([edge, [len(starts) - 1]])], self.g[at[head]]

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        kind, out = self.kind, np.zeros(len(at), "u8")
        for i in [*range(0, kind.window - kind.gram, kind.gram), kind.window - kind.gram]:
            out = (out ^ self.g[at + i]) * _M1
            out ^= out >> _S29
        return out


def keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """What is sent of a hash: its bucket and 32 bits."""
    return (((h >> _S32) % np.uint64(buckets) << _S32) | (h & np.uint64(0xFFFFFFFF))).astype("i8")


def _pieces(kind, rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Batches of (row, loaded text, offset, symbols)."""
    batch, size = [], 0
    for row in rows:
        loaded, symbols = kind.load(row[1])
        if len(symbols) < kind.window:
            continue
        for at in range(0, len(symbols) - kind.window + 1, PIECE):
            part = symbols[at : at + PIECE + kind.window - 1]
            batch.append((row, loaded, at, part))
            size += len(part)
            if size >= BATCH:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _rows(batches: Iterable[pa.RecordBatch], columns: int = 6) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns[:columns])


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, kind: str = "i8") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


#: What a row of grams is: grams of rows, with a bit each that tells whether it is part of the index; grams and rows that
#: need no answer as their gram is hot; and the mark of hot grams for their bucket.
ASKED, TOLD, MARK = range(3)
GRAM_ROWS = "bucket int, n int, sort int, grams binary, rids binary"


def send_grams(kind, buckets: int) -> Callable:
    """Step 1 at the texts: (rid, text) to blobs of (gram, rid) by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("sort", pa.int32()), ("grams", pa.binary()), ("rids", pa.binary())])

    def blobs(sort, bucket, gram, rid, ref=None):
        order = np.argsort(bucket.astype("u4"), kind="stable")
        bucket, gram, rid = bucket[order], gram[order], rid[order]
        bits = (lambda a, b: b"") if ref is None else lambda a, b: np.packbits(ref[order[a:b]]).tobytes()
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cut], [*cut, len(bucket)], strict=True):
            if b > a:
                yield int(bucket[a]), int(b - a), sort, gram[a:b].tobytes() + bits(a, b), _pack(np.diff(rid[a:b], prepend=0))

    def flush(h, rid, ref):
        # Hot grams are looked for among those that share their last bits with many.
        cell = (h & np.uint64((1 << 20) - 1)).astype("i8")
        maybe = np.flatnonzero(np.bincount(cell, minlength=1 << 20)[cell] > LOCAL)
        key, rows = keys(h, buckets), []
        gram, times = np.unique(key[maybe], return_counts=True)
        hot = gram[times > LOCAL]
        here = np.isin(key, hot) if hot.size else np.zeros(len(key), bool)
        if hot.size:
            pair = np.unique(np.stack([rid[here], key[here]]), axis=1)
            rows += blobs(TOLD, pair[0] % buckets, pair[1], pair[0])
            rows += blobs(MARK, hot >> 32, hot.astype("u4"), np.zeros(len(hot), "i8"))
        i = np.flatnonzero(~here)
        rows += blobs(ASKED, key[i] >> 32, key[i].astype("u4"), rid[i], ref[i])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        hs, rids, refs, size = [], [], [], 0
        for batch in _pieces(kind, _rows(batches, 2)):
            text, h, ref = kind.asked([p[3] for p in batch], [p[2] for p in batch])
            hs.append(h)
            rids.append(np.array([p[0][0] for p in batch])[text])
            refs.append(ref)
            size += len(h)
            if size >= FLUSH_GRAMS:
                yield flush(np.concatenate(hs), np.concatenate(rids), np.concatenate(refs))
                hs, rids, refs, size = [], [], [], 0
        if size:
            yield flush(np.concatenate(hs), np.concatenate(rids), np.concatenate(refs))

    return run


def match_grams(across_rows: bool) -> Callable:
    """Step 1 in the buckets: rows (rid, gram, hot) of the grams that a text's windows can repeat by.

    across_rows: of a gram with a reference in a row before, and of references with the gram in a row after; else of
    grams that occur twice. Of a hot gram all rows are told, as they have to deal it in the same way.
    """

    def run(batches):
        gram, rid, ref, marks = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, bool)], [np.empty(0, "i8")]

        def out(rid, gram, hot):
            for i in range(0, len(rid), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(rid[part]), pa.array(gram[part]), pa.array(hot[part])], ["_rid", "gram", "hot"])

        for bucket, n, sort, grams, rids in _rows(batches, 5):
            ids = np.cumsum(_unpack(rids))
            if sort == TOLD:
                yield from out(ids, np.frombuffer(grams, "i8", n), np.ones(n, bool))
                continue
            key = np.frombuffer(grams, "u4", n).astype("i8") | bucket << 32
            if sort == MARK:
                marks.append(key)
            else:
                gram.append(key)
                rid.append(ids)
                ref.append(np.unpackbits(np.frombuffer(grams, "u1", offset=4 * n), count=n).astype(bool))
        gram, rid, ref = np.concatenate(gram), np.concatenate(rid), np.concatenate(ref)
        if not len(gram):
            return
        order = np.argsort(gram)
        gram, rid, ref = gram[order], rid[order], ref[order]
        head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.append(head, len(gram)))
        hot = np.repeat((size > HOT) | np.isin(gram[head], np.concatenate(marks)), size)
        if across_rows:
            limit = np.iinfo("i8")
            before = np.repeat(np.minimum.reduceat(np.where(ref, rid, limit.max), head), size)
            after = np.repeat(np.maximum.reduceat(rid, head), size)
            tell = hot | (before < rid) | (ref & (rid < after))
        else:
            tell = hot | np.repeat(size > 1, size)
        yield from out(rid[tell], gram[tell], hot[tell])

    return run


class Segments:
    """Segments with their grams, in columns; text i is data[i]."""

    def __init__(self, h, rid, start, data):
        self.h, self.rid, self.start, self.data = np.asarray(h, "u8"), np.asarray(rid, "i8"), np.asarray(start, "i8"), data

    def take(self, order: np.ndarray) -> Segments:
        return Segments(self.h[order], self.rid[order], self.start[order], [self.data[i] for i in order.tolist()])

    def in_order(self) -> Segments:
        return self.take(np.lexsort((self.start, self.rid)))

    def without_copies(self, across_rows: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places kept, and places of segments equal to an earlier one (if across_rows: of another row). Needs in_order()."""
        first: dict[bytes, int] = {}
        kept, gone = [], []
        rid = self.rid.tolist()
        for i, d in enumerate(self.data):
            j = first.setdefault(d, i)
            (kept if i == j or across_rows and rid[i] == rid[j] else gone).append(i)
        return np.array(kept, "i8"), np.array(gone, "i8")

    def blob(self) -> bytes:
        return _pack(self.h, self.rid, self.start, np.array([len(d) for d in self.data], "i8"), np.frombuffer(b"".join(self.data), "u1"))

    @staticmethod
    def read(n: int, blob: bytes) -> Segments:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        h, rid, start, size = (np.frombuffer(raw, t, n, 8 * n * i) for i, t in enumerate(("u8", "i8", "i8", "i8")))
        ends = (np.cumsum(size) + 32 * n).tolist()
        return Segments(h, rid, start, [raw[a:b] for a, b in zip([32 * n, *ends], ends, strict=False)])

    @staticmethod
    def join(parts: list[Segments]) -> Segments:
        if not parts:
            return Segments([], [], [], [])
        return Segments(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("h", "rid", "start")), [d for p in parts for d in p.data])


SEGMENT_ROWS = "bucket int, n int, spans boolean, data binary"


def send_segments(kind, buckets: int, across_rows: bool) -> Callable:
    """Step 2 at the texts: (rid, text, grams told, those that are hot) to blobs of segments by bucket, and spans known
    here."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("spans", pa.bool_()), ("data", pa.binary())])

    def flush(parts):
        s = Segments.join(parts).in_order()
        kept, gone = s.without_copies(across_rows)
        rows = []
        if gone.size:
            many = np.array([kind.windows(s.data[i]) for i in gone.tolist()], "i8")
            rows.append((int(s.rid[gone[0]] % buckets), len(gone), True, _pack(s.rid[gone], s.start[gone], many)))
        bucket = ((s.h[kept] >> _S32) % np.uint64(buckets)).astype("i4")
        order = np.lexsort((s.h[kept], bucket))
        bucket, kept = bucket[order], kept[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cut], [*cut, len(bucket)], strict=True):
            rows.append((int(bucket[a]), int(b - a), False, s.take(kept[a:b]).blob()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def alone(batch, rid, first, last):
        """Windows of hot runs one by one, but for those that repeat one of an earlier row or place of the batch; and
        the places of these."""
        at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        at = at[np.lexsort((at, rid[batch.text(at)]))]
        h = batch.window_hashes(at)
        _, lead, same = np.unique(h, return_index=True, return_inverse=True)
        lead = lead[same]
        later = np.flatnonzero(lead != np.arange(len(at)))
        if across_rows:
            later = later[rid[batch.text(at[later])] != rid[batch.text(at[lead[later]])]]
        copy = np.zeros(len(at), bool)
        copy[later] = kind.copies(batch.joined, at[later], at[lead[later]])
        return at[~copy], h[~copy], at[copy]

    def known(batch, rid, offset, at):
        text = batch.text(at)
        schema_row = _pack(rid[text], at - batch.base[text] + offset[text], np.ones(len(at), "i8"))
        return int(rid[text[0]] % buckets), len(at), True, schema_row

    def run(batches):
        parts, size = [], 0
        for pieces in _pieces(kind, _rows(batches, 4)):
            batch = Batch(kind, [p[3] for p in pieces])
            told, hot = (np.unique(np.concatenate([np.array(p[0][c], "i8") for p in pieces])) for c in (2, 3))
            rid, offset = np.array([p[0][0] for p in pieces], "i8"), np.array([p[2] for p in pieces], "i8")
            first, last, h = kind.left(batch, told, buckets)
            if not first.size:
                continue
            spread = np.isin(keys(h, buckets), hot)
            if spread.any():
                at, own, copies = alone(batch, rid, first[spread], last[spread])
                if copies.size:
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(known(batch, rid, offset, copies), schema.types, strict=True)], schema=schema)
                first, last, h = (np.concatenate([a[~spread], b]) for a, b in ((first, at), (last, at), (h, own)))
            text = batch.text(first)
            first, last = (a - batch.base[text] + offset[text] for a in (first, last))
            data = [kind.cut(pieces[t][1], a, b + kind.window) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
            parts.append(Segments(h, rid[text], first, data))
            size += sum(map(len, data))
            if size >= FLUSH_BYTES:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


SPAN_ROWS = "bucket int, n int, data binary"


def _span_blobs(spans: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Spans (rid, first window, number of windows), arrays of three rows, as blobs by rid."""
    rows = np.concatenate(spans, axis=1)
    bucket = rows[0] % buckets
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[:, order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    parts = [(int(bucket[i]), j - i, _pack(rows[:, i:j])) for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "n", "data"])


SPANS = "_rid long, spans array<struct<first:long,many:long>>"


def join_spans(batches):
    """Step 3: a row for each row id, with its spans in order; those that touch are one."""
    got = [_unpack(data).reshape(3, n) for _, n, data in _rows(batches, 3)]
    if not got:
        return
    rid, first, many = np.concatenate(got, axis=1)
    order = np.lexsort((first, rid))
    rid, first, end = rid[order], first[order], (first + many)[order]
    # The furthest end so far of the same row: ends are compared after their row's number.
    row = np.cumsum(np.concatenate([[0], np.diff(rid) != 0])).astype("i8")
    wide = int(end.max()) + 1
    upto = np.maximum.accumulate(row * wide + end)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (row[1:] * wide + first[1:] > upto[:-1])])
    head = np.flatnonzero(new)
    last = upto[np.append(head[1:] - 1, len(end) - 1)] - row[head] * wide
    rid, first, many = rid[head], first[head], last - first[head]
    begin = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
    ends = np.append(begin[1:], len(rid))
    for i in range(0, len(begin), 4096):
        a, z = begin[i], ends[min(i + 4096, len(ends)) - 1]
        offsets = np.append(begin[i : i + 4096], z) - a
        items = pa.StructArray.from_arrays([pa.array(first[a:z]), pa.array(many[a:z])], ["first", "many"])
        yield pa.RecordBatch.from_arrays([pa.array(rid[begin[i : i + 4096]]), pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), items)], ["_rid", "spans"])


def match_segments(kind, buckets: int, across_rows: bool, earlier: Callable) -> Callable:
    """Step 2 in the buckets: blobs of spans (rid, first window, number of windows) of windows that occur earlier.

    earlier(segments) gets the segments of some grams, in order, without copies, and returns (segment of each
    window, place in it, whether it occurs earlier) in order of segments and places.
    """

    def run(batches):
        parts, found, size = [], [], 0
        for n, spans, data in (r[1:] for r in _rows(batches, 4)):
            if spans:
                found.append(_unpack(data).reshape(3, n))
            else:
                parts.append(Segments.read(n, data))
        s = Segments.join(parts).in_order()
        del parts
        kept, gone = s.without_copies(across_rows)
        if gone.size:
            found.append(np.stack([s.rid[gone], s.start[gone], np.array([kind.windows(s.data[i]) for i in gone.tolist()], "i8")]))
        kept = kept[np.argsort(s.h[kept], kind="stable")]
        total = np.cumsum([kind.windows(s.data[i]) + kind.window - 1 for i in kept.tolist()])
        group = np.append(np.flatnonzero(np.diff(s.h[kept])) + 1, len(kept)) if len(kept) else np.empty(0, "i8")
        at = 0
        while at < len(kept):  # as many whole groups of a gram as fit, at least one
            limit = np.searchsorted(total, (total[at - 1] if at else 0) + kind.block, "right")
            fit = group[(group > at) & (group <= limit)]
            end = int(fit[-1] if fit.size else group[group > at][0])
            block = s.take(np.sort(kept[at:end]))
            seg, place, old = earlier(block)
            i = np.flatnonzero(old)
            if i.size:
                new = np.flatnonzero((np.diff(seg[i]) != 0) | (np.diff(place[i]) != 1)) + 1
                head = np.concatenate([[0], new])
                found.append(np.stack([block.rid[seg[i[head]]], block.start[seg[i[head]]] + place[i[head]], np.diff(np.append(head, len(i)))]))
                size += len(head)
            at = end
            if size >= FLUSH_GRAMS:
                yield _span_blobs(found, buckets)
                found, size = [], 0
        if found:
            yield _span_blobs(found, buckets)

    return run


def repeat_spans(rows: DataFrame, kind, across_rows: bool, earlier: Callable) -> DataFrame:
    """Columns copy and spans added to rows (_rid, _text, ...) with unique _rid.

    spans: array of (first, many), runs of windows that also start earlier, in order, or null. copy: the text is
    that of a row before, whose windows are all repeats; it has no spans.
    """
    n = partitions(rows.sparkSession)
    buckets = 4 * n
    # All three uses take the same columns of the same exchange, so that Spark runs it once.
    texts = rows.repartition(n, "_rid")
    rest = [c for c in rows.columns if c not in ("_rid", "_text")]
    firsts = rows.groupBy(F.sha2(F.coalesce(F.col("_text"), F.lit("")).cast("binary"), 256).alias("_sha")).agg(F.min("_rid").alias("_rid")).select("_rid").withColumn("_first", F.lit(True))
    heads = texts.join(firsts, "_rid").select("_rid", "_text", *rest)
    asked = heads.mapInArrow(tidy(send_grams(kind, buckets), MEMORY), GRAM_ROWS).repartition(n, "bucket")
    told = asked.mapInArrow(tidy(match_grams(across_rows), MEMORY), "_rid long, gram long, hot boolean")
    told = told.groupBy("_rid").agg(F.collect_set("gram").alias("_grams"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("_hot"))
    shown = texts.join(told, "_rid").select("_rid", "_text", "_grams", "_hot", *rest)
    sent = shown.mapInArrow(tidy(send_segments(kind, buckets, across_rows), MEMORY), SEGMENT_ROWS).repartition(n, "bucket")
    spans = sent.mapInArrow(tidy(match_segments(kind, buckets, across_rows, earlier), MEMORY), SPAN_ROWS).repartition(n, "bucket")
    spans = spans.mapInArrow(tidy(join_spans, MEMORY), SPANS)
    marked = texts.join(firsts, "_rid", "left").join(spans, "_rid", "left")
    return marked.select(*rows.columns, F.col("_first").isNull().alias("copy"), "spans")


def covered(n: int, spans: list[dict] | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of the symbols that the windows of the spans cover."""
    if not spans:
        return np.empty(0, "i8"), np.empty(0, "i8")
    a = np.array([s["first"] for s in spans], "i8")
    b = a + np.array([s["many"] for s in spans], "i8") + window - 1
    step = np.zeros(n + 1, "i8")
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    inside = np.concatenate([[False], np.cumsum(step[:n]) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]
