"""Packing of documents into sequences of a fixed number of tokens, by best fit and swap-based local search.

A piece's length is at most the capacity, so the corpus is described by one count for each length, whatever its
size. The plan is made on these counts: bins with the same lengths are one pattern with a number of copies. Best fit
decreasing makes the patterns; the search then takes underfull patterns in pairs and moves a document, exchanges one
for one, or two for one, whenever that raises the sum of squared fills, for as many copies at once as both have,
until no exchange helps; bins that are emptied this way are saved. Pieces are numbered within their length, and a
number tells a piece its sequence and offset.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, remembered, tidy

#: Token ids of a sequence, and the id after each document.
CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers.
CACHE = 400_000


#: A run of marks after a letter at the end of a word: it is a token run of its own.
_MARKS = re.compile(r"(?<=[a-zß-öø-ÿ])([^\s\w]+)(?=\s|$)")
#: Byte-level form of a byte: itself if printable, else the next free character from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: Normalizer and pre-tokenizer of which words can be encoded one by one (fixed values of the tokenizer's file).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Characters outside these ranges, of which white space, letter case or class may be another in Python than in the
#: tokenizer, send a text through the tokenizer whole: U+001C to U+001F, and scripts other than Latin, Greek, Cyrillic,
#: punctuation, Han, kana, Hangul and pictures.
_OTHER = re.compile("[^\x00-\x1b\x20-\u024f\u0370-\u0481\u2000-\u206f\u20a0-\u20bf\u2100-\u23ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fef\uac00-\ud7a3\U0001f300-\U0001f64f]")


class _WordIds(dict):
    """Ids of a word as bytes, found once. A word of letters, in lower case and composed, is one pre-token, which the
    model's merges take as it is; any other goes through the whole tokenizer."""

    def __init__(self, encoder):
        super().__init__()
        self.encode, self.merge = encoder.encode, encoder.model.tokenize
        spec = json.loads(encoder.to_str())
        self.by_word = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and not any(t["content"][:2] != "<|" or t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word == word.lower() and "ς" not in word:
            level = word if word.isascii() else word.encode().decode("latin-1").translate(_LEVEL)
            ids = [t.id for t in self.merge(level)]
        else:
            ids = self.encode(word, add_special_tokens=False).ids
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


def memory(tokenizer_file: str) -> str:
    """The name under which a worker remembers words' ids."""
    return f"ids {tokenizer_file}"


def tokenize(tokenizer_file: str):
    """A function from a text to its ids as little-endian bytes. Where the tokenizer drops white space, so that no token
    spans it, words are encoded once and remembered for as long as the worker lives; texts with characters that Python
    may see otherwise than the tokenizer, and all texts of other tokenizers, are encoded whole."""
    import public_tokenizers
    import tokenizers

    path = tokenizer_file if os.path.exists(tokenizer_file) else public_tokenizers.path(tokenizer_file)
    cache = remembered(memory(tokenizer_file), lambda: _WordIds(tokenizers.Tokenizer.from_file(path)))

    def run(text: str | None) -> bytes:
        text = text or ""
        if len(cache) > CACHE:
            cache.clear()
        if not cache.by_word or "<|" in text or _OTHER.search(text) or not unicodedata.is_normalized("NFC", text):
            ids = cache.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if "Σ" not in text:  # its lower case depends on its place
            text = _MARKS.sub(r" \1", text.lower())
        return b"".join([cache[w] for w in text.split()])

    return run


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_file: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = tokenize(tokenizer_file)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                keys, rows = [], []
                for i, text in enumerate(b.column(1).slice(at, 64).to_pylist(), at):
                    ids = np.frombuffer(encode(text) + struct.pack("<I", end), "<u4")
                    for k, begin in enumerate(range(0, len(ids), capacity)):
                        part = ids[begin : begin + capacity]
                        keys.append(i)
                        rows.append((k, begin, len(part), zlib.crc32(part.tobytes()), *[part.tolist()] * with_ids))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), *columns], names)

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, memory(tokenizer_file)), schema)


Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Patterns and their copies: the longest piece that is left, then always the longest that fits."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    out: dict[Pattern, int] = {}
    while sizes:
        room, bin_ = capacity, []
        at = len(sizes)
        while (at := bisect.bisect_right(sizes, room, 0, at)) > 0:
            n = sizes[at - 1]
            k = min(room // n, left[n])
            bin_.append((n, k))
            room -= n * k
            at -= 1
        copies = min(left[n] // k for n, k in bin_)
        out[tuple(bin_)] = out.get(tuple(bin_), 0) + copies
        for n, k in bin_:
            left[n] -= k * copies
            if not left[n]:
                sizes.remove(n)
    return out


def fill(p: Pattern) -> int:
    return sum(n * k for n, k in p)


def _changed(p: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    d = dict(p)
    for n in out:
        d[n] -= 1
    for n in into:
        d[n] = d.get(n, 0) + 1
    return tuple(sorted(((n, k) for n, k in d.items() if k), reverse=True))


def _choices(p: Pattern) -> list[tuple[int, tuple[int, ...]]]:
    """What can be taken from a bin: nothing, one or two of its pieces, by sum."""
    ones = [n for n, _ in p]
    twos = [(a, b) for i, a in enumerate(ones) for b in ones[i:] if a != b or dict(p)[a] > 1]
    return sorted([(0, ()), *((n, (n,)) for n in ones), *((a + b, (a, b)) for a, b in twos)])


def exchange(low: Pattern, high: Pattern, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The move, one-for-one or two-for-one exchange that adds most to the fuller bin, at most room."""
    best, found = 0, None
    back = _choices(high)
    sums = [s for s, _ in back]
    for total, give in _choices(low)[1:]:
        i = bisect.bisect_left(sums, max(0, total - room))
        while i < len(back) and sums[i] < total and total - sums[i] > best:
            if (len(give), len(back[i][1])) != (2, 2) and (len(give), len(back[i][1])) != (2, 0):
                best, found = total - sums[i], (give, back[i][1])
                break
            i += 1
        if best == room:
            break
    return found


class _Open:
    """What underfull patterns can take: a row for each choice that a pattern can give back, as arrays; rows are only
    added at the end. A give of `total` fits a row whose sum is less and whose sum and room are as much or more."""

    def __init__(self, capacity: int):
        self.capacity, self.rows = capacity, np.empty((5, 1 << 10), "i8")  # number, sum, pieces, sum and room, fill
        self.end, self.dead, self.patterns, self.number, self.seen = 0, 0, [], {}, {}

    def add(self, p: Pattern) -> None:
        back = _choices(p)
        while self.end + len(back) > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)], axis=1)
        full = fill(p)
        for i, (total, taken) in enumerate(back, self.end):
            self.rows[:, i] = len(self.patterns), total, len(taken), total + self.capacity - full, full
        self.number[p], self.seen[p] = len(self.patterns), 0
        self.patterns.append(p)
        self.end += len(back)

    def drop(self, p: Pattern) -> None:
        self.rows[3, : self.end][self.rows[0, : self.end] == self.number.pop(p)] = -1  # nothing fits
        del self.seen[p]
        self.dead += 1

    def compact(self) -> None:
        """Puts away the rows of patterns that are gone, where they are most."""
        if self.dead < 64 + len(self.number):
            return
        alive = self.rows[3, : self.end] >= 0
        before = np.concatenate([[0], np.cumsum(alive)]).tolist()
        self.seen = {p: before[n] for p, n in self.seen.items()}
        self.end, self.dead = before[-1], 0
        self.rows[:, : self.end] = self.rows[:, : len(alive)][:, alive]

    def partner(self, low: Pattern, alone: bool) -> Pattern | None:
        """A pattern as full or fuller that an exchange with low leaves least room in, of the rows not seen; none: all
        rows are seen by low. alone: there is one copy of low."""
        number, sums, pieces, most, full = self.rows[:, self.seen[low] : self.end]
        at = np.flatnonzero((full >= fill(low)) & (most > 0) & ((number != self.number[low]) | (not alone)))
        number, sums, pieces, most = number[at], sums[at], pieces[at], most[at]
        best, found = self.capacity, None
        for total, count in sorted({(total, len(give)) for total, give in _choices(low)[1:]}, reverse=True):
            fit = (sums < total) & (most >= total)
            if count == 2:
                fit &= pieces == 1
            i = np.flatnonzero(fit)
            if i.size and (least := int((left := most[i] - total).min())) < best:
                best, found = least, self.patterns[number[i[left.argmin()]]]
                if not best:
                    break
        if found is None:
            self.seen[low] = self.end
        return found


def local_search(bins: dict[Pattern, int], capacity: int) -> dict[Pattern, int]:
    """Fewer or as many bins with the same pieces: exchanges that raise the sum of squared fills, until none does or
    there are no more bins than the pieces' sum needs."""
    bins = dict(bins)
    least = -(-sum(fill(p) * c for p, c in bins.items()) // capacity)
    many, open_ = sum(bins.values()), _Open(capacity)
    heap = sorted((fill(p), p) for p in bins if fill(p) < capacity)
    for _, p in heap:
        open_.add(p)

    def put(p: Pattern, copies: int) -> None:
        before = bins.get(p, 0)
        bins[p] = before + copies
        if not bins[p]:
            del bins[p]
        if fill(p) == capacity:
            return
        if before and (not bins.get(p) or before == 1 < bins[p]):  # a second copy is a new partner of the first
            open_.drop(p)
        if p in bins and p not in open_.number:
            open_.add(p)
            heapq.heappush(heap, (fill(p), p))

    while many > least:
        if not heap:  # patterns that came since may be partners of those that found none
            heap = sorted((fill(p), p) for p, seen in open_.seen.items() if seen < open_.end)
            if not heap:
                break
        low = heapq.heappop(heap)[1]
        while low in open_.number and many > least and (high := open_.partner(low, bins[low] < 2)):
            give, back = exchange(low, high, capacity - fill(high))
            copies = bins[low] // 2 if low == high else min(bins[low], bins[high])
            for p, out, into in ((low, give, back), (high, back, give)):
                new = _changed(p, out, into)
                put(p, -copies)
                if new:
                    put(new, copies)
                else:
                    many -= copies
        open_.compact()
    return bins


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    return local_search(best_fit(counts, capacity), capacity)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): each document's ids and then `end`, cut into
    pieces of the capacity, and each piece's place in a sequence without gaps.

    tokenizer_file: a file of any tokenizer, or a name known to public_tokenizers. Null and empty texts are the id `end` alone; null
    ids and repeated rows are documents like others; documents of any length are cut, none is dropped. An empty
    table gives an empty result; other columns are left out.
    """
    rows = checkpointed(pieces(df, id_col, text_col, tokenizer_file, capacity, end, with_ids))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    bins = sorted(plan(counts, capacity).items(), reverse=True)

    # For each length: from which number on its pieces go to which pattern.
    ranges: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    used, sequence = dict.fromkeys(counts, 0), 0
    for pattern, copies in bins:
        offset = 0
        for n, k in pattern:
            ranges[n].append((used[n], sequence, k, offset))
            used[n] += k * copies
            offset += n * k
        sequence += copies
    table = {n: np.array(r, "i8").T for n, r in ranges.items()}

    salts = partitions(df.sparkSession)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "salt").count()
    sums = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1).join(sums, ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("base")).drop("salt", "base")

    def place(batches):
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence_id, offset = np.empty(len(length), "i8"), np.empty(len(length), "i8")
            for n in np.unique(length).tolist():
                rows_ = np.flatnonzero(length == n)
                first, base, times, at = table[n]
                i = np.searchsorted(first, number[rows_], "right") - 1
                inner = number[rows_] - first[i]
                sequence_id[rows_] = base[i] + inner // times[i]
                offset[rows_] = at[i] + inner % times[i] * n
            keep = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence_id), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return numbered.select(*names, F.col("number").cast("long").alias("number")).mapInArrow(tidy(place, memory(tokenizer_file)), schema).withColumnRenamed("id", id_col)


def op2_packing(spark, sf_dir):
    from .common import documents

    return pack_documents(documents(spark, sf_dir))
