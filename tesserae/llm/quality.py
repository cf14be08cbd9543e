"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text: its words, pairs of neighbouring words, and runs of one to three word shapes (letter case,
punctuation around the letters, length, whether the word repeats the one before), each hashed into a fixed number
of slots. A feature's value is its share of its kind's n-grams, so a score is a sum of means of weights.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remembered, sampled, tidy

#: log2 of the number of slots.
BITS = 18
#: The classifier is fitted on at most about so many labelled rows, chosen by hash of the id.
MAX_ROWS = 4000
#: Words whose hash a worker remembers, and under which name.
CACHE, MEMORY = 250_000, "quality"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_MARKS = re.compile(r"\w+")


def _shape(word: bytes) -> bytes:
    """Letter case, marks and length of a word: "T" and "l" for title and lower case, "U" for capitals, "n" for no
    letters, "d" where there are digits; runs of word characters as one underscore between the marks."""
    size = b"%d" % (min(len(word), 20) // 5)
    if word.isalpha():  # ASCII letters alone
        return (b"l_" if word.islower() else b"U_" if len(word) > 1 and word.isupper() else b"T_" if word[:1].isupper() else b"l_") + size
    w = word.decode(errors="replace")
    case = "U" if len(w) > 1 and w.isupper() else "l" if w.islower() else "T" if w.lower() != w and w.lstrip("_")[:1].isupper() else "l" if w.lower() != w.upper() else "n"
    digits = "d" if any(map(str.isdigit, w)) else ""
    return f"{case}{digits}{_MARKS.sub('_', w)[:6]}".encode() + size


class _Places(dict):
    """Numbers of words in order of appearance, and by number the hashes of word and shape."""

    def __init__(self):
        super().__init__()
        self.words, self.shapes, self.known = np.empty(1 << 16, "u8"), np.empty(1 << 16, "u8"), {}

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i == len(self.words):
            self.words, self.shapes = (np.concatenate([a, np.empty_like(a)]) for a in (self.words, self.shapes))
        shape = _shape(word)
        if shape not in self.known:
            self.known[shape] = xxhash.xxh64_intdigest(shape, seed=1)
        self.words[i], self.shapes[i] = xxhash.xxh64_intdigest(word, seed=0), self.known[shape]
        return i


class Featurizer:
    """Slots of a text's features by kind; remembers words."""

    def __init__(self, bits: int = BITS):
        self.shift, self.places = np.uint64(64 - bits), _Places()

    def kinds(self, text: str | None) -> list[np.ndarray]:
        words = (text or "").encode().split()
        if not words:
            return []
        if len(self.places) > CACHE:
            self.places = _Places()
        places = self.places
        at = np.fromiter([places[w] for w in words], "i8", len(words))
        h, s = places.words[at], places.shapes[at]
        s[1:] ^= np.where(at[1:] == at[:-1], _M2, np.uint64(0))
        out = [h * _M1, (h[:-1] * _M2 + h[1:]) * _M1, s * _M1 + np.uint64(1), (s[:-1] * _M2 + s[1:]) * _M1, ((s[:-2] * _M2 + s[1:-1]) * _M2 + s[2:]) * _M1]
        return [(k ^ (k >> np.uint64(29))) * _M1 >> self.shift for k in out if k.size]


def sparse(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text's feature vector."""
    if not kinds:
        return np.empty(0, "u4"), np.empty(0, "f4")
    slots, place = np.unique(np.concatenate(kinds), return_inverse=True)
    shares = np.concatenate([np.full(k.size, 1 / k.size) for k in kinds])
    return slots.astype("u4"), np.bincount(place, shares).astype("f4")


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias; rows are (slots, values, label) and are visited in the order given.

    The bias is the log-odds of the labels, so a text of which nothing is known scores their mean; the weights
    learn what the features add. No rows: all 0.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    good = sum(y for *_, y in rows)
    bias = float(np.log((good + 0.5) / (len(rows) - good + 0.5)))
    for _ in range(epochs):
        for slots, x, y in rows:
            i = slots.astype("i8")
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(1 << bits)).astype("f4"), bias


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows that aren't held out, at most about max_rows of them by hash of the id.

    The sampled labels, not the texts, are sent to the documents; what comes back is sparse vectors. Null labels
    and labels of unknown ids teach nothing; an id with both labels counts as its least one; with no labels every
    text scores one half.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    total = known.count()
    if total > max_rows:
        known = known.filter(sampled(F.col("_id"), max_rows / total))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")

    def features(batches):
        f = remembered(MEMORY, Featurizer)
        for b in batches:
            vectors = [sparse(f.kinds(t)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("_y"), pa.array([s.tobytes() for s, _ in vectors], pa.binary()), pa.array([v.tobytes() for _, v in vectors], pa.binary())], ["id", "y", "slots", "vals"])

    got = rows.select("_id", "_y", "_text").mapInArrow(tidy(features, MEMORY), "id string, y int, slots binary, vals binary").toArrow()
    got = got.take(pa.compute.sort_indices(pa.array([xxhash.xxh64_intdigest(i) for i in got.column("id").to_pylist()], pa.uint64()))).to_pydict()
    return fit_ftrl([(np.frombuffer(s, "u4"), np.frombuffer(v, "f4"), y) for s, v, y in zip(got["slots"], got["vals"], got["y"], strict=True)])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; the text alone decides. Null and empty texts score the bias alone."""
    weights, bias = model

    def run(batches):
        f = remembered(MEMORY, Featurizer)
        for b in batches:
            dots = [sum(float(weights[k].mean(dtype="f8")) for k in f.kinds(t)) + bias for t in b.column(1).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(dots, "f8"), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, MEMORY), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores the threshold or more, with all their columns."""
    names = docs.columns

    def run(batches):
        f = remembered(MEMORY, Featurizer)
        for b in batches:
            keep = []
            for t in b.column(names.index(text_col)).to_pylist():
                dot = sum(float(model[0][k].mean(dtype="f8")) for k in f.kinds(t)) + model[1]
                keep.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))) >= threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run, MEMORY), docs.schema)


def op5_quality(spark, sf_dir):
    from .common import documents

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
