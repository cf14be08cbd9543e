"""Substring dedup by fixed-block anchors.

Texts are cut into non-overlapping reference blocks of 7 words at multiples of 7, which are an index by hash, with the
rows they are of. Any window of 13 words contains exactly one whole block wherever it lies, so a window that occurs
elsewhere is found when every rolling 7-word window of a text probes the index (step 1 in repeats.py). Hits are
extended by the words around them, as far as both texts agree; the windows of 13 words within the extension are the
repeats, and runs of them the maximal exact repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, with_row_ids
from .repeats import Segments, Words, covered, repeat_spans

#: Words of a block: the most for which each window of 13 words holds a whole one.
BLOCK_WORDS = Words.gram


def _ranks(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """A number for each place that is the same where both a[i] and b[i + gap] are; exact, no hash."""
    n = min(len(a), len(b) - gap)
    if n <= 0:
        return np.empty(0, "i8")
    return np.unique(a[:n] * (int(b.max()) + 1) + b[gap : gap + n], return_inverse=True)[1]


def hits(gram: np.ndarray, row: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Whether each gram equals a reference gram of another row."""
    low, high = np.full(int(gram.max()) + 1, np.iinfo("i8").max), np.full(int(gram.max()) + 1, np.iinfo("i8").min)
    np.minimum.at(low, gram[reference], row[reference])
    np.maximum.at(high, gram[reference], row[reference])
    return (low[gram] < row) | (high[gram] > row)


def earlier_windows(block: Segments, window: int = Words.window):
    """Whether each window of the block's segments has an equal one in a segment of an earlier row."""
    split = [d.split(b" ") for d in block.data]
    size = np.array([len(w) for w in split], "i8")
    ids: dict[bytes, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for ws in split for w in ws], "i8")
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - (np.cumsum(size) - size)[owner]
    at = np.flatnonzero(size[owner] - place >= window)
    if not at.size:
        return owner[at], place[at], np.zeros(0, bool)
    pair = _ranks(word, word, 1)
    four = _ranks(pair, pair, 2)
    seven = _ranks(four, four, 3)  # four words and four from the third on
    # Reference blocks with their rows, and the places whose rolling window hits one of another row.
    fixed = (block.start[owner[: len(seven)]] + place[: len(seven)]) % BLOCK_WORDS == 0
    inside = size[owner[: len(seven)]] - place[: len(seven)] >= BLOCK_WORDS
    rows = block.rid[owner[: len(seven)]]
    hit = np.concatenate([[0], np.cumsum(hits(seven, rows, fixed & inside))])
    probed = hit[at + window - BLOCK_WORDS + 1] > hit[at]
    # Extension of a hit to the whole window: its first and last seven words tell all 13.
    tried = at[probed]
    whole = np.unique(seven[tried] * (int(seven.max()) + 1) + seven[tried + window - BLOCK_WORDS], return_inverse=True)[1]
    least = np.full(int(whole.max()) + 1 if whole.size else 0, np.iinfo("i8").max)
    rid = block.rid[owner[tried]]
    np.minimum.at(least, whole, rid)
    old = np.zeros(len(at), bool)
    old[probed] = rid > least[whole]
    return owner[at], place[at], old


def dedup_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every row: words covered by a window of 13 words whose sequence also
    starts in a row with a smaller id are removed.

    spans: the removed runs as array of (begin, end) word numbers; kept: the other words with a space between.
    Windows are judged on the input; repeats within a row stay. Null texts have no words; texts under 13 words stay.
    Rows go by (id, nulls last, then text): of repeated rows the first stays, equal ids count as different rows. An
    empty table gives an empty result; other columns are left out.
    """
    rows, _ = with_row_ids(df, id_col, text_col)
    marked = repeat_spans(rows, Words(), True, earlier_windows)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, kept string"

    def run(batches):
        for b in batches:
            out = []
            for text, copy, spans in zip(b.column("_text").to_pylist(), b.column("copy").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if copy and n >= Words.window:
                    begin, end = np.array([0]), np.array([n])
                else:
                    begin, end = covered(n, spans, Words.window)
                kept = [w for a, z in zip([0, *end.tolist()], [*begin.tolist(), n], strict=True) for w in words[a:z]]
                out.append((n, n - len(kept), [{"begin": a, "end": z} for a, z in zip(begin.tolist(), end.tolist(), strict=True)], b" ".join(kept).decode()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[pa.array(c, t) for c, t in zip(columns, target.types[1:], strict=True)]], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return marked.select("_id", "_text", "copy", "spans").mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def op8_substrings(spark, sf_dir):
    from .common import documents

    out = dedup_words(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: {'i': i, 'm': md5(array_to_string(ws[i:i + 12], ' '))})) AS g FROM w),
f AS (SELECT doc_id, g.i AS i, min(doc_id) OVER (PARTITION BY g.m) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS j FROM f WHERE first < doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM a ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
