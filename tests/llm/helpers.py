"""A small corpus with the awkward cases, and what the tests share."""

from __future__ import annotations

import random

#: Extra columns whose names the operators use inside.
CLASHES = ("id", "size", "fp", "node", "spans", "kept", "score", "length", "number", "salt", "whole", "threshold", "component", "copy", "media", "label", "_rid", "_id", "_text", "_carry", "_row", "_null_text", "_size", "_h", "_skey", "_n", "_copy", "_plan", "_place", "row")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = prose(40), prose(14)
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 10
        t = prose(rng.randint(1, 160))
        if kind == 1 and texts[i - 1]:
            t = texts[i - 1]
        elif kind == 2:
            t = prose(20) + " " + passage + "\n" + prose(9)
        elif kind == 3 and texts[i - 3]:
            w = texts[i - 3].split()
            w[len(w) // 2] = "changed"
            t = "  ".join(w)
        elif kind == 4:
            t = "\n".join([line] * 3) + "\t" + prose(5)
        elif kind == 5:
            t = "na " * rng.randint(1, 90)
        texts.append(t)
    texts[7], texts[8], texts[9], texts[17], texts[18] = None, "", " \n\t ", "é", "Ω≈ç√ \U0001f600 " * 30
    texts[27] = prose(9000) + " " + passage  # very long beside the others
    texts[28], texts[29] = None, ""
    sources = ["a", "b", None, "Z", "é", "a", "a"]
    return [(i * 3, t, None if i % 13 == 0 else "en", sources[i % 7], None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema).repartition(3)


def odd_ids(rows):
    """Null ids, ids that occur twice with other texts, and a repeated row."""
    out = [list(r) for r in rows]
    out[4][0] = out[5][0] = None
    out[10][0] = out[11][0] = out[12][0]
    out[20] = list(out[21])
    return [tuple(r) for r in out]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
