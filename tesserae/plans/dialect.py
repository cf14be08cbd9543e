"""Rewrites analytical SQL that Spark's parser refuses: QUALIFY, trailing commas, date_diff with a quoted unit,
COUNT(DISTINCT ...) OVER (...). Text between quotes and comments is left alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?|\s+|.""", re.S)
#: Words that end a query block at its own depth.
_ENDS = {"ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", ";"}


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _word(t: str) -> str:
    return t.upper()


def _next(ts: list[str], i: int) -> int:
    while i < len(ts) and ts[i].isspace():
        i += 1
    return i


def _close(ts: list[str], i: int) -> int:
    """Place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j] == "(") - (ts[j] == ")")
        if depth == 0:
            return j
    raise ValueError("unbalanced brackets")


def drop_trailing_commas(ts: list[str]) -> list[str]:
    out = []
    for i, t in enumerate(ts):
        j = _next(ts, i + 1)
        if t == "," and (j == len(ts) or _word(ts[j]) == "FROM" or ts[j] == ")"):
            continue
        out.append(t)
    return out


def rewrite_calls(ts: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(ts):
        j = _next(ts, i + 1)
        if _word(ts[i]) in ("DATE_DIFF", "DATEDIFF") and j < len(ts) and ts[j] == "(" and ts[_next(ts, j + 1)].startswith("'"):
            end = _close(ts, j)
            args = split_commas(ts[j + 1 : end])
            unit = "".join(args[0]).strip().strip("'").lower()
            if unit != "day":
                raise ValueError(f"date_diff by {unit} is not supported")
            a, b = ("".join(rewrite_calls(x)).strip() for x in args[1:])
            out.append(f"CAST(date_diff(CAST({b} AS DATE), CAST({a} AS DATE)) AS BIGINT)")  # midnights between
            i = end + 1
            continue
        if _word(ts[i]) == "COUNT" and j < len(ts) and ts[j] == "(" and _word(ts[_next(ts, j + 1)]) == "DISTINCT":
            end = _close(ts, j)
            k = _next(ts, end + 1)
            if k < len(ts) and _word(ts[k]) == "OVER":
                inner = "".join(ts[_next(ts, j + 1) + 1 : end]).strip()
                w = _next(ts, k + 1)
                stop = _close(ts, w) if ts[w] == "(" else w
                out.append(f"CAST(size(collect_set({inner}) OVER {''.join(ts[w : stop + 1])}) AS BIGINT)")
                i = stop + 1
                continue
        out.append(ts[i])
        i += 1
    return out


def split_commas(ts: list[str]) -> list[list[str]]:
    parts, depth = [[]], 0
    for t in ts:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def rewrite_qualify(ts: list[str]) -> list[str]:
    """Each block SELECT list FROM ... QUALIFY condition becomes a filter on a subquery. A condition that has window
    functions itself is computed beside the list; one on aliases of the list is used as it is."""
    while True:
        at = next((i for i, t in enumerate(ts) if _word(t) == "QUALIFY"), None)
        if at is None:
            return ts
        depth, start = 0, at
        while not (depth == 0 and _word(ts[start]) == "SELECT"):
            start -= 1
            depth += (ts[start] == ")") - (ts[start] == "(")
        depth, end = 0, at + 1
        while end < len(ts) and not (depth == 0 and (ts[end] == ")" or _word(ts[end]) in _ENDS)):
            depth += (ts[end] == "(") - (ts[end] == ")")
            end += 1
        condition = "".join(ts[at + 1 : end]).strip()
        depth, source = 0, start + 1
        while not (depth == 0 and _word(ts[source]) == "FROM"):
            depth += (ts[source] == "(") - (ts[source] == ")")
            source += 1
        list_, rest = "".join(ts[start + 1 : source]).strip(), "".join(ts[source:at]).strip()
        if any(_word(t) == "OVER" for t in ts[at:end]):
            block = f"SELECT * EXCEPT (_qualify) FROM (SELECT {list_}, ({condition}) AS _qualify {rest}) WHERE _qualify"
        else:
            block = f"SELECT * FROM (SELECT {list_} {rest}) WHERE {condition}"
        ts = tokens("".join(ts[:start]) + block + " " + "".join(ts[end:]))


def to_spark(sql: str) -> str:
    ts = drop_trailing_commas(tokens(sql))
    return "".join(rewrite_qualify(rewrite_calls(ts))).strip().rstrip(";").strip()


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of a query in the wider dialect; tables are registered as temporary views first."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return replaced(spark.sql(to_spark(sql)))


def replaced(df: DataFrame) -> DataFrame:
    """A result with each name once: SELECT *, expr AS name puts the expression in the place of the column it names."""
    last = {c: i for i, c in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"c{last[c]}"].alias(c) for c in dict.fromkeys(df.columns)])
