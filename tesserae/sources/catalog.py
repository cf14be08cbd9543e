"""Declared structure of tables: columns, keys, references and checks. Parquet doesn't enforce any of it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass
class Table:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    not_null: set[str] = field(default_factory=set)


class Catalog(dict[str, Table]):
    """Tables by lower-case name."""

    def __init__(self, tables=()):
        super().__init__((t.name.lower(), t) for t in tables)

    def keys_of(self, table: str) -> tuple[str, ...]:
        t = self.get(table.lower())
        return t.primary_key if t else ()


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip().strip('"`') for x in text.split(",") if x.strip())


def _parts(body: str) -> list[str]:
    out, depth, quote = [""], 0, ""
    for ch in body:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and depth == 0 and not quote:
            out.append("")
        else:
            out[-1] += ch
    return [p.strip() for p in out if p.strip()]


def _bracketed(text: str, at: int) -> tuple[str, int]:
    depth, quote = 0, ""
    for i in range(at, len(text)):
        if quote:
            quote = "" if text[i] == quote else quote
        elif text[i] in "'\"":
            quote = text[i]
        else:
            depth += (text[i] == "(") - (text[i] == ")")
            if depth == 0:
                return text[at + 1 : i], i + 1
    raise ValueError("unbalanced brackets")


def from_ddl(sql: str) -> Catalog:
    """Catalog of the CREATE TABLE statements in a script."""
    tables = []
    for m in re.finditer(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`]?(\w+)[\"`]?\s*\(", sql, re.I):
        body, _ = _bracketed(sql, m.end() - 1)
        columns, t = [], Table(m[1], ())
        for part in _parts(re.sub(r"--[^\n]*", "", body)):
            part = re.sub(r"^CONSTRAINT\s+\S+\s+", "", part, flags=re.I)
            head = part.upper()
            at = part.find("(")
            if head.startswith("PRIMARY KEY"):
                t.primary_key = _names(_bracketed(part, at)[0])
            elif head.startswith("UNIQUE"):
                t.unique.append(_names(_bracketed(part, at)[0]))
            elif head.startswith("CHECK"):
                t.checks.append(_bracketed(part, at)[0])
            elif head.startswith("FOREIGN KEY"):
                own, end = _bracketed(part, at)
                ref = re.search(r"REFERENCES\s+[\"`]?(\w+)[\"`]?\s*(\(([^)]*)\))?", part[end:], re.I)
                t.foreign_keys.append(ForeignKey(_names(own), ref[1], _names(ref[3] or "")))
            else:
                name = part.split()[0].strip('"`')
                columns.append(name)
                if re.search(r"\bPRIMARY\s+KEY\b", part, re.I):
                    t.primary_key = (name,)
                if re.search(r"\bUNIQUE\b", part, re.I):
                    t.unique.append((name,))
                if re.search(r"\bNOT\s+NULL\b|\bPRIMARY\s+KEY\b", part, re.I):
                    t.not_null.add(name)
                if c := re.search(r"\bCHECK\s*\(", part, re.I):
                    t.checks.append(_bracketed(part, c.end() - 1)[0])
                if r := re.search(r"\bREFERENCES\s+[\"`]?(\w+)[\"`]?\s*(\(([^)]*)\))?", part, re.I):
                    t.foreign_keys.append(ForeignKey((name,), r[1], _names(r[3] or "")))
        t.columns = tuple(columns)
        t.not_null |= set(t.primary_key)
        tables.append(t)
    cat = Catalog(tables)
    for t in tables:  # a reference without columns means the parent's key
        t.foreign_keys = [ForeignKey(f.columns, f.parent, f.parent_columns or cat.keys_of(f.parent)) for f in t.foreign_keys]
    return cat


def normalize_ddl(sql: str) -> str:
    """A CREATE TABLE of another system in plain form: no backquotes, engine options, indexes, lengths of whole
    numbers, UNSIGNED, AUTO_INCREMENT, character sets; enumerations are texts."""
    s = sql.replace("`", '"')
    s = re.sub(r"\)\s*(ENGINE|AUTO_INCREMENT|DEFAULT\s+CHARSET|CHARSET|COLLATE|COMMENT)\b[^;]*", ")", s, flags=re.I)
    s = re.sub(r"\b(tiny|small|medium|big)?int\s*\(\s*\d+\s*\)", lambda m: f"{m[1] or ''}int", s, flags=re.I)
    s = re.sub(r"\bmediumint\b", "int", s, flags=re.I)
    s = re.sub(r"\benum\s*\([^)]*\)|\b(long|medium|tiny)?text\b", "VARCHAR", s, flags=re.I)
    s = re.sub(r"\bdatetime\b", "TIMESTAMP", s, flags=re.I)
    s = re.sub(r"\b(unsigned|zerofill|auto_increment)\b|\bcharacter\s+set\s+\w+|\bcollate\s+\w+|\bcomment\s+'[^']*'", "", s, flags=re.I)
    s = re.sub(r",\s*(?:UNIQUE\s+)?KEY\s+\"?\w+\"?\s*\([^)]*\)", "", s, flags=re.I)
    return re.sub(r"[ \t]+", " ", s)


#: Keys and references of the driver's tables; lineitem has none, (l_orderkey, l_linenumber) repeats.
DRIVER = Catalog([
    Table("region", ("r_regionkey", "r_name"), ("r_regionkey",)),
    Table("nation", ("n_nationkey", "n_name", "n_regionkey"), ("n_nationkey",), foreign_keys=[ForeignKey(("n_regionkey",), "region", ("r_regionkey",))]),
    Table("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), ("c_custkey",), unique=[("c_name",)], foreign_keys=[ForeignKey(("c_nationkey",), "nation", ("n_nationkey",))]),
    Table("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ("s_suppkey",), foreign_keys=[ForeignKey(("s_nationkey",), "nation", ("n_nationkey",))]),
    Table("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), ("p_partkey",)),
    Table("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), ("o_orderkey",), foreign_keys=[ForeignKey(("o_custkey",), "customer", ("c_custkey",))],
          checks=["o_orderstatus <> 'F' OR o_totalprice >= 1000", "o_totalprice >= 100000 OR o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "o_orderstatus <> 'P' OR (o_totalprice BETWEEN 5000 AND 200000)"]),
])
