"""Catalyst's parse trees as small Python nodes. The parser is reached through a private interface, only here."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Node:
    kind: str
    fields: dict
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def exprs(self, name: str) -> list[Node]:
        """Expressions in a field: one, or a list of them."""
        return _expressions(self.fields.get(name))

    @property
    def names(self) -> list[str]:
        return [x.strip() for x in str(self.fields.get("nameParts", self.fields.get("multipartIdentifier", "[]"))).strip("[]").split(",")]


def _tree(flat: list[dict]) -> Node:
    it = iter(flat)

    def build() -> Node:
        d = next(it)
        n = Node(d["class"].rpartition(".")[2], {k: v for k, v in d.items() if k not in ("class", "num-children")})
        n.children = [build() for _ in range(d["num-children"])]
        return n

    return build()


def _expressions(value) -> list[Node]:
    if not isinstance(value, list) or not value:
        return []
    if isinstance(value[0], dict) and "class" in value[0]:
        return [_tree(value)]
    return [e for v in value for e in _expressions(v)]


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def parse_plan(spark: SparkSession, sql: str) -> Node:
    return _tree(json.loads(_parser(spark).parsePlan(sql).toJSON()))


def parse_expression(spark: SparkSession, text: str) -> Node:
    return _tree(json.loads(_parser(spark).parseExpression(text).toJSON()))


def flatten(n: Node, kind: str) -> list[Node]:
    """Operands of nested And or Or."""
    return [x for c in n.children for x in flatten(c, kind)] if n.kind == kind else [n]


def is_literal(n: Node) -> bool:
    return n.kind == "Literal" or n.kind == "UnaryMinus" and n.children[0].kind == "Literal"


def literal(n: Node) -> str:
    return "-" + literal(n.children[0]) if n.kind == "UnaryMinus" else str(n.fields["value"])


#: Comparison of a node's kind, and what it is with sides exchanged or denied (fixed values).
COMPARE = {"EqualTo": "=", "GreaterThanOrEqual": ">=", "LessThanOrEqual": "<=", "GreaterThan": ">", "LessThan": "<"}
FLIP = {"=": "=", "!=": "!=", ">=": "<=", "<=": ">=", ">": "<", "<": ">"}
DENY = {"=": "!=", "!=": "=", ">=": "<", "<": ">=", "<=": ">", ">": "<=", "IS_NULL": "NOT_NULL", "NOT_NULL": "IS_NULL"}


def comparison(n: Node) -> tuple[Node, str, str] | None:
    """(column, op, value) of a comparison of a column with a literal, or a null test; else None."""
    if n.kind in ("IsNull", "IsNotNull") and n.children[0].kind == "UnresolvedAttribute":
        return n.children[0], "IS_NULL" if n.kind == "IsNull" else "NOT_NULL", "IS_NULL"
    if n.kind == "Not" and (c := comparison(n.children[0])):
        return c[0], DENY[c[1]], c[2]
    if n.kind in COMPARE:
        a, b = n.children
        if a.kind == "UnresolvedAttribute" and is_literal(b):
            return a, COMPARE[n.kind], literal(b)
        if b.kind == "UnresolvedAttribute" and is_literal(a):
            return b, FLIP[COMPARE[n.kind]], literal(a)
    return None


def atoms(n: Node) -> list[tuple[Node, str, list[str]]] | None:
    """Conjunction as (column, op, values); None if any part is something else."""
    out = []
    for part in flatten(n, "And"):
        if part.kind == "UnresolvedFunction" and part.names[-1].lower() == "between" and part.children[0].kind == "UnresolvedAttribute" and all(map(is_literal, part.children[1:])):
            out += [(part.children[0], ">=", [literal(part.children[1])]), (part.children[0], "<=", [literal(part.children[2])])]
        elif part.kind == "In" and part.children[0].kind == "UnresolvedAttribute" and all(map(is_literal, part.children[1:])):
            out.append((part.children[0], "IN", [literal(x) for x in part.children[1:]]))
        elif c := comparison(part):
            out.append((c[0], c[1], [c[2]]))
        else:
            return None
    return out
