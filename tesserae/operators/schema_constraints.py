"""Constraints that a schema declares: dependencies of keys and references, implications of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.trees import DENY, Node, atoms, comparison, flatten, parse_expression
from tesserae.sources.catalog import Catalog

FD_SCHEMA = "lhs array<string>, rhs string, source string, kind string, approx_error double"
ATOM_SCHEMA = "source string, cid int, group_id int, lhs string, op string, value string, rhs string, domain_op string, domain_value array<string>"


def schema_fds(catalog: Catalog) -> list[tuple]:
    """(lhs, rhs, source, kind, error) of primary keys, unique keys without nulls, and references to primary keys."""
    out = []
    for t in catalog.values():
        keys = [("pk", t.primary_key)] if t.primary_key else []
        keys += [("unique" if set(u) <= t.not_null else "unique_nullable", u) for u in t.unique if set(u) != set(t.primary_key)]
        for kind, key in keys:
            out += [(tuple(sorted(key)), c, "schema", kind, 0.0) for c in t.columns if c not in key]
        for f in t.foreign_keys:
            parent = catalog.get(f.parent.lower())
            if parent and set(f.parent_columns) == set(parent.primary_key):
                out += [(tuple(sorted(f.columns)), c, "schema", "fk", 0.0) for c in parent.columns if c not in parent.primary_key]
    return sorted(set(out))


def schema_fd_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(list(a), *r) for a, *r in schema_fds(catalog)], FD_SCHEMA)


def implication(check: Node) -> list[tuple[list[tuple], list[tuple]]]:
    """(guard, body) pairs of `guard denied OR body`, guard and body as atoms; nothing if the check has another form."""
    sides = flatten(check, "Or")
    if len(sides) != 2:
        return []
    for first, body in (sides, sides[::-1]):
        found = atoms(body)
        if found is None or any(op == "NOT_NULL" for _, op, _ in found):
            continue
        if c := comparison(first):
            return [([(c[0], DENY[c[1]], [c[2]])], found)]
        parts = [comparison(p) for p in flatten(first, "And")]
        if all(p and p[1] == "NOT_NULL" for p in parts):  # each missing column alone implies the body
            return [([(p[0], "IS_NULL", ["IS_NULL"])], found) for p in parts]
    return []


def check_atoms(spark: SparkSession, catalog: Catalog) -> tuple[list[tuple], list[str]]:
    """Atom rows of all checks, and the checks of which nothing could be made. Every check has its number."""
    rows, left, cid = [], [], 0
    for t in catalog.values():
        for text in t.checks:
            cid += 1
            pairs = implication(parse_expression(spark, text))
            if not pairs:
                left.append(text)
            for [(col, op, value)], body in pairs:
                rows += [("schema", cid, 0, col.names[-1], op, value[0], c.names[-1], o, v) for c, o, v in body]
    return rows, left


def check_atom_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame(check_atoms(spark, catalog)[0], ATOM_SCHEMA)
