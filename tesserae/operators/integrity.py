"""Checking of rows against constraints, and their repair. All of it is column expressions: no row leaves the JVM."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import seeded


@dataclass
class Rule:
    """guard => one of the groups, each a conjunction of (column, op, values)."""

    key: tuple[str, int]
    guard: tuple[str, str, str]
    groups: dict[int, list[tuple[str, str, list[str]]]] = field(default_factory=lambda: defaultdict(list))


def load_rules(rows) -> list[Rule]:
    """Rules from atom rows (source, cid, group_id, lhs, op, value, rhs, domain_op, domain_value)."""
    rules: dict[tuple, Rule] = {}
    for source, cid, gid, lhs, op, value, rhs, dop, dvalue in rows:
        rule = rules.setdefault((source, cid, lhs, op, value), Rule((source, cid), (lhs, op, value)))
        rule.groups[gid].append((rhs, dop, list(dvalue)))
    return list(rules.values())


def _value(df: DataFrame, column: str, text: str) -> Column:
    return F.lit(text).cast(df.schema[column].dataType)


def test(df: DataFrame, column: str, op: str, values: list[str]) -> Column:
    """Whether an atom holds; unknown counts as no."""
    c = F.col(column)
    if op == "IS_NULL" or op == "=" and values[0].upper() in ("IS_NULL", "NULL", "NAN", ""):
        return c.isNull()
    if op == "NOT_NULL":
        return c.isNotNull()
    v = [_value(df, column, x) for x in values]
    found = c.isin(*v) if op == "IN" else {"=": c == v[0], "!=": c != v[0], "<": c < v[0], "<=": c <= v[0], ">": c > v[0], ">=": c >= v[0]}[op]
    return F.coalesce(found, F.lit(False))


def guarded(df: DataFrame, rule: Rule) -> Column:
    return test(df, rule.guard[0], rule.guard[1], [rule.guard[2]])


def satisfied(df: DataFrame, rule: Rule) -> Column:
    every = [reduce(lambda a, b: a & b, [test(df, *a) for a in atoms]) for atoms in rule.groups.values()]
    return reduce(lambda a, b: a | b, every)


def usable(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    have = set(df.columns)
    return [r for r in rules if {r.guard[0], *(a[0] for g in r.groups.values() for a in g)} <= have]


def violation_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(source, cid, guarded, violated) for each rule, in one scan."""
    rules = usable(df, rules)
    row = df.agg(*[F.struct(F.count(F.when(guarded(df, r), 1)).alias("g"), F.count(F.when(guarded(df, r) & ~satisfied(df, r), 1)).alias("v")).alias(f"r{i}") for i, r in enumerate(rules)])
    items = F.array(*[F.struct(F.lit(r.key[0]).alias("source"), F.lit(r.key[1]).alias("cid"), F.col(f"r{i}.g").alias("guarded"), F.col(f"r{i}.v").alias("violated")) for i, r in enumerate(rules)])
    return row.select(F.explode(items).alias("x")).select("x.*")


NUMERIC = ("integer", "long", "short", "byte", "float", "double", "decimal")


def target(df: DataFrame, column: str, atoms: list[tuple[str, str, list[str]]], mode: str = "nearest", draw: Column | None = None) -> Column:
    """A value of the column that meets its atoms: null, or the one value; of a set or a range

    "nearest": the nearest allowed one (of text, the first), or the value moved to the bound it passes,
    "random": any, each as likely,
    "weighted": nearer ones more likely, by 1 / (1 + distance), and in a range more so towards that bound.

    A null counts as below the range. draw: a number in 0 to 1 a row, needed for the last two.
    """
    c, kind = F.col(column), df.schema[column].dataType
    own = [(op, v) for col, op, v in atoms if col == column]
    if any(op == "IS_NULL" for op, _ in own):
        return F.lit(None).cast(kind)
    if eq := [v[0] for op, v in own if op == "="]:
        return _value(df, column, eq[0])
    numeric = kind.typeName() in NUMERIC
    if sets := [set(v) for op, v in own if op == "IN"]:
        allowed = sorted(set.intersection(*sets))
        if not allowed:
            return c
        options = [_value(df, column, a) for a in allowed]
        apart = [F.coalesce(F.abs(c - o).cast("double"), F.lit(0.0)) if numeric else F.lit(0.0) for o in options]
        if mode == "nearest" and not numeric:
            return F.when(c.isin(allowed), c).otherwise(options[0])
        if mode == "nearest":
            pairs = [F.struct(d.alias("d"), o.alias("v")) for d, o in zip(apart, options, strict=True)]
            return (F.least(*pairs) if len(pairs) > 1 else pairs[0])["v"]
        weights = [1 / (1 + d) if mode == "weighted" else F.lit(1.0) for d in apart]
        out, left = options[-1], reduce(lambda x, y: x + y, weights) * draw
        sums = [reduce(lambda x, y: x + y, weights[: i + 1]) for i in range(len(weights))]
        for o, upto in reversed(list(zip(options, sums, strict=True))):
            out = F.when(left < upto, o).otherwise(out)
        return out
    low = [_value(df, column, v[0]) for op, v in own if op in (">=", ">")]
    high = [_value(df, column, v[0]) for op, v in own if op in ("<=", "<")]
    lo = F.greatest(*low) if len(low) > 1 else low[0] if low else None
    hi = F.least(*high) if len(high) > 1 else high[0] if high else None
    if mode != "nearest" and lo is not None and hi is not None and numeric:
        part = draw if mode == "random" else F.when(c > hi, 1 - draw * draw).otherwise(draw * draw)
        drawn = lo + (hi - lo) * part
        return (F.round(drawn) if kind.typeName() in NUMERIC[:4] else drawn).cast(kind)
    out = c if lo is None else F.greatest(c, lo)
    return out if hi is None else F.least(out, hi)


def repair(df: DataFrame, rules: list[Rule], fixed: tuple[str, ...] = (), mode: str = "nearest", key: str | None = None, seed: int = 0, explain: bool = False) -> DataFrame:
    """Rows that break a rule changed in as few columns as it names, rule after rule, in the rule's first alternative;
    fixed columns never change. Adds n_changed, and n_infeasible: rules still broken; with explain also changes, an
    array of texts (rule, column, before, after, and what the rule asks). mode: see target(); draws follow from the row's key and the seed.
    """
    rules, columns = usable(df, rules), df.columns
    if mode != "nearest" and key is None:
        raise ValueError("draws need a key")
    out = df.withColumns({f"_was_{c}": F.col(c) for c in columns}).withColumn("_said", F.expr("cast(array() as array<string>)"))
    for n, r in enumerate(rules):
        atoms = r.groups[min(r.groups)]
        change = sorted({a[0] for a in atoms} - set(fixed))
        draw = {c: seeded(F.concat_ws("|", F.col(f"_was_{key}").cast("string"), F.lit(f"{n}:{c}")), seed) / float(2**32) for c in change} if key else {}
        out = out.withColumn("_broken", guarded(df, r) & ~satisfied(df, r))
        if explain:
            out = out.withColumns({f"_old_{c}": F.col(c).cast("string") for c in change})
        out = out.withColumns({c: F.when(F.col("_broken"), target(df, c, atoms, mode, draw.get(c))).otherwise(F.col(c)) for c in change})
        if explain:
            asks = " and ".join(f"{c} {op}" if op == "IS_NULL" else f"{c} {op} {', '.join(v)}" for c, op, v in atoms)
            why = f", as {' '.join(map(str, r.guard[:2])) if r.guard[1] == 'IS_NULL' else ' '.join(map(str, r.guard))} asks {asks}"
            text = [F.when(F.col("_broken") & ~F.col(c).cast("string").eqNullSafe(F.col(f"_old_{c}")), F.concat(F.lit(f"{r.key[0]} {r.key[1]}: {c} "), F.coalesce(f"_old_{c}", F.lit("null")), F.lit(" to "), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(why))) for c in change]
            out = out.withColumn("_said", F.concat("_said", F.array_compact(F.array(*text)) if text else F.col("_said")))
    still = reduce(lambda a, b: a + b, [(guarded(df, r) & ~satisfied(df, r)).cast("int") for r in rules], F.lit(0))
    changed = reduce(lambda a, b: a + b, [(~F.col(c).eqNullSafe(F.col(f"_was_{c}"))).cast("int") for c in columns], F.lit(0))
    return out.select(*columns, changed.alias("n_changed"), still.alias("n_infeasible"), *[F.col("_said").alias("changes")] * explain)


def repair_onehot(df: DataFrame, cols: list[str], k: int, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Exactly one column k and the others 0. Fixed columns stay: if one of them is set the free ones go to 0, if none
    is the first free one that is set stays, else the first free one is set. infeasible: two fixed ones are set, a
    fixed value is neither 0 nor k, or all are fixed and none is set; such rows stay as they are."""
    free, kept = [c for c in cols if c not in fixed], [c for c in cols if c in fixed]
    on = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    n_fixed = reduce(lambda a, b: a + b, [on(c).cast("int") for c in kept], F.lit(0))
    odd = reduce(lambda a, b: a | b, [~F.coalesce(F.col(c).isin(0, k), F.lit(False)) for c in kept], F.lit(False))
    bad = (n_fixed > 1) | odd | ((n_fixed == 0) & F.lit(not free))
    first = F.coalesce(*[F.when(on(c), F.lit(c)) for c in free], F.lit(free[0])) if free else F.lit(None)
    out = df.withColumns({"infeasible": bad, "_one": F.when(n_fixed == 0, first)})
    value = {c: F.when(F.col("infeasible"), F.col(c)).otherwise(F.when(F.col("_one") == c, k).otherwise(0)).cast(df.schema[c].dataType) for c in free}
    return out.withColumns(value).drop("_one")


def repair_parity(df: DataFrame, cols: list[str], bit: int, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Sum of 0/1 columns even or odd as `bit` says, by flipping the last free one; infeasible if there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    wrong = F.pmod(total, F.lit(2)) != bit
    free = [c for c in cols if c not in fixed]
    out = df.withColumn("infeasible", wrong & F.lit(not free))
    if not free:
        return out
    last = free[-1]
    return out.withColumn(last, F.when(wrong, 1 - F.coalesce(F.col(last), F.lit(0))).otherwise(F.col(last)).cast(df.schema[last].dataType))
