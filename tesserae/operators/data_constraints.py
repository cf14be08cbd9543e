"""Constraints mined from a flat table: keys, exact and approximate dependencies, conditional domains, one-hot and
parity groups. A level of the lattice is two aggregations over one scan, whatever the number of left sides; the
driver sees one row a left side."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import id_name_pattern, quantile_edges
from tesserae.sources.config import Config


@dataclass(frozen=True)
class Dependency:
    lhs: tuple[str, ...]
    rhs: str
    groups: int
    bad_groups: int
    bad_rows: int
    rows: int

    @property
    def error(self) -> float:
        return self.bad_groups / self.groups if self.groups else 0.0


def distinct_count(columns: list[str]) -> Column:
    """Distinct combinations; null is a value."""
    return F.count_distinct(F.struct(*[F.col(c) for c in columns]))


def key_profile(df: DataFrame, max_size: int = 1) -> DataFrame:
    """(lhs, is_unique, ratio_distinct, distinct, n) of every combination of at most max_size columns."""
    combos = [c for k in range(1, max_size + 1) for c in combinations(sorted(df.columns), k)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[distinct_count(list(c)).alias(f"d{i}") for i, c in enumerate(combos)])
    items = F.array(*[F.struct(F.lit(",".join(c)).alias("lhs"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(combos)])
    out = row.select("n", F.explode(items).alias("x")).select("x.lhs", "x.distinct", "n").filter("n > 0")
    return out.select("lhs", (F.col("distinct") == F.col("n")).alias("is_unique"), (F.col("distinct") / F.col("n")).alias("ratio_distinct"), "distinct", "n")


def key_fds(df: DataFrame, profile: DataFrame, near: float | None = None, exclude: set[tuple[str, str]] = frozenset()) -> list[tuple[tuple[str, ...], str]]:
    """Dependencies of every other column on each key, or on what is distinct in at least `near` of the rows."""
    keys = profile.filter("is_unique" if near is None else F.col("ratio_distinct") >= near).select("lhs").collect()
    return sorted({(tuple(k["lhs"].split(",")), c) for k in keys for c in df.columns if c not in k["lhs"].split(",") and (k["lhs"], c) not in exclude})


def candidate_keys(df: DataFrame, tokens: list[str], max_size: int = 3) -> list[tuple[str, ...]]:
    """Columns without nulls that are distinct in every row; if none is, the least combinations of id-like ones."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(c).alias("full"), F.count_distinct(c).alias("d")).alias(c) for c in df.columns]).first()
    full = [c for c in df.columns if counts[c]["full"] == counts["n"]]
    if single := [(c,) for c in full if counts[c]["d"] == counts["n"]]:
        return single
    pattern = id_name_pattern(tokens)
    like = [c for c in full if pattern.search(c)]
    for k in range(2, max_size + 1):
        combos = list(combinations(like, k))
        if combos:
            got = df.agg(*[distinct_count(list(c)).alias(str(i)) for i, c in enumerate(combos)]).first()
            if found := [c for i, c in enumerate(combos) if got[i] == counts["n"]]:
                return found
    return []


def violations(df: DataFrame, lhs_sets: list[tuple[str, ...]], rhs: list[str]) -> DataFrame:
    """(lhs, rhs, groups, bad_groups, bad_rows, rows) for all pairs of a left side and a right column outside it.

    Every row is grouped once for each left side; a group violates if a column has two values in it, null being one.
    """
    names = sorted({c for s in lhs_sets for c in s})
    place = {c: f"g{i}" for i, c in enumerate(names)}
    sets = [F.struct(F.lit(i).alias("set"), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(place[c]) for c in names]) for i, s in enumerate(lhs_sets)]
    rows = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(rhs)], F.explode(F.array(*sets)).alias("k"))
    aggs = [((F.min(f"v{i}") != F.max(f"v{i}")) | ((F.count(f"v{i}") > 0) & (F.count(f"v{i}") < F.count(F.lit(1))))) for i in range(len(rhs))]
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(a, F.lit(False)).alias(f"b{i}") for i, a in enumerate(aggs)])
    per = groups.groupBy(F.col("k.set").alias("set")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"),
        *[F.sum(F.col(f"b{i}").cast("long")).alias(f"bad{i}") for i in range(len(rhs))],
        *[F.sum(F.when(F.col(f"b{i}"), F.col("n")).otherwise(0)).alias(f"badn{i}") for i in range(len(rhs))],
    )
    lhs = F.element_at(F.array(*[F.lit(",".join(s)) for s in lhs_sets]), F.col("set") + 1)
    items = F.array(*[F.struct(F.lit(c).alias("rhs"), F.col(f"bad{i}").alias("bad_groups"), F.col(f"badn{i}").alias("bad_rows")) for i, c in enumerate(rhs)])
    out = per.select(lhs.alias("lhs"), "groups", "rows", F.explode(items).alias("x")).select("lhs", "x.rhs", "groups", "x.bad_groups", "x.bad_rows", "rows")
    return out.filter(~F.array_contains(F.split("lhs", ","), F.col("rhs")))


def discover_fds(df: DataFrame, max_lhs: int = 2, eps: float = 0.01, exclude: set[tuple[str, str]] = frozenset()) -> tuple[list[Dependency], list[Dependency]]:
    """Exact and approximate dependencies with minimal left sides; `exclude` holds (comma list, column) to leave out.

    Approximate: at least one group violates, but no more than eps of the groups. A left side that contains a key
    of its own adds nothing and isn't grouped again.
    """
    columns, exact, near = sorted(df.columns), [], []
    for size in range(1, max_lhs + 1):
        known = {r: [set(d.lhs) for d in exact if d.rhs == r] for r in columns}
        open_ = lambda s, r: r not in s and not any(k <= set(s) for k in known[r])  # noqa: E731, B023
        sets = [s for s in combinations(columns, size) if any(open_(s, r) for r in columns)]
        if not sets:
            break
        for r in violations(df, sets, columns).collect():
            lhs = tuple(r["lhs"].split(","))
            if not open_(lhs, r["rhs"]) or (r["lhs"], r["rhs"]) in exclude:
                continue
            d = Dependency(lhs, r["rhs"], r["groups"], r["bad_groups"], r["bad_rows"], r["rows"])
            if d.bad_groups == 0:
                exact.append(d)
            elif d.error <= eps and not any(set(o.lhs) < set(lhs) and o.rhs == d.rhs for o in near):
                near.append(d)
    order = lambda d: (d.rhs, len(d.lhs), d.lhs)
    return sorted(exact, key=order), sorted(near, key=order)


def column_types(df: DataFrame, config: Config) -> DataFrame:
    """(column, kind, id_like, distinct, n): text and truth values are categorical, numbers up to the configured number
    of distinct values too, others continuous; id-like by name or by share of distinct values."""
    pattern = id_name_pattern(config.id_name_tokens)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[distinct_count([c]).alias(f"d{i}") for i, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct"), F.lit(t in ("string", "boolean")).alias("text"), F.lit(bool(pattern.search(c))).alias("named")) for i, (c, t) in enumerate(df.dtypes)])
    x = row.select("n", F.explode(items).alias("x")).select("n", "x.*")
    kind = F.when(F.col("text") | (F.col("distinct") <= config.cat_max_unique), "categorical").otherwise("continuous")
    return x.select("column", kind.alias("kind"), (F.col("named") | (F.col("distinct") / F.col("n") >= config.id_unique_frac)).alias("id_like"), "distinct", "n")


def domain_of_categories(df: DataFrame, a: str, b: str, config: Config, with_null: bool = False) -> DataFrame:
    """b = value => a IN allowed: (value, support, allowed[, or_null]) for values of b with enough rows and few enough
    values of a; or_null tells whether null is one of them."""
    per = df.groupBy(F.col(b).alias("value"), F.col(a).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("value").agg(F.sum("n").alias("support"), F.count(F.lit(1)).alias("many"), F.sort_array(F.collect_list("item")).alias("allowed"), F.bool_or(F.col("item").isNull()).alias("or_null"))
    return out.filter((F.col("support") >= config.min_group_support) & (F.col("many") <= config.max_allowed_set)).select("value", "support", "allowed", *["or_null"] * with_null)


def domain_of_range(df: DataFrame, a: str, b: str, config: Config) -> DataFrame:
    """b = value => lo <= a <= hi: (value, support, lo, hi), bounds exact or at the configured quantiles."""
    x = F.col(a).cast("double")
    lo, hi = (F.percentile(x, config.q_lo), F.percentile(x, config.q_hi)) if config.use_quantiles else (F.min(x), F.max(x))
    out = df.groupBy(F.col(b).alias("value")).agg(F.count(F.lit(1)).alias("support"), lo.alias("lo"), hi.alias("hi"))
    return out.filter((F.col("support") >= config.min_group_support) & F.col("lo").isNotNull())


def domain_of_bins(df: DataFrame, a: str, b: str, config: Config) -> DataFrame:
    """lo < b <= hi => a IN allowed: (bin, lo, hi, support, allowed) for equal-count bins of b, the first one closed."""
    from tesserae.functions.scalars import bin_of

    edges = quantile_edges(df, b, max(2, min(config.max_rhs_domain, 10)))
    part = df.withColumn("_bin", bin_of(F.col(b).cast("double"), edges)).filter("_bin is not null")
    out = domain_of_categories(part, a, "_bin", config).withColumnRenamed("value", "bin")
    pick = lambda shift: F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1 + shift)
    return out.select("bin", pick(0).alias("lo"), pick(1).alias("hi"), "support", "allowed")


def domain_atoms(df: DataFrame, fds: list[Dependency], config: Config) -> list[tuple]:
    """Atom rows of the conditional domains of all exact dependencies A -> B with a single, not id-like A: what B says
    about A. A null among the allowed values is a second alternative."""
    kinds = {r["column"]: r for r in column_types(df, config).collect()}
    rows, cid = [], 0
    for d in fds:
        if len(d.lhs) != 1 or kinds[d.lhs[0]]["id_like"]:
            continue
        a, b = d.lhs[0], d.rhs
        cat = {c: kinds[c]["kind"] == "categorical" for c in (a, b)}
        if cat[b] and kinds[b]["distinct"] > config.max_rhs_domain or not cat[a] and not cat[b]:
            continue
        if cat[b] and cat[a]:
            for r in domain_of_categories(df, a, b, config, with_null=True).orderBy("value").collect():  # at most max_rhs_domain rows
                cid += 1
                guard = (b, "IS_NULL" if r["value"] is None else "=", "IS_NULL" if r["value"] is None else str(r["value"]))
                allowed = [str(x) for x in r["allowed"] if x is not None]
                rows.append(("data", cid, 0, *guard, a, "IN", allowed))
                if r["or_null"]:
                    rows.append(("data", cid, 1, *guard, a, "IS_NULL", ["IS_NULL"]))
        elif cat[b]:
            for r in domain_of_range(df, a, b, config).orderBy("value").collect():
                cid += 1
                guard = (b, "IS_NULL" if r["value"] is None else "=", "IS_NULL" if r["value"] is None else str(r["value"]))
                rows += [("data", cid, 0, *guard, a, ">=", [repr(r["lo"])]), ("data", cid, 0, *guard, a, "<=", [repr(r["hi"])])]
    return rows


def full_cycles(fds: list[tuple[tuple[str, ...], str]]) -> list[tuple[str, ...]]:
    """Sets of columns each of which depends on the others."""
    edges = {(frozenset(lhs), rhs) for lhs, rhs in fds}
    sets = {lhs | {rhs} for lhs, rhs in edges}
    return sorted((tuple(sorted(s)) for s in sets if len(s) > 1 and all((s - {c}, c) in edges for c in s)), key=lambda t: (len(t), t))


def integrity(df: DataFrame, sets: list[tuple[str, ...]]) -> list[dict]:
    """One-hot and parity constraints that hold in all rows, one aggregation for all sets.

    one-hot: values 0 or one k > 0, at most one of them not 0; allow_zero tells whether rows of zeros occur. Else
    parity: values 0 or 1 whose sum is always even or always odd. Nulls and fractions rule a set out.
    """
    whole = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")}
    sets = [s for s in sets if set(s) <= whole]
    if not sets:
        return []
    aggs = []
    for i, s in enumerate(sets):
        total = reduce(lambda a, b: a + b, [F.col(c).cast("long") for c in s])
        nonzero = reduce(lambda a, b: a + b, [(F.col(c) != 0).cast("int") for c in s])
        least, most = (F.least if len(s) > 1 else lambda x: x), (F.greatest if len(s) > 1 else lambda x: x)
        low, high = least(*map(F.col, s)), most(*map(F.col, s))
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in s])
        aggs.append(F.struct(
            F.min(full.cast("int")).alias("full"), F.max(nonzero).alias("most_set"), F.min(nonzero).alias("least_set"),
            F.min(low).alias("low"), F.min(F.when(high != 0, high)).alias("k_min"), F.max(high).alias("k_max"),
            F.min(F.pmod(total, F.lit(2))).alias("p0"), F.max(F.pmod(total, F.lit(2))).alias("p1"),
        ).alias(f"s{i}"))
    got, out = df.agg(*aggs).first(), []
    for i, s in enumerate(sets):
        r = got[i]
        if r["full"] != 1:
            continue
        base = {"cols": ",".join(s), "k": None, "parity_bit": None, "allow_zero": r["least_set"] == 0}
        if r["most_set"] == 1 and r["low"] >= 0 and r["k_min"] == r["k_max"]:
            out.append(base | {"kind": "onehot_2" if len(s) == 2 else "onehot_m", "k": int(r["k_max"])})
        elif r["low"] >= 0 and r["k_max"] <= 1 and r["p0"] == r["p1"]:
            out.append(base | {"kind": "parity", "parity_bit": int(r["p0"])})
    return out
