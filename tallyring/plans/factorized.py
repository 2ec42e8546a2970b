"""SUM of cofactors over a join that is never made.

Each table is summed by its join keys and categories in one pass; grouping sets over those sums
give, a key, the whole, each category and each pair of categories, marked by a mask with a bit a
categorical feature. The sums of two tables multiply key by key, where their masks together have
two bits at most, and are summed again by the keys still needed. A tree of tables is folded from
its leaves in one plan: a table is read once, an edge is one join, and one job returns all sums.
What is shuffled is rows a key and category, not joined rows.

Summing first pays where joined rows are many more than the sums; where keys hardly repeat on one
side, the join as it stands has fewer rows. ``cofactor`` looks at distinct counts of keys and of keys
with categories (sketches of all tables, in one job) and takes the way with fewer rows; children
with fewer sums are multiplied first.

Rows with a null key join nothing and go first. Of the others, a null feature, NaN or infinity raises
(even in a row that nothing joins), or is skipped, as in the sums over one table. Features
far from 0 are summed again about their means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyring.operators.ring import Cofactor
from tallyring.plans import aggregate
from tallyring.plans.aggregate import Spec, far


@dataclass
class Table:
    """A table with its features; each child is (key here, key there, table)."""

    df: DataFrame
    cont: Sequence[str] = ()
    cat: Sequence[str] = ()
    on_null: str = "raise"
    children: list[tuple[str, str, Table]] = field(default_factory=list)

    def join(self, key: str, other: Table, other_key: str | None = None) -> Table:
        self.children.append((key, other_key or key, other))
        return self


@dataclass
class _Sums:
    """Grouped sums in one frame: keys, categories (null where the mask ``m`` has no bit), ``c``,
    s.. and q.. (those for the empty mask alone)."""

    cont: list[str]
    cat: list[str]
    rows: DataFrame


def _s(x: str) -> str:
    return f"s__{x}"


def _q(a: str, b: str) -> str:
    return f"q__{min(a, b)}__{max(a, b)}"


def _pairs(cont: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cont) for b in cont[i:]]


def _local(t: Table, keys: list[str], shifts: dict[str, float]) -> _Sums:
    """One table's sums by ``keys``; rows with a null key would not join and go."""
    cont, cat = list(t.cont), list(t.cat)
    df = Spec(tuple(cont), tuple(cat), None, t.on_null).rows(t.df.dropna(subset=keys) if keys else t.df)
    named = [F.col(k).alias(f"k__{k}") for k in keys] + [F.col(a).alias(f"g__{a}") for a in cat] + [(F.col(a).cast("double") - F.lit(shifts.get(a, 0.0))).alias(f"x__{a}") for a in cont]
    x = {a: F.col(f"x__{a}") for a in cont}
    rows = df.select(*named).groupBy(*[f"k__{k}" for k in keys], *[f"g__{a}" for a in cat]).agg(F.count(F.lit(1)).cast("double").alias("c"), *[F.sum(x[a]).alias(_s(a)) for a in cont], *[F.sum(x[a] * x[b]).alias(_q(a, b)) for a, b in _pairs(cont)])
    if not cat:
        return _Sums(cont, cat, rows.withColumn("m", F.lit(0).cast("long")))
    own = [F.col(f"k__{k}") for k in keys]
    sets = [(), *[(a,) for a in cat], *combinations(cat, 2)]
    full = (1 << len(cat)) - 1
    mask = F.lit(full) - F.grouping_id().bitwiseAND(F.lit(full))
    grouped = rows.groupingSets([[*own, *[F.col(f"g__{a}") for a in s]] for s in sets], *own, *[F.col(f"g__{a}") for a in cat])
    return _Sums(cont, cat, grouped.agg(mask.cast("long").alias("m"), *[F.sum(n).alias(n) for n in ["c", *_columns(cont)]]))


def _columns(cont: Sequence[str]) -> list[str]:
    return [*map(_s, cont), *[_q(a, b) for a, b in _pairs(cont)]]


def _multiply(left: _Sums, right: _Sums, key: str, other: str, keep: list[str]) -> _Sums:
    """Product of two tables' sums where left.key = right.other, summed by ``keep``."""
    r = right.rows.select(F.col(f"k__{other}").alias("__k"), F.col("m").alias("__m"), F.col("c").alias("__c"), *[F.col(f"g__{a}") for a in right.cat], *[F.col(n).alias(f"r__{n}") for n in _columns(right.cont)])
    fits = F.bit_count("m") + F.bit_count("__m") <= 2
    both = left.rows.join(r, (F.col(f"k__{key}") == F.col("__k")) & fits)
    c, d = F.col("c"), F.col("__c")
    sums = [F.sum(c * d).alias("c"), *[F.sum(F.col(n) * d).alias(n) for n in _columns(left.cont)], *[F.sum(F.col(f"r__{n}") * c).alias(n) for n in _columns(right.cont)]]
    sums += [F.sum(F.col(_s(a)) * F.col(f"r__{_s(b)}")).alias(_q(a, b)) for a in left.cont for b in right.cont]
    mask = F.shiftleft("m", len(right.cat)).bitwiseOR(F.col("__m")).alias("m")
    cat = [*left.cat, *right.cat]
    return _Sums([*left.cont, *right.cont], cat, both.groupBy(*[f"k__{k}" for k in keep], *[f"g__{a}" for a in cat], mask).agg(*sums))


def sums(t: Table, up: Sequence[str] = (), shifts: dict[str, float] | None = None) -> _Sums:
    """Sums over the tree below ``t``, by the columns ``up`` of t, of features less their shifts."""
    own, shifts = list(dict.fromkeys([*up, *[k for k, _, _ in t.children]])), shifts or {}
    now = _local(t, own, shifts)
    for i, (key, other, child) in enumerate(t.children):
        still = list(dict.fromkeys([*up, *[k for k, _, _ in t.children[i + 1 :]]]))
        now = _multiply(now, sums(child, [other], shifts), key, other, still)
    return now


@dataclass
class Estimate:
    """Rows of the join of a tree, rows of sums that the factorised way makes and shuffles, and of
    each table its rows (n), sums (groups) and distinct keys."""

    joined: float
    summed: float
    tables: list[dict]


def _tables(t: Table, up: str | None = None) -> list[tuple[Table, str | None]]:
    return [(t, up), *[x for _, other, child in t.children for x in _tables(child, other)]]


def estimate(t: Table) -> Estimate:
    """Counts and sketches of every table of the tree, one row each, collected from one job."""
    own, parts = _tables(t), []
    for i, (table, up) in enumerate(own):
        keys = list(dict.fromkeys([*([up] if up else []), *[k for k, _, _ in table.children]]))
        grouped = [F.col(c) for c in dict.fromkeys([*keys, *table.cat])]
        distinct = [F.approx_count_distinct(F.col(k)).alias(k) for k in keys]
        groups = F.approx_count_distinct(F.xxhash64(*grouped)) if grouped else F.lit(1).cast("long")
        parts.append(table.df.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n"), groups.alias("groups"), F.array(*[d.cast("long") for d in distinct]).cast("array<long>").alias("keys")).withColumn("names", F.array(*map(F.lit, keys)).cast("array<string>")))
    rows = {r["i"]: {"n": r["n"], "groups": r["groups"], "keys": dict(zip(r["names"], r["keys"], strict=True))} for r in reduce(DataFrame.unionByName, parts).collect()}
    place = {id(table): i for i, (table, _) in enumerate(own)}

    def joined(table: Table) -> float:
        now = rows[place[id(table)]]
        out = float(now["n"])
        for key, other, child in table.children:
            out *= joined(child) / max(1, now["keys"][key], rows[place[id(child)]]["keys"][other])
        return out

    copies = [1 + len(table.cat) + len(table.cat) * (len(table.cat) - 1) // 2 for table, _ in own]
    return Estimate(joined(t), float(sum(rows[i]["groups"] * c for i, c in enumerate(copies))), [rows[i] for i in range(len(own))])


def _by_size(t: Table, sizes: dict[int, int]) -> Table:
    """The tree with each table's smallest child first."""
    children = sorted(t.children, key=lambda c: sizes[id(c[2])])
    return Table(t.df, t.cont, t.cat, t.on_null, [(k, o, _by_size(c, sizes)) for k, o, c in children])


def joined(t: Table) -> tuple[DataFrame, Spec]:
    """The join of the tree with all features, for the sums over its rows."""
    cont, cat = [c for x, _ in _tables(t) for c in x.cont], [c for x, _ in _tables(t) for c in x.cat]
    if len({*cont}) < len(cont) or len({*cat}) < len(cat):
        raise ValueError("two tables name a feature alike")

    def rows(table: Table, up: str | None) -> DataFrame:
        keys = list(dict.fromkeys([*([up] if up else []), *[k for k, _, _ in table.children]]))
        own = Spec(tuple(table.cont), tuple(table.cat), None, table.on_null).rows(table.df.dropna(subset=keys) if keys else table.df)
        out = own.select(*[F.col(k).alias(f"{id(table)}__{k}") for k in keys], *[F.col(c).alias(f"x__{c}") for c in table.cont], *[F.col(c).alias(f"g__{c}") for c in table.cat])
        for key, other, child in table.children:
            right = rows(child, other)
            out = out.join(right, out[f"{id(table)}__{key}"] == right[f"{id(child)}__{other}"])
        return out

    return rows(t, None), Spec(tuple(f"x__{c}" for c in cont), tuple(f"g__{c}" for c in cat))


def cofactor(t: Table, how: str = "auto") -> Cofactor | None:
    """SUM of cofactors over the join of the tree; None if it has no rows. Features of all tables
    must have different names. ``how``: summed (factorised), joined, or the one with fewer rows."""
    if how not in ("auto", "summed", "joined"):
        raise ValueError("how is auto, summed or joined")
    order = Cofactor([c for x, _ in _tables(t) for c in x.cont], [c for x, _ in _tables(t) for c in x.cat])
    if how == "auto":
        found = estimate(t)
        how = "summed" if found.summed < found.joined else "joined"
        t = _by_size(t, {id(x): r["groups"] for (x, _), r in zip(_tables(t), found.tables, strict=True)})
    if how == "joined":
        a = aggregate.cofactor(*joined(t))
        bare = lambda names: [n[3:] for n in names]
        return a and Cofactor(bare(a.cont), bare(a.cat), a.count, a.lin, a.quad, {c[3:]: v for c, v in a.by_cat.items()}, {(c[3:], d[3:]): v for (c, d), v in a.by_pair.items()}, a.shift).aligned(order)
    out = _collected(t, {})
    mean = far(out.count, out.lin, np.diag(out.quad)) if out is not None and out.cont else None
    out = out if mean is None else _collected(t, dict(zip(out.cont, map(float, mean), strict=True)))
    return out and out.aligned(order)


def _collected(t: Table, shifts: dict[str, float]) -> Cofactor | None:
    return collected(sums(t, (), shifts), shifts)


def collected(s: _Sums, shifts: Mapping[str, float]) -> Cofactor | None:
    """Sums without keys as one value; None for no rows."""
    if len({*s.cont}) < len(s.cont) or len({*s.cat}) < len(s.cat):
        raise ValueError("two tables name a feature alike")
    out = Cofactor(list(s.cont), list(s.cat), shift=[shifts.get(c, 0.0) for c in s.cont])
    for r in s.rows.collect():
        own = [a for i, a in enumerate(s.cat) if r["m"] >> (len(s.cat) - 1 - i) & 1]
        lin = np.array([r[_s(x)] or 0.0 for x in s.cont])
        if not own:
            out.count, out.lin = round(r["c"] or 0), lin
            out.quad = np.array([[r[_q(a, b)] or 0.0 for b in s.cont] for a in s.cont]).reshape(len(s.cont), len(s.cont))
        elif len(own) == 1:
            out.by_cat[own[0]][r[f"g__{own[0]}"]] = np.append(r["c"], lin)
        else:
            out.by_pair[own[0], own[1]][r[f"g__{own[0]}"], r[f"g__{own[1]}"]] = r["c"]
    return out if out.count else None
