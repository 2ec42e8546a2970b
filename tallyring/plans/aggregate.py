"""SUM over rows, compiled to partial aggregates.

Rows are summed once, by all categorical features together (and the caller's groups), which
shuffles one row a task and combination that occurs. Count, sums and sums of products, those of
single categories and those of pairs are GROUPING SETS over these few rows, in the same job.
Only sums are collected: one row a group, and one a category or pair of categories that occur.
Beyond ``WIDE`` continuous features, without groups and decimals, products are summed apart: each
task sums its rows' in numpy and sends one packed triangle.

Where the sums of a feature show that its values lie so far from 0 that doubles keep too little of
what varies, rows are summed once more about the means found, a group by its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyring.operators.ring import Cofactor, NBAggregates

#: Continuous features up to which sums of products stay one aggregate of 100 columns or fewer.
WIDE = 12
#: Variance by mean square below which sums about 0 have lost half the digits of the variance.
FAR = 1e-8
#: Columns of sums, apart from any feature's name.
_N, _S, _Q = "__n", "__s", "__q"


@dataclass(frozen=True)
class Spec:
    """Features by column name; a column may be continuous and categorical at once. ``decimal``
    (precision, scale) makes sums exact, whatever the order of rows; ``on_null`` raises, or skips
    rows with a null feature."""

    cont: tuple[str, ...] = ()
    cat: tuple[str, ...] = ()
    decimal: tuple[int, int] | None = None
    on_null: str = "raise"

    def __post_init__(self) -> None:
        object.__setattr__(self, "cont", tuple(self.cont))
        object.__setattr__(self, "cat", tuple(self.cat))
        if len({*self.cont}) < len(self.cont) or len({*self.cat}) < len(self.cat):
            raise ValueError("a feature is named twice in a role")
        if self.on_null not in ("raise", "skip"):
            raise ValueError("on_null is raise or skip")

    @property
    def kind(self) -> str:
        return f"decimal({self.decimal[0]},{self.decimal[1]})" if self.decimal else "double"

    def value(self, name: str) -> Column:
        return F.col(name).cast(self.kind)

    def rows(self, df: DataFrame) -> DataFrame:
        names = [*dict.fromkeys([*self.cont, *self.cat])]
        if not names:
            return df
        # a number is no sum's term if it is NaN or infinite; only columns of floats can be
        floats = [c for c in self.cont if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType)]
        lost = reduce(or_, [F.col(n).isNull() for n in names])
        broken = reduce(or_, [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in floats], F.lit(False))
        if self.on_null == "skip":
            return df.where(~lost & ~broken)
        return df.where(F.when(lost, F.raise_error(F.lit("a feature is null"))).when(broken, F.raise_error(F.lit("a feature is NaN or infinite"))).otherwise(F.lit(True)))


def _sums(df: DataFrame, spec: Spec, by: Sequence[str], products: bool) -> DataFrame:
    """Sums of every combination of groups and categories."""
    sums = [F.sum(spec.value(c)).alias(f"{_S}{i}") for i, c in enumerate(spec.cont)]
    if products:
        sums += [F.sum(spec.value(spec.cont[i]) * spec.value(spec.cont[j])).alias(f"{_Q}{i}_{j}") for i, j in _upper(len(spec.cont))]
    return spec.rows(df).groupBy(*dict.fromkeys([*by, *spec.cat])).agg(F.count(F.lit(1)).alias(_N), *sums)


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def grouped_sums(df: DataFrame, spec: Spec, by: Sequence[str] = (), products: bool = True, pairs: bool = True) -> DataFrame:
    """One row a (group and) feature set and categories: set (grouping id), the categorical columns
    (null where not in the set), n, s<i> and q<i>_<j>. The empty set has the scalars."""
    cats, k = list(spec.cat), len(spec.cont)
    rows = _sums(df, spec, by, products)
    # groups keep a name of their own, as one of them may be a feature too
    own = {b: f"__by{i}" for i, b in enumerate(by)}
    rows = rows.select(*[F.col(b).alias(a) for b, a in own.items()], *cats, *[c for c in rows.columns if c.startswith((_N, _S, _Q)) and c not in cats])
    columns = [f"{_S}{i}" for i in range(k)] + ([f"{_Q}{i}_{j}" for i, j in _upper(k)] if products else [])
    sums = [F.sum(_N).cast("long").alias("n"), *[F.sum(c).cast("double").alias(c[2:]) for c in columns]]
    wanted = [(), *[(c,) for c in cats], *(combinations(cats, 2) if pairs else [])]
    sets = [[F.col(x) for x in (*own.values(), *s)] for s in wanted]
    if not own and not cats:
        return rows.agg(F.lit(0).cast("long").alias("set"), *sums)
    return rows.groupingSets(sets, *[F.col(x) for x in (*own.values(), *cats)]).agg(F.grouping_id().bitwiseAND(F.lit((1 << len(cats)) - 1)).alias("set"), *sums)


def grouping_ids(cats: Sequence[str]) -> dict[int, tuple[str, ...]]:
    """Grouping id (a bit for each column aggregated away, the first highest) of each set."""
    full = (1 << len(cats)) - 1
    bit = {c: 1 << (len(cats) - 1 - i) for i, c in enumerate(cats)}
    return {full & ~sum(bit[c] for c in s): s for s in [(), *[(c,) for c in cats], *combinations(cats, 2)]}


def _gram(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k + 1, k + 1)), 0
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns]])
            total += x.T @ x
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) * (k + 2) // 2), pa.int32()), pa.array(total[np.triu_indices(k + 1)])], names=["pos", "v"])

    return run


def gram(df: DataFrame, spec: Spec) -> DataFrame:
    """pos, v: the packed upper triangle of the sums of products over [1, cont...]."""
    x = spec.rows(df).select(*[F.col(c).cast("double").alias(c) for c in spec.cont])
    return x.mapInArrow(_gram(len(spec.cont)), "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))


def _fill(spec: Spec, rows: list[dict]) -> Cofactor:
    """A cofactor from its rows of :func:`grouped_sums`."""
    k, ids = len(spec.cont), grouping_ids(spec.cat)
    out = Cofactor(list(spec.cont), list(spec.cat))
    for r in rows:
        s, sums = ids[r["set"]], [r[f"s{i}"] or 0.0 for i in range(k)]
        if not s:
            out.count, out.lin = r["n"] or 0, np.array(sums, dtype=float)
            for i, j in _upper(k) if "q0_0" in r else ():
                out.quad[i, j] = out.quad[j, i] = r[f"q{i}_{j}"] or 0.0
        elif len(s) == 1:
            out.by_cat[s[0]][r[s[0]]] = np.array([r["n"], *sums], dtype=float)
        else:
            out.by_pair[s][r[s[0]], r[s[1]]] = float(r["n"])
    return out


def cofactor(df: DataFrame, spec: Spec) -> Cofactor | None:
    """SUM of all rows' cofactors; None for no rows."""
    found = cofactors(df, spec, [])
    return found.get(())


def shifted(df: DataFrame, spec: Spec, by: Sequence[str], shifts: dict[tuple, np.ndarray]) -> DataFrame:
    """Rows with every continuous feature as its value less its group's shift, in ``__x<i>``."""
    names = [f"__x{i}" for i in range(len(spec.cont))]
    if not by:
        off = [F.lit(float(v)).cast(spec.kind) for v in shifts[()]]
        return df.withColumns({n: spec.value(c) - o for n, c, o in zip(names, spec.cont, off, strict=True)})
    keys = ", ".join(f"`__g{i}` {df.schema[b].dataType.simpleString()}" for i, b in enumerate(by))
    rows = [(*key, *map(float, v)) for key, v in shifts.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join([keys, *[f"`__o{i}` double" for i in range(len(names))]]))
    on = reduce(and_, [F.col(b).eqNullSafe(F.col(f"__g{i}")) for i, b in enumerate(by)])
    # a row a group that was collected already
    met = df.join(F.broadcast(table), on, "left")
    off = {n: spec.value(c) - F.coalesce(F.col(f"__o{i}"), F.lit(0.0)).cast(spec.kind) for i, (n, c) in enumerate(zip(names, spec.cont, strict=True))}
    return met.withColumns(off).drop(*[f"__g{i}" for i in range(len(by))], *[f"__o{i}" for i in range(len(names))])


def far(count: float, lin: np.ndarray, square: np.ndarray) -> np.ndarray | None:
    """Means to sum about, if some feature is too far from 0 for its sums."""
    mean = lin / count
    if (square / count - mean**2 >= FAR * mean**2).all():
        return None
    return mean


def _near(spec: Spec, means: dict[tuple, np.ndarray]) -> tuple[Spec, dict[tuple, np.ndarray]]:
    """The features of :func:`shifted` rows, and the shifts as their type holds them."""
    names = tuple(f"__x{i}" for i in range(len(spec.cont)))
    if not spec.decimal:
        return Spec(names, spec.cat), means
    precision, digits = spec.decimal
    return Spec(names, spec.cat, (min(38, precision + 1), digits)), {k: np.array([round(float(x), digits) for x in v]) for k, v in means.items()}


def _again(df: DataFrame, spec: Spec, by: Sequence[str], means: dict[tuple, np.ndarray | None], collect) -> dict[tuple, tuple]:
    """Sums about the means of the groups that need it: key to aggregate and shift."""
    needed = {k: v for k, v in means.items() if v is not None}
    if not needed:
        return {}
    near, off = _near(spec, needed)
    found = collect(shifted(spec.rows(df), spec, by, off), near, by)
    return {k: (found[k], off[k]) for k in off if k in found}


def shifts(df: DataFrame, cont: Sequence[str]) -> dict[str, float]:
    """The means of the features that are too far from 0 for sums about 0, from one aggregate."""
    if not cont:
        return {}
    x = {c: F.col(c).cast("double") for c in cont}
    row = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cont)], *[F.var_pop(x[c]).alias(f"v{i}") for i, c in enumerate(cont)]).first()
    return {c: float(row[f"m{i}"]) for i, c in enumerate(cont) if row[f"m{i}"] is not None and row[f"v{i}"] < FAR * row[f"m{i}"] ** 2}


def cofactors(df: DataFrame, spec: Spec, by: Sequence[str], about: Mapping[str, float] | None = None) -> dict[tuple, Cofactor]:
    """SUM of cofactors a group, by the tuple of its keys. Groups are collected: the caller's
    keys must be few (classes, columns); cofactor_frame keeps them distributed. ``about``: shifts of
    features, where they are known (as from :func:`shifts`)."""
    by = list(by)
    if about is not None:
        if not any(about.get(c) for c in spec.cont):
            return _cofactors(df, spec, by)
        near, off = _near(spec, {(): np.array([about.get(c, 0.0) for c in spec.cont])})
        found = _cofactors(shifted(spec.rows(df), spec, (), off), near, by)
        return {k: Cofactor(list(spec.cont), a.cat, a.count, a.lin, a.quad, a.by_cat, a.by_pair, off[()]) for k, a in found.items()}
    found = _cofactors(df, spec, by)
    means = {k: far(a.count, a.lin, np.diag(a.quad)) for k, a in found.items()} if spec.cont else {}
    for key, (a, shift) in _again(df, spec, by, means, _cofactors).items():
        found[key] = Cofactor(list(spec.cont), a.cat, a.count, a.lin, a.quad, a.by_cat, a.by_pair, shift)
    return found


def _cofactors(df: DataFrame, spec: Spec, by: Sequence[str]) -> dict[tuple, Cofactor]:
    """Sums as they are, of every group."""
    wide = not by and len(spec.cont) > WIDE and spec.decimal is None
    parts: dict[tuple, list] = {}
    if not wide or spec.cat:
        for r in grouped_sums(df, spec, by, not wide).collect():
            parts.setdefault(tuple(r[f"__by{i}"] for i in range(len(by))), []).append(r.asDict())
    found = {key: _fill(spec, rows) for key, rows in parts.items()}
    if wide:
        packed = dict(gram(df, spec).collect())
        if not packed:
            return {}
        k = len(spec.cont)
        g = np.zeros((k + 1, k + 1))
        g[np.triu_indices(k + 1)] = [packed[i] for i in range(len(packed))]
        g = np.triu(g) + np.triu(g, 1).T
        whole = found.setdefault((), Cofactor(list(spec.cont), list(spec.cat)))
        whole.count, whole.lin, whole.quad = int(g[0, 0]), g[0, 1:], g[1:, 1:]
    return {key: a for key, a in found.items() if a.count}


def cofactor_frame(df: DataFrame, spec: Spec, by: Sequence[str] = ()) -> DataFrame:
    """SUM of cofactors as rows, one a group, distributed: the group columns and ``cofactor``, a
    struct in the form of :func:`tallyring.functions.lift.to_cofactor` (count, lin, quad, cat1,
    contcat, catcat), so it adds and multiplies with other columns of that form. Categories are
    numbers there; a group's maps must fit a row. Without rows and groups there is none."""
    k, cats = len(spec.cont), list(spec.cat)
    if len(cats) <= 1:
        return _packed(df, spec, by)
    rows = grouped_sums(df, spec, by).where("n > 0")
    ids = {s: i for i, s in grouping_ids(cats).items()}
    own = [f"__by{i}" for i in range(len(by))]
    one = lambda c: F.max(F.when(F.col("set") == ids[()], F.col(c)))
    pack = lambda s, key, v: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("set") == ids[s], F.struct(key.alias("key"), v.alias("value"))))))
    number = lambda columns, kind: F.array(*columns) if columns else F.array().cast(f"array<{kind}>")
    single, double = "map<bigint,double>", "map<struct<k1:bigint,k2:bigint>,double>"
    whole = F.struct(
        one("n").alias("count"),
        number([one(f"s{i}") for i in range(k)], "double").alias("lin"),
        number([one(f"q{i}_{j}") for i, j in _upper(k)], "double").alias("quad"),
        number([pack((c,), F.col(c).cast("long"), F.col("n").cast("double")) for c in cats], single).alias("cat1"),
        number([pack((c,), F.col(c).cast("long"), F.col(f"s{i}")) for i in range(k) for c in cats], single).alias("contcat"),
        number([pack((a, b), F.struct(F.col(a).cast("long").alias("k1"), F.col(b).cast("long").alias("k2")), F.col("n").cast("double")) for a, b in combinations(cats, 2)], double).alias("catcat"),
    )
    return rows.groupBy(*own).agg(whole.alias("cofactor")).where("cofactor.count > 0").select(*[F.col(o).alias(b) for o, b in zip(own, by, strict=True)], "cofactor")


def _packed(df: DataFrame, spec: Spec, by: Sequence[str]) -> DataFrame:
    """:func:`cofactor_frame` with one category at most: a group's rows of sums, one a category, are its maps'
    entries already, so no grouping sets repeat them."""
    k, cats, own = len(spec.cont), list(spec.cat), [f"__by{i}" for i in range(len(by))]
    sums = [f"{_S}{i}" for i in range(k)]
    products = [f"{_Q}{i}_{j}" for i, j in _upper(k)]
    rows = _sums(df, spec, by, True).select(*[F.col(b).alias(o) for b, o in zip(by, own, strict=True)], *[F.col(c).cast("long").alias("__k") for c in cats], _N, *sums, *products)
    entry = F.struct(*[F.col("__k")] * len(cats), F.col(_N).cast("double").alias(_N), *[F.col(c).cast("double").alias(c) for c in sums])
    grouped = rows.groupBy(*own).agg(F.sum(_N).cast("long").alias(_N), *[F.sum(c).cast("double").alias(c) for c in (*sums, *products)], *[F.sort_array(F.collect_list(entry)).alias("__e") for _ in cats])
    number = lambda columns, kind: F.array(*columns) if columns else F.array().cast(f"array<{kind}>")
    held = lambda c: F.map_from_entries(F.transform("__e", lambda e: F.struct(e["__k"].alias("key"), e[c].alias("value"))))
    single, double = "map<bigint,double>", "map<struct<k1:bigint,k2:bigint>,double>"
    whole = F.struct(
        F.col(_N).alias("count"),
        number([F.col(c) for c in sums], "double").alias("lin"),
        number([F.col(c) for c in products], "double").alias("quad"),
        number([held(_N) for _ in cats], single).alias("cat1"),
        number([held(c) for c in sums for _ in cats], single).alias("contcat"),
        number([], double).alias("catcat"),
    )
    return grouped.where(f"{_N} > 0").select(*[F.col(o).alias(b) for o, b in zip(own, by, strict=True)], whole.alias("cofactor"))


def nb_aggregates(df: DataFrame, spec: Spec, by: Sequence[str]) -> dict[tuple, NBAggregates]:
    """SUM of naive-Bayes aggregates a group (classes: few by meaning), in one job, or two where
    features are far from 0."""
    by = list(by)
    found = _nb_aggregates(df, spec, by)
    means = {k: far(a.count, a.lin, a.square) for k, a in found.items()} if spec.cont else {}
    for key, (a, shift) in _again(df, spec, by, means, _nb_aggregates).items():
        found[key] = NBAggregates(list(spec.cont), a.cat, a.count, a.lin, a.square, a.by_cat, shift)
    return found


def _nb_aggregates(df: DataFrame, spec: Spec, by: Sequence[str]) -> dict[tuple, NBAggregates]:
    k, ids = len(spec.cont), grouping_ids(spec.cat)
    out: dict[tuple, NBAggregates] = {}
    for r in grouped_sums(df, spec, by, pairs=False).collect():
        key = tuple(r[f"__by{i}"] for i in range(len(by)))
        a = out.setdefault(key, NBAggregates(list(spec.cont), list(spec.cat)))
        if s := ids[r["set"]]:
            a.by_cat[s[0]][r[s[0]]] = float(r["n"])
        else:
            a.count = r["n"] or 0
            a.lin, a.square = (np.array([r[c] or 0.0 for c in names], dtype=float) for names in ([f"s{i}" for i in range(k)], [f"q{i}_{i}" for i in range(k)]))
    return {key: a for key, a in out.items() if a.count}
