"""Ring values as columns: maps for relations, structs for cofactors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_relation(key: Column) -> Column:
    """{key: 1.0}; null for a null key."""
    return F.when(key.isNotNull(), F.create_map(F.coalesce(key.cast("long"), F.lit(0)), F.lit(1.0)))


def relation_add(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def relation_sub(a: Column, b: Column) -> Column:
    """Keywise difference; keys that reach 0 stay."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))


def relation_mul(a: Column, b: Column) -> Column:
    """Every key of one with every key of the other, values multiplied."""
    pairs = F.flatten(F.transform(F.map_entries(a), lambda x: F.transform(F.map_entries(b), lambda y: F.struct(F.struct(x["key"].alias("k1"), y["key"].alias("k2")).alias("key"), (x["value"] * y["value"]).alias("value")))))
    return F.map_from_entries(pairs)


def relation_scale(a: Column, by: float) -> Column:
    return F.transform_values(a, lambda _, v: v * F.lit(float(by)))


def relation_sum(df: DataFrame, relation: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """SUM of relations as rows: (group columns,) k, v. Null relations are skipped."""
    column = F.col(relation) if isinstance(relation, str) else relation
    return df.select(*by, F.explode(column).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))


def relation_pack(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (group columns, k, v) as one map a group; a group's keys must fit a row."""
    return rows.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("relation"))


def relation_to_text(a: Column) -> Column:
    entries = F.transform(F.array_sort(F.map_entries(a)), lambda e: F.format_string("%d -> %.6f", e["key"], e["value"]))
    return F.format_string("%d, { %s }", F.size(a), F.array_join(entries, ", "))


def relation_from_text(text: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+) -> "), F.lit(1)), lambda k: k.cast("long"))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"-> ([^\s,}]+)"), F.lit(1)), lambda v: v.cast("double"))
    return F.map_from_arrays(keys, values)


def _numbers(columns: list[Column], kind: str) -> Column:
    return F.array(*columns) if columns else F.array().cast(f"array<{kind}>")


def to_cofactor(cont: Sequence[str] = (), cat: Sequence[str] = ()) -> Column:
    """The cofactor of a row: count, lin, quad (packed upper triangle), cat1, contcat (continuous
    features outermost), catcat. Null if a feature is."""
    x = [F.col(c).cast("double") for c in cont]
    k = [F.col(c).cast("long") for c in cat]
    quad = [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    one, pair = "map<bigint,double>", "map<struct<k1:bigint,k2:bigint>,double>"
    value = F.struct(
        F.lit(1).cast("long").alias("count"),
        _numbers(x, "double").alias("lin"),
        _numbers(quad, "double").alias("quad"),
        _numbers([F.create_map(c, F.lit(1.0)) for c in k], one).alias("cat1"),
        _numbers([F.create_map(c, v) for v in x for c in k], one).alias("contcat"),
        _numbers([F.create_map(F.struct(a.alias("k1"), b.alias("k2")), F.lit(1.0)) for a, b in combinations(k, 2)], pair).alias("catcat"),
    )
    whole = [F.col(c).isNotNull() for c in (*cont, *cat)]
    condition = whole[0] if whole else F.lit(True)
    for w in whole[1:]:
        condition = condition & w
    return F.when(condition, value)


def const_to_cofactor(n: int) -> Column:
    return to_cofactor().withField("count", F.lit(n).cast("long"))


def cont_to_cofactor(column: str) -> Column:
    return to_cofactor([column])


def cat_to_cofactor(column: str) -> Column:
    return to_cofactor((), [column])


def _with(a: Column, b: Column, f) -> Column:
    """f of two values, null if one is. Both are computed once a row, however often f names them:
    nested products would else repeat their inner ones at every mention."""
    met = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), f(p["a"], p["b"])))
    return F.get(met, F.lit(0))


def _combine(a: Column, b: Column, sign: int) -> Column:
    return _with(a, b, lambda x, y: _blend(x, y, sign))


def _blend(a: Column, b: Column, sign: int) -> Column:
    number = lambda x, y: x + sign * y
    maps = lambda x, y: relation_add(x, y) if sign == 1 else relation_sub(x, y)
    parts = [(a["count"] + sign * b["count"]).alias("count")]
    parts += [F.zip_with(a[f], b[f], number).alias(f) for f in ("lin", "quad")]
    return F.struct(*parts, *[F.zip_with(a[f], b[f], maps).alias(f) for f in ("cat1", "contcat", "catcat")])


def cofactor_add(a: Column, b: Column) -> Column:
    """Sum of two cofactor columns over the same features."""
    return _combine(a, b, 1)


def cofactor_sub(a: Column, b: Column) -> Column:
    return _combine(a, b, -1)


def _times(column: Column, by: Column) -> Column:
    """Every number of an array times one."""
    return F.transform(column, lambda v: v * by)


def _maps_times(column: Column, by: Column) -> Column:
    return F.transform(column, lambda m: F.transform_values(m, lambda _, v: v * by))


def _triangle(packed: Column, n: Column, i: Column, strict: bool) -> Column:
    """Entries (i, j) of a packed upper triangle over n features, j from i on, or after i."""
    d = 1 if strict else 0
    begin = i * n - i * (i - 1) / 2 + 1 - (i if strict else F.lit(0))
    return F.slice(packed, begin.cast("int"), (n - i - d).cast("int"))


def _each(n: Column, f) -> Column:
    """f of 0 to n - 1, arrays joined."""
    return F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), f))


def cofactor_mul(a: Column, b: Column) -> Column:
    """Product of two cofactor columns: the features of the one, then those of the other."""
    return _with(a, b, _product)


def _product(a: Column, b: Column) -> Column:
    n, m = a["count"].cast("double"), b["count"].cast("double")
    x, y, c, d = F.size(a["lin"]), F.size(b["lin"]), F.size(a["cat1"]), F.size(b["cat1"])
    quad = F.concat(_each(x, lambda i: F.concat(_times(_triangle(a["quad"], x, i, False), m), _times(b["lin"], F.element_at(a["lin"], i + 1)))), _times(b["quad"], n))
    contcat = F.concat(
        _each(x, lambda i: F.concat(_maps_times(F.slice(a["contcat"], (i * c + 1).cast("int"), c), m), _maps_times(b["cat1"], F.element_at(a["lin"], i + 1)))),
        _each(y, lambda i: F.concat(_maps_times(a["cat1"], F.element_at(b["lin"], i + 1)), _maps_times(F.slice(b["contcat"], (i * d + 1).cast("int"), d), n))),
    )
    catcat = F.concat(_each(c, lambda i: F.concat(_maps_times(_triangle(a["catcat"], c, i, True), m), F.transform(b["cat1"], lambda r: relation_mul(F.element_at(a["cat1"], i + 1), r)))), _maps_times(b["catcat"], n))
    return F.struct(
        (a["count"] * b["count"]).alias("count"),
        F.concat(_times(a["lin"], m), _times(b["lin"], n)).alias("lin"),
        quad.alias("quad"),
        F.concat(_maps_times(a["cat1"], m), _maps_times(b["cat1"], n)).alias("cat1"),
        contcat.alias("contcat"),
        catcat.alias("catcat"),
    )


def _nb_combine(a: Column, b: Column, sign: int) -> Column:
    return _with(a, b, lambda x, y: _nb_blend(x, y, sign))


def _nb_blend(a: Column, b: Column, sign: int) -> Column:
    number = lambda x, y: x + sign * y
    maps = lambda x, y: relation_add(x, y) if sign == 1 else relation_sub(x, y)
    return F.struct((a["count"] + sign * b["count"]).alias("count"), *[F.zip_with(a[f], b[f], number).alias(f) for f in ("lin", "square")], F.zip_with(a["cat1"], b["cat1"], maps).alias("cat1"))


def nb_add(a: Column, b: Column) -> Column:
    """Sum of two naive-Bayes columns over the same features."""
    return _nb_combine(a, b, 1)


def nb_sub(a: Column, b: Column) -> Column:
    return _nb_combine(a, b, -1)


def nb_mul(a: Column, b: Column) -> Column:
    """Product of two naive-Bayes columns: the features of the one, then those of the other."""
    return _with(a, b, _nb_product)


def _nb_product(a: Column, b: Column) -> Column:
    n, m = a["count"].cast("double"), b["count"].cast("double")
    joined = [F.concat(_times(a[f], m), _times(b[f], n)).alias(f) for f in ("lin", "square")]
    return F.struct((a["count"] * b["count"]).alias("count"), *joined, F.concat(_maps_times(a["cat1"], m), _maps_times(b["cat1"], n)).alias("cat1"))


def to_nb_aggregates(cont: Sequence[str] = (), cat: Sequence[str] = ()) -> Column:
    """count, lin, square and cat1 of a row; null if a feature is."""
    x = [F.col(c).cast("double") for c in cont]
    value = F.struct(F.lit(1).cast("long").alias("count"), _numbers(x, "double").alias("lin"), _numbers([v * v for v in x], "double").alias("square"), _numbers([to_relation(F.col(c)) for c in cat], "map<bigint,double>").alias("cat1"))
    condition = F.lit(True)
    for c in (*cont, *cat):
        condition = condition & F.col(c).isNotNull()
    return F.when(condition, value)
