"""SUM of columns that hold ring values: cofactors, naive-Bayes aggregates.

Every value is taken apart into terms, one a number it holds, keyed by the field, the place in it
and the category or pair of categories. Terms are summed by key, partially before the shuffle, so a
value travels no further than its task; what is shuffled is one row a task and key that
occurs. ``value_terms`` leaves the sums as rows, however many; ``value_sum`` packs them again into one
value a group, which must fit a row.

Null values are skipped; a group without any other value has the sum null. Values in a group must
have the same shape. Categories whose counts cancel stay, with 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyring.operators.ring import Cofactor, NBAggregates

_TERM = "struct<field:int,place:int,k1:bigint,k2:bigint,n:bigint,v:double>"
#: Fields of terms: the shape with the count, then those of the struct in their order.
_NONE, _COUNT = -1, 0
_OWN = ("__field", "__place", "__k1", "__k2")


def _fields(kind: T.StructType) -> list[tuple[int, str, bool, bool]]:
    """Number, name, whether it has maps, whether keys are pairs, of every field but the count."""
    out = []
    for i, f in enumerate(kind.fields):
        if f.name == "count":
            continue
        if not isinstance(f.dataType, T.ArrayType) or not isinstance(f.dataType.elementType, T.DoubleType | T.MapType):
            raise ValueError(f"no ring value: field {f.name} is {f.dataType.simpleString()}")
        maps = isinstance(f.dataType.elementType, T.MapType)
        out.append((i + 1, f.name, maps, maps and isinstance(f.dataType.elementType.keyType, T.StructType)))
    return out


def _term(field: int, place: Column, k1: Column, k2: Column, n: Column, v: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), place.cast("int").alias("place"), k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"), n.cast("bigint").alias("n"), v.cast("double").alias("v")).cast(_TERM)


def _numbers(field: int):
    """Terms of an array of numbers."""
    return lambda v, place: _term(field, place, F.lit(None), F.lit(None), F.lit(None), v)


def _entries(field: int, pairs: bool):
    """Terms of an array of maps; one without a key keeps the place of a map that is empty."""

    def of_map(held: Column, place: Column) -> Column:
        key = (lambda e: (e["key"]["k1"], e["key"]["k2"])) if pairs else (lambda e: (e["key"], F.lit(None)))
        return F.concat(F.array(_term(field, place, *[F.lit(None)] * 4)), F.transform(F.map_entries(held), lambda e: _term(field, place, *key(e), F.lit(None), e["value"])))

    return of_map


def _terms(value: Column, kind: T.StructType) -> Column:
    none, fields = F.lit(None), _fields(kind)
    shape = F.xxhash64(*[F.size(value[name]) for _, name, _, _ in fields])
    parts = [F.array(_term(_COUNT, F.lit(0), shape, none, value["count"], none))]
    for number, name, maps, pairs in fields:
        parts.append(F.flatten(F.transform(value[name], _entries(number, pairs))) if maps else F.transform(value[name], _numbers(number)))
    return F.when(value.isNull(), F.array(_term(_NONE, F.lit(0), *[none] * 4))).otherwise(F.concat(*parts))


def value_terms(df: DataFrame, column: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Summed terms as rows: group columns, __field (0 the count, then fields of the value in their
    order, from 1), __place, __k1, __k2, n (of the count) and v."""
    value = F.col(column) if isinstance(column, str) else column
    rows = df.select(*by, value.alias("__value"))
    kind = rows.schema["__value"].dataType
    if not isinstance(kind, T.StructType) or "count" not in kind.names:
        raise ValueError("the column holds no ring values")
    each = rows.select(*by, F.explode(_terms(F.col("__value"), kind)).alias("__t"))
    keys = [F.col(f"__t.{k[2:]}").alias(k) for k in _OWN]
    return each.groupBy(*by, *keys).agg(F.sum("__t.n").alias("n"), F.sum("__t.v").alias("v"))


def value_sum(df: DataFrame, column: str | Column, by: Sequence[str] = (), name: str = "total") -> DataFrame:
    """SUM of a column of cofactors or naive-Bayes aggregates: the group columns and ``name``, a value
    of the same form. Without groups there is one row, null for no values."""
    value = F.col(column) if isinstance(column, str) else column
    kind = df.select(value.alias("__value")).schema["__value"].dataType
    sums, fields = value_terms(df, value, by), _fields(kind)
    # one row a group and place first: a number, or a map by (k1, k2)
    entries = F.sort_array(F.collect_list(F.when(F.col("__k1").isNotNull(), F.struct(F.struct(F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).alias("key"), F.col("v").alias("value")))))
    shape = F.when(F.col("__field") == _COUNT, F.col("__k1"))
    places = sums.groupBy(*by, "__field", "__place").agg(F.sum("n").alias("n"), F.min(shape).alias("least"), F.max(shape).alias("most"), F.sum("v").alias("v"), F.map_from_entries(F.when(F.max("__field") > _COUNT, entries).otherwise(F.slice(entries, 1, 0))).alias("map"))

    def field(number: int, what: str) -> Column:
        """Numbers or maps of a field by place; maps have no order, so places look them up."""
        held = F.map_from_entries(F.collect_list(F.when(F.col("__field") == number, F.struct("__place", F.col(what).alias("x")))))
        turns = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(turns, lambda i: F.element_at(held, i))

    def part(number: int, maps: bool, pairs: bool) -> Column:
        if not maps:
            return field(number, "v")
        return field(number, "map") if pairs else F.transform(field(number, "map"), lambda m: F.transform_keys(m, lambda k, _: k["k1"]))

    count = F.max(F.when(F.col("__field") == _COUNT, F.col("n")))
    parts = [F.when(F.max("least") != F.max("most"), F.raise_error(F.lit("values of different shapes"))).otherwise(count).cast("bigint").alias("count")]
    parts += [part(number, maps, pairs).alias(f) for number, f, maps, pairs in fields]
    packed = places.groupBy(*by).agg(F.when(count.isNotNull(), F.struct(*parts)).alias(name))
    return packed.select(*by, name)


def cofactor_of(value: Row | None, cont: Sequence[str], cat: Sequence[str] = ()) -> Cofactor | None:
    """A collected cofactor value as one of the driver, for models; features in the value's order."""
    if value is None:
        return None
    cont, cat, n, m = list(cont), list(cat), len(cont), len(cat)
    out = Cofactor(cont, cat, value["count"], value["lin"])
    packed = iter(value["quad"])
    for i in range(n):
        for j in range(i, n):
            out.quad[i, j] = out.quad[j, i] = next(packed)
    for j, c in enumerate(cat):
        out.by_cat[c] = {k: np.array([v, *[value["contcat"][i * m + j].get(k, 0.0) for i in range(n)]], dtype=float) for k, v in value["cat1"][j].items()}
    for pair, held in zip(out.by_pair, value["catcat"], strict=True):
        out.by_pair[pair] = {(k["k1"], k["k2"]): v for k, v in held.items()}
    return out


def nb_of(value: Row | None, cont: Sequence[str], cat: Sequence[str] = ()) -> NBAggregates | None:
    """As :func:`cofactor_of`, of naive-Bayes aggregates."""
    if value is None:
        return None
    return NBAggregates(list(cont), list(cat), value["count"], value["lin"], value["square"], dict(zip(cat, map(dict, value["cat1"]), strict=True)))
