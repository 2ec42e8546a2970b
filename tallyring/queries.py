"""Queries over the test tables, one an operator, with the SQL that gives the same rows.

Doubles leave as text with a fixed number of digits, so that sums in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyring.functions import lift, sql
from tallyring.operators import impute as imputation
from tallyring.operators import sparse
from tallyring.operators.models import LDA, QDA, LinearRegression, NaiveBayes
from tallyring.operators.ring import Cofactor, NBAggregates
from tallyring.operators.sigma import sigma
from tallyring.plans import aggregate, factorized, values
from tallyring.plans.aggregate import Spec
from tallyring.sources import tables
from tallyring.streaming.views import Views

EXACT = (12, 2)
LINE = ("l_quantity", "l_extendedprice", "l_discount")
FLAGS = ("l_returnflag", "l_linestatus")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Decimal sums often end in a 5 just where they are cut; a nudge far below the last digit makes
#: every engine round such ties alike.
NUDGE = 1 + 3e-11


def _sig(c: Column, digits: int = 8) -> Column:
    return F.format_string(f"%.{digits}e", c.cast("double") * F.lit(NUDGE) + F.lit(0.0))


def _sql_sig(c: str, digits: int = 8) -> str:
    return f"printf('%.{digits}e', ({c})::DOUBLE * {NUDGE!r}::DOUBLE + 0.0)"


def terms(a: Cofactor) -> list[tuple]:
    """term, k1, k2, value of every sum in a cofactor."""
    a = a.about()
    out: list[tuple] = [("count", None, None, float(a.count))]
    out += [(f"lin {c}", None, None, float(a.lin[i])) for i, c in enumerate(a.cont)]
    out += [(f"quad {c} {a.cont[j]}", None, None, float(a.quad[i, j])) for i, c in enumerate(a.cont) for j in range(i, len(a.cont))]
    for c, by in a.by_cat.items():
        for k, v in by.items():
            out.append((f"cat {c}", str(k), None, float(v[0])))
            out += [(f"contcat {x} {c}", str(k), None, float(v[1 + i])) for i, x in enumerate(a.cont)]
    return out + [(f"catcat {c} {d}", str(i), str(j), float(v)) for (c, d), by in a.by_pair.items() for (i, j), v in by.items()]


def _tidy(spark: SparkSession, rows: list[tuple], schema: str = "term string, k1 string, k2 string, value double", digits: int = 8) -> DataFrame:
    return spark.createDataFrame(rows, schema).withColumn("value", _sig(F.col("value"), digits))


def _terms_sql(source: str, cont: tuple, cat: tuple, exact: bool = True, digits: int = 8) -> str:
    x = {c: f"CAST({c} AS DECIMAL(12,2))" if exact else f"{c}::DOUBLE" for c in cont}
    out = [("'count'", "NULL", "NULL", "count(*)", "")]
    out += [(f"'lin {c}'", "NULL", "NULL", f"sum({x[c]})", "") for c in cont]
    out += [(f"'quad {c} {d}'", "NULL", "NULL", f"sum({x[c]} * {x[d]})", "") for i, c in enumerate(cont) for d in cont[i:]]
    for k in cat:
        out.append((f"'cat {k}'", k, "NULL", "count(*)", f"GROUP BY {k}"))
        out += [(f"'contcat {c} {k}'", k, "NULL", f"sum({x[c]})", f"GROUP BY {k}") for c in cont]
    out += [(f"'catcat {a} {b}'", a, b, "count(*)", f"GROUP BY {a}, {b}") for a, b in combinations(cat, 2)]
    return " UNION ALL ".join(f"SELECT {t} AS term, {i}::VARCHAR AS k1, {j}::VARCHAR AS k2, {_sql_sig(v, digits)} AS value FROM {source} {g}" for t, i, j, v, g in out)


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# relations
def _a() -> Column:
    return lift.to_relation(F.col("l_linenumber"))


def _b() -> Column:
    return lift.to_relation((F.col("l_quantity") % 7).cast("int"))


_AB = "SELECT l_linenumber AS a, (l_quantity % 7)::INT AS b FROM lineitem"


def _entries(df: DataFrame, value: Column) -> DataFrame:
    return df.select(F.explode(value).alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))


@query("relation_sum", "SELECT p_size::BIGINT AS k, count(*)::DOUBLE AS v FROM part GROUP BY p_size")
def _(spark, sf):
    return lift.relation_sum(_t(spark, sf, "part"), lift.to_relation(F.col("p_size")))


@query("relation_sum_grouped", "SELECT c_mktsegment, c_nationkey::BIGINT AS k, count(*)::DOUBLE AS v FROM customer GROUP BY ALL")
def _(spark, sf):
    return lift.relation_sum(_t(spark, sf, "customer"), lift.to_relation(F.col("c_nationkey")), ["c_mktsegment"])


@query("relation_add", f"WITH t AS ({_AB}), e AS (SELECT a AS k, CASE WHEN a = b THEN 2.0 ELSE 1.0 END AS v FROM t UNION ALL SELECT b, 1.0 FROM t WHERE a <> b) SELECT k::BIGINT AS k, v::DOUBLE AS v, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    return _entries(_t(spark, sf, "lineitem"), lift.relation_add(_a(), _b()))


@query("relation_sub", f"WITH t AS ({_AB}), e AS (SELECT a AS k, CASE WHEN a = b THEN 0.0 ELSE 1.0 END AS v FROM t UNION ALL SELECT b, -1.0 FROM t WHERE a <> b) SELECT k::BIGINT AS k, v::DOUBLE AS v, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    return _entries(_t(spark, sf, "lineitem"), lift.relation_sub(_a(), _b()))


@query("relation_mul", f"SELECT a::BIGINT AS k1, b::BIGINT AS k2, count(*)::DOUBLE AS v FROM ({_AB}) GROUP BY ALL")
def _(spark, sf):
    product = lift.relation_mul(_a(), _b())
    return lift.relation_sum(_t(spark, sf, "lineitem"), product).select("k.k1", "k.k2", "v")


@query("relation_scale", "SELECT l_linenumber::BIGINT AS k, 2.5 * count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return lift.relation_sum(_t(spark, sf, "lineitem"), lift.relation_scale(_a(), 2.5))


@query("relation_text", "SELECT '1, { ' || c_nationkey || ' -> 1.000000 }' AS said, c_nationkey::BIGINT AS k, 1.0::DOUBLE AS v, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, sf):
    said = _t(spark, sf, "customer").select(lift.relation_to_text(lift.to_relation(F.col("c_nationkey"))).alias("said"))
    return said.select("said", F.explode(lift.relation_from_text(F.col("said"))).alias("k", "v")).groupBy("said", "k", "v").agg(F.count("*").alias("n"))


# cofactors
@query("cofactor_lift", "SELECT s_suppkey, 1::BIGINT AS n, s_acctbal AS s, s_acctbal * s_acctbal AS q, s_nationkey::BIGINT AS k, s_acctbal AS x FROM supplier")
def _(spark, sf):
    c = lift.to_cofactor(["s_acctbal"], ["s_nationkey"])
    rows = _t(spark, sf, "supplier").select("s_suppkey", c.alias("c"))
    return rows.select("s_suppkey", F.col("c.count").alias("n"), F.col("c.lin")[0].alias("s"), F.col("c.quad")[0].alias("q"), F.map_keys(F.col("c.cat1")[0])[0].alias("k"), F.map_values(F.col("c.contcat")[0])[0].alias("x"))


@query("cofactor_const", "SELECT (333 * count(*))::BIGINT AS n FROM nation")
def _(spark, sf):
    return _t(spark, sf, "nation").select(lift.const_to_cofactor(333).alias("c")).agg(F.sum("c.count").alias("n"))


@query("cofactor_sum_cont", _terms_sql("lineitem", LINE, ()))
def _(spark, sf):
    return _tidy(spark, terms(aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(LINE, (), EXACT))))


@query("cofactor_sum_cat", _terms_sql("lineitem", (), FLAGS))
def _(spark, sf):
    return _tidy(spark, terms(aggregate.cofactor(_t(spark, sf, "lineitem"), Spec((), FLAGS, EXACT))))


@query("cofactor_sum_mixed", _terms_sql("lineitem", LINE, (*FLAGS, "l_linenumber")))
def _(spark, sf):
    return _tidy(spark, terms(aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(LINE, (*FLAGS, "l_linenumber"), EXACT))))


@query("cofactor_grouped", "SELECT l_linenumber AS g, term, k1, k2, value FROM (" + " UNION ALL ".join(f"SELECT {g} AS l_linenumber, t.* FROM ({_terms_sql(f'(SELECT * FROM lineitem WHERE l_linenumber = {g})', ('l_quantity', 'l_tax'), FLAGS)}) t" for g in range(1, 8)) + ") WHERE l_linenumber IN (SELECT l_linenumber FROM lineitem)")
def _(spark, sf):
    found = aggregate.cofactors(_t(spark, sf, "lineitem"), Spec(("l_quantity", "l_tax"), FLAGS, EXACT), ["l_linenumber"])
    return _tidy(spark, [(g[0], *t) for g, a in found.items() for t in terms(a)], "g int, term string, k1 string, k2 string, value double")


def _halves(spark, sf) -> tuple[Cofactor, Cofactor]:
    df, spec = _t(spark, sf, "lineitem"), Spec(("l_quantity", "l_tax"), FLAGS, EXACT)
    found = aggregate.cofactors(df.withColumn("low", F.col("l_linenumber") <= 3), spec, ["low"])
    return found[(True,)], found[(False,)]


@query("cofactor_add", _terms_sql("lineitem", ("l_quantity", "l_tax"), FLAGS))
def _(spark, sf):
    low, high = _halves(spark, sf)
    return _tidy(spark, terms(low + high))


@query("cofactor_sub", _terms_sql("(SELECT * FROM lineitem WHERE l_linenumber > 3)", ("l_quantity", "l_tax"), FLAGS))
def _(spark, sf):
    low, high = _halves(spark, sf)
    return _tidy(spark, terms((low + high - low).prune()))


@query("cofactor_mul", _terms_sql("supplier CROSS JOIN nation", ("s_acctbal",), ("s_nationkey", "n_regionkey")))
def _(spark, sf):
    a = aggregate.cofactor(_t(spark, sf, "supplier"), Spec(("s_acctbal",), ("s_nationkey",), EXACT))
    b = aggregate.cofactor(_t(spark, sf, "nation"), Spec((), ("n_regionkey",), EXACT))
    return _tidy(spark, terms(a * b))


@query("cofactor_two_roles", _terms_sql("lineitem", ("l_quantity", "l_linenumber"), ("l_linenumber", "l_linestatus")))
def _(spark, sf):
    return _tidy(spark, terms(aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(("l_quantity", "l_linenumber"), ("l_linenumber", "l_linestatus"), EXACT))))


@query("cofactor_frame_grouped", f"SELECT l_returnflag, 'count' AS term, NULL::BIGINT AS k, {_sql_sig('count(*)')} AS value FROM lineitem GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'quad', NULL, {_sql_sig('sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(12,2)))')} FROM lineitem GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'cat', l_linenumber, {_sql_sig('count(*)')} FROM lineitem GROUP BY l_returnflag, l_linenumber UNION ALL SELECT l_returnflag, 'contcat', l_linenumber, {_sql_sig('sum(CAST(l_quantity AS DECIMAL(12,2)))')} FROM lineitem GROUP BY l_returnflag, l_linenumber")
def _(spark, sf):
    rows = aggregate.cofactor_frame(_t(spark, sf, "lineitem"), Spec(("l_quantity",), ("l_linenumber",), EXACT), ["l_returnflag"])
    flat = [rows.select("l_returnflag", F.lit(t).alias("term"), F.lit(None).cast("long").alias("k"), v.cast("double").alias("value")) for t, v in (("count", F.col("cofactor.count")), ("quad", F.col("cofactor.quad")[0]))]
    flat += [rows.select("l_returnflag", F.lit(t).alias("term"), F.explode(v).alias("k", "value")) for t, v in (("cat", F.col("cofactor.cat1")[0]), ("contcat", F.col("cofactor.contcat")[0]))]
    return flat[0].unionByName(flat[1]).unionByName(flat[2]).unionByName(flat[3]).withColumn("value", _sig(F.col("value")))


@query("cofactor_mul_column", f"SELECT s_suppkey, 333::BIGINT AS n, {_sql_sig('333 * s_acctbal')} AS s, {_sql_sig('333 * s_acctbal * s_acctbal')} AS q, s_nationkey::BIGINT AS k, 333.0::DOUBLE AS c, {_sql_sig('333 * s_acctbal')} AS x FROM supplier")
def _(spark, sf):
    lifted = lift.cofactor_mul(lift.cofactor_mul(lift.cont_to_cofactor("s_acctbal"), lift.cat_to_cofactor("s_nationkey")), lift.const_to_cofactor(333))
    rows = _t(spark, sf, "supplier").select("s_suppkey", lifted.alias("c"))
    return rows.select("s_suppkey", F.col("c.count").alias("n"), _sig(F.col("c.lin")[0]).alias("s"), _sig(F.col("c.quad")[0]).alias("q"), F.map_keys(F.col("c.cat1")[0])[0].alias("k"), F.map_values(F.col("c.cat1")[0])[0].alias("c"), _sig(F.map_values(F.col("c.contcat")[0])[0]).alias("x"))


@query("cofactor_text", _terms_sql("lineitem", ("l_quantity", "l_tax"), ("l_linenumber",)))
def _(spark, sf):
    a = aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(("l_quantity", "l_tax"), ("l_linenumber",), EXACT))
    return _tidy(spark, terms(Cofactor.from_text(a.to_text(), a.cont, a.cat)))


@query("cofactor_stats", f"WITH r AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT count(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT count(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT count(DISTINCT (l_returnflag, l_linestatus)) FROM lineitem) SELECT 'relations' AS stat, {_sql_sig('count(*)')} AS value FROM r UNION ALL SELECT 'min', {_sql_sig('min(n)')} FROM r UNION ALL SELECT 'max', {_sql_sig('max(n)')} FROM r UNION ALL SELECT 'avg', {_sql_sig('avg(n)')} FROM r UNION ALL SELECT 'stddev', {_sql_sig('stddev_pop(n)')} FROM r")
def _(spark, sf):
    a = aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(("l_quantity",), FLAGS, EXACT))
    return _tidy(spark, [(k, float(v)) for k, v in a.stats().items()], "stat string, value double")


def _two_way(spark, sf) -> factorized.Table:
    lines = factorized.Table(_t(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice"), ("l_returnflag",))
    return factorized.Table(_t(spark, sf, "orders"), ("o_totalprice",), ("o_orderpriority",)).join("o_orderkey", lines, "l_orderkey")


@query("cofactor_factorized_2way", _terms_sql("orders JOIN lineitem ON o_orderkey = l_orderkey", ("o_totalprice", "l_quantity", "l_extendedprice"), ("o_orderpriority", "l_returnflag"), exact=False))
def _(spark, sf):
    return _tidy(spark, terms(factorized.cofactor(_two_way(spark, sf))))


@query("cofactor_joined_2way", SQL["cofactor_factorized_2way"])
def _(spark, sf):
    """The same sums over the join as it stands, for comparison."""
    joined = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return _tidy(spark, terms(aggregate.cofactor(joined, Spec(("o_totalprice", "l_quantity", "l_extendedprice"), ("o_orderpriority", "l_returnflag"), EXACT))))


@query("cofactor_factorized_3way", _terms_sql("orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey", ("o_totalprice", "l_quantity", "l_extendedprice", "c_acctbal"), ("o_orderpriority", "l_returnflag", "c_mktsegment"), exact=False))
def _(spark, sf):
    customers = factorized.Table(_t(spark, sf, "customer"), ("c_acctbal",), ("c_mktsegment",))
    return _tidy(spark, terms(factorized.cofactor(_two_way(spark, sf).join("o_custkey", customers, "c_custkey"))))


@query("cofactor_wide", _terms_sql("(SELECT " + ", ".join(f"(l_quantity * {i} + l_tax * {i * i})::DOUBLE AS w{i:02d}" for i in range(1, 15)) + " FROM lineitem)", tuple(f"w{i:02d}" for i in range(1, 15)), (), exact=False, digits=6))
def _(spark, sf):
    wide = _t(spark, sf, "lineitem").select(*[(F.col("l_quantity") * i + F.col("l_tax") * (i * i)).alias(f"w{i:02d}") for i in range(1, 15)])
    return _tidy(spark, terms(aggregate.cofactor(wide, Spec(tuple(wide.columns)))), digits=6)


def _lines_with_gaps() -> str:
    return "(SELECT * FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice) FROM orders) JOIN (SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem) ON o_orderkey = l_orderkey WHERE o_totalprice IS NOT NULL AND l_returnflag IS NOT NULL AND l_quantity IS NOT NULL)"


@query("cofactor_factorized_nulls", _terms_sql(_lines_with_gaps(), ("o_totalprice", "l_quantity"), ("o_orderpriority", "l_returnflag"), exact=False))
def _(spark, sf):
    """Rows without a feature are skipped before they meet, as in the sums over the join."""
    orders = _t(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    lines = _t(spark, sf, "lineitem").withColumns({"l_returnflag": F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")), "l_quantity": F.when(F.col("l_suppkey") % 9 != 0, F.col("l_quantity"))})
    child = factorized.Table(lines, ("l_quantity",), ("l_returnflag",), "skip")
    return _tidy(spark, terms(factorized.cofactor(factorized.Table(orders, ("o_totalprice",), ("o_orderpriority",), "skip").join("o_orderkey", child, "l_orderkey"))))


@query("cofactor_maintained", _terms_sql("orders JOIN (SELECT * FROM lineitem WHERE l_linenumber <> 1) ON o_orderkey = l_orderkey", ("o_totalprice", "l_quantity", "l_extendedprice"), ("o_orderpriority", "l_returnflag"), exact=False))
def _(spark, sf):
    """Sums over a join kept while rows come into both tables, and go from one."""
    views = Views(spark, _two_way(spark, sf), tables.step(spark))
    orders, lines = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    views.change(0, orders.where("o_orderkey % 2 = 0"))
    views.change(1, lines)
    views.change(0, orders.where("o_orderkey % 2 <> 0"))
    views.change(1, lines.where("l_linenumber = 1"), -1)
    return _tidy(spark, terms(views.root().prune()))


# sums of columns that hold values of the ring
_VALUES = "(SELECT *, l_suppkey % 7 AS m FROM lineitem)"


def _valued(spark, sf) -> DataFrame:
    """A cofactor a row, as a product of single lifts."""
    df = _t(spark, sf, "lineitem").withColumn("m", F.col("l_suppkey") % 7)
    value = lift.cofactor_mul(lift.cofactor_mul(lift.cont_to_cofactor("l_quantity"), lift.cat_to_cofactor("l_linenumber")), lift.cofactor_mul(lift.cat_to_cofactor("m"), lift.cont_to_cofactor("l_tax")))
    return df.select("l_returnflag", value.alias("value"))


_ROLES = (["l_quantity", "l_tax"], ["l_linenumber", "m"])


@query("cofactor_value_sum", _terms_sql(_VALUES, *map(tuple, _ROLES), exact=False))
def _(spark, sf):
    total = values.value_sum(_valued(spark, sf), "value").first()["total"]
    return _tidy(spark, terms(values.cofactor_of(total, *_ROLES)))


@query("cofactor_value_sum_grouped", f"SELECT l_returnflag, 'count' AS term, NULL::BIGINT AS k1, NULL::BIGINT AS k2, {_sql_sig('count(*)')} AS value FROM {_VALUES} GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'quad', NULL, NULL, {_sql_sig('sum(l_quantity * l_tax)')} FROM {_VALUES} GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'contcat', m, NULL, {_sql_sig('sum(l_quantity)')} FROM {_VALUES} GROUP BY l_returnflag, m UNION ALL SELECT l_returnflag, 'catcat', l_linenumber, m, {_sql_sig('count(*)')} FROM {_VALUES} GROUP BY l_returnflag, l_linenumber, m")
def _(spark, sf):
    rows, long = tables.checkpoint(values.value_sum(_valued(spark, sf), "value", ["l_returnflag"])), F.lit(None).cast("long")
    flat = [rows.select("l_returnflag", F.lit(t).alias("term"), long.alias("k1"), long.alias("k2"), v.cast("double").alias("value")) for t, v in (("count", F.col("total.count")), ("quad", F.col("total.quad")[1]))]
    flat.append(rows.select("l_returnflag", F.lit("contcat").alias("term"), F.explode(F.col("total.contcat")[1]).alias("k1", "value")).withColumn("k2", long))
    flat.append(rows.select("l_returnflag", F.lit("catcat").alias("term"), F.explode(F.col("total.catcat")[0]).alias("k", "value")).select("l_returnflag", "term", "k.k1", "k.k2", "value"))
    return reduce(DataFrame.unionByName, flat).withColumn("value", _sig(F.col("value")))


@query("cofactor_product_sum", _terms_sql("(SELECT *, o_custkey % 5 AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey)", ("l_quantity", "o_totalprice"), ("l_linenumber", "c"), exact=False))
def _(spark, sf):
    """Cofactors by key on both sides, multiplied where keys meet, and summed."""
    lines = aggregate.cofactor_frame(_t(spark, sf, "lineitem"), Spec(("l_quantity",), ("l_linenumber",)), ["l_orderkey"])
    orders = aggregate.cofactor_frame(_t(spark, sf, "orders").withColumn("c", F.col("o_custkey") % 5), Spec(("o_totalprice",), ("c",)), ["o_orderkey"])
    met = lines.withColumnRenamed("cofactor", "a").join(orders.withColumnRenamed("cofactor", "b"), F.col("l_orderkey") == F.col("o_orderkey"))
    total = values.value_sum(met, lift.cofactor_mul(F.col("a"), F.col("b"))).first()["total"]
    return _tidy(spark, terms(values.cofactor_of(total, ["l_quantity", "o_totalprice"], ["l_linenumber", "c"])))


# naive-Bayes aggregates
def _nb_terms(g: str, a: NBAggregates) -> list[tuple]:
    a = a.about()
    out = [(g, "count", None, float(a.count))]
    out += [(g, f"lin {c}", None, float(a.lin[i])) for i, c in enumerate(a.cont)] + [(g, f"square {c}", None, float(a.square[i])) for i, c in enumerate(a.cont)]
    return out + [(g, f"cat {c}", str(k), float(v)) for c, d in a.by_cat.items() for k, v in d.items()]


def _nb_sql(source: str, label: str, cont: tuple, cat: tuple) -> str:
    out = [("'count'", "NULL", "count(*)", "")]
    out += [(f"'lin {c}'", "NULL", f"sum(CAST({c} AS DECIMAL(12,2)))", "") for c in cont] + [(f"'square {c}'", "NULL", f"sum(CAST({c} AS DECIMAL(12,2)) * CAST({c} AS DECIMAL(12,2)))", "") for c in cont]
    out += [(f"'cat {c}'", c, "count(*)", f", {c}") for c in cat]
    return " UNION ALL ".join(f"SELECT {label} AS label, {t} AS term, {k}::VARCHAR AS k, {_sql_sig(v)} AS value FROM {source} GROUP BY {label}{g}" for t, k, v, g in out)


@query("nb_sum_grouped", _nb_sql("lineitem", "l_returnflag", ("l_quantity", "l_discount"), ("l_linestatus",)))
def _(spark, sf):
    found = aggregate.nb_aggregates(_t(spark, sf, "lineitem"), Spec(("l_quantity", "l_discount"), ("l_linestatus",), EXACT), ["l_returnflag"])
    return _tidy(spark, [t for g, a in found.items() for t in _nb_terms(g[0], a)], "label string, term string, k string, value double")


@query("nb_mul", _nb_sql("(SELECT 'all' AS g, * FROM supplier CROSS JOIN nation)", "g", ("s_acctbal",), ("n_regionkey",)))
def _(spark, sf):
    all_ = lambda name: _t(spark, sf, name).withColumn("g", F.lit("all"))
    a = aggregate.nb_aggregates(all_("supplier"), Spec(("s_acctbal",), (), EXACT), ["g"])[("all",)]
    b = aggregate.nb_aggregates(all_("nation"), Spec((), ("n_regionkey",), EXACT), ["g"])[("all",)]
    return _tidy(spark, _nb_terms("all", a * b), "label string, term string, k string, value double")


@query("nb_column", f"SELECT s_suppkey, 2::BIGINT AS n, {_sql_sig('2 * s_acctbal')} AS s, {_sql_sig('2 * s_acctbal * s_acctbal')} AS q, s_nationkey::BIGINT AS k, 2.0::DOUBLE AS c FROM supplier")
def _(spark, sf):
    a, b = lift.to_nb_aggregates(["s_acctbal"]), lift.to_nb_aggregates((), ["s_nationkey"])
    twice = lift.nb_sub(lift.nb_add(lift.nb_add(a, a), a), a)
    rows = _t(spark, sf, "supplier").select("s_suppkey", lift.nb_mul(twice, b).alias("c"))
    return rows.select("s_suppkey", F.col("c.count").alias("n"), _sig(F.col("c.lin")[0]).alias("s"), _sig(F.col("c.square")[0]).alias("q"), F.map_keys(F.col("c.cat1")[0])[0].alias("k"), F.map_values(F.col("c.cat1")[0])[0].alias("c"))


@query("nb_value_sum", _nb_sql("lineitem", "l_returnflag", ("l_quantity", "l_discount"), ("l_linenumber",)))
def _(spark, sf):
    cont, cat = ["l_quantity", "l_discount"], ["l_linenumber"]
    rows = _t(spark, sf, "lineitem").select("l_returnflag", lift.to_nb_aggregates(cont, cat).alias("value"))
    found = {r[0]: values.nb_of(r[1], cont, cat) for r in values.value_sum(rows, "value", ["l_returnflag"]).collect()}
    return _tidy(spark, [t for g, a in found.items() for t in _nb_terms(g, a)], "label string, term string, k string, value double")


@query("nb_text", _nb_sql("lineitem", "l_returnflag", ("l_quantity", "l_discount"), ("l_linenumber",)))
def _(spark, sf):
    found = aggregate.nb_aggregates(_t(spark, sf, "lineitem"), Spec(("l_quantity", "l_discount"), ("l_linenumber",), EXACT), ["l_returnflag"])
    again = {g[0]: NBAggregates.from_text(a.to_text(), a.cont, a.cat) for g, a in found.items()}
    return _tidy(spark, [t for g, a in again.items() for t in _nb_terms(g, a)], "label string, term string, k string, value double")


# dense matrices
@query("sigma_matrix", "WITH x AS (SELECT 1 AS one, CAST(l_quantity AS DECIMAL(12,2)) AS q, (l_linestatus = 'F')::INT AS f, (l_linestatus = 'O')::INT AS o FROM lineitem) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {_sql_sig(f'sum({a} * {b})')} AS value FROM x" for i, a in enumerate(("one", "q", "f", "o")) for j, b in enumerate(("one", "q", "f", "o"))))
def _(spark, sf):
    m = sigma(aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(("l_quantity",), ("l_linestatus",), EXACT))).matrix
    return _tidy(spark, [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "i int, j int, value double")


@query("sigma_standardized", f"SELECT 'q q' AS term, {_sql_sig('count(*)', 6)} AS value FROM lineitem UNION ALL SELECT 'q p', {_sql_sig('corr(l_quantity, l_extendedprice) * count(*)', 6)} FROM lineitem UNION ALL SELECT 'p p', {_sql_sig('count(*)', 6)} FROM lineitem")
def _(spark, sf):
    s, _, _ = sigma(aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(LINE[:2], (), EXACT))).standardized()
    m = s.matrix
    return _tidy(spark, [("q q", float(m[1, 1])), ("q p", float(m[1, 2])), ("p p", float(m[2, 2]))], "term string, value double", 6)


# linear regression
def _ols(y: str, a: str, b: str, source: str) -> str:
    d = f"(var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) ** 2)"
    wa = f"(covar_pop({y}, {a}) * var_pop({b}) - covar_pop({y}, {b}) * covar_pop({a}, {b})) / {d}"
    wb = f"(covar_pop({y}, {b}) * var_pop({a}) - covar_pop({y}, {a}) * covar_pop({a}, {b})) / {d}"
    return f"SELECT wa, wb, my - wa * ma - wb * mb AS b0 FROM (SELECT {wa} AS wa, {wb} AS wb, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb FROM {source})"


_XY = "l_extendedprice, l_quantity"


def _fit_rows(spark, m: LinearRegression) -> DataFrame:
    rows = [("intercept", m.intercept - (float(m.weights @ m.means) if m.means is not None else 0.0))] + [(str(n), float(w)) for n, w in zip(m.names, m.weights, strict=True)] + ([("sigma", m.sigma)] if m.sigma is not None else [])
    return _tidy(spark, rows, "term string, value double", 6)


def _fit_sql(intercept: str, slope: str, source: str = "lineitem", name: str = "l_quantity", more: str = "") -> str:
    return f"SELECT 'intercept' AS term, {_sql_sig(intercept, 6)} AS value FROM {source} UNION ALL SELECT '{name}', {_sql_sig(slope, 6)} FROM {source}{more}"


@query("linreg_train", _fit_sql(f"regr_intercept({_XY})", f"regr_slope({_XY})"))
def _(spark, sf):
    return _fit_rows(spark, LinearRegression.fit(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], decimal=EXACT))


@query("linreg_train_gd", _fit_sql(f"regr_intercept({_XY})", f"regr_slope({_XY})"))
def _(spark, sf):
    return _fit_rows(spark, LinearRegression.fit(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], decimal=EXACT, norm=True, solver="gd"))


_RIDGE = "covar_pop(l_extendedprice, l_quantity) / (var_pop(l_quantity) + 10.0)"


@query("linreg_train_ridge", _fit_sql(f"avg(l_extendedprice) - ({_RIDGE}) * avg(l_quantity)", _RIDGE))
def _(spark, sf):
    return _fit_rows(spark, LinearRegression.fit(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], decimal=EXACT, ridge=10.0))


@query("linreg_variance", _fit_sql(f"regr_intercept({_XY})", f"regr_slope({_XY})", more=f" UNION ALL SELECT 'sigma', {_sql_sig(f'sqrt((regr_syy({_XY}) - regr_slope({_XY}) * regr_sxy({_XY})) / count(*))', 6)} FROM lineitem"))
def _(spark, sf):
    return _fit_rows(spark, LinearRegression.fit(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], decimal=EXACT, variance=True))


@query("linreg_packed", _fit_sql(f"regr_intercept({_XY})", f"regr_slope({_XY})", name="x0"))
def _(spark, sf):
    a = aggregate.cofactor(_t(spark, sf, "lineitem"), Spec(LINE[:2], (), EXACT))
    packed = [float(a.count), *a.scalars()]
    return _fit_rows(spark, LinearRegression.from_packed(packed, 1))


@query("linreg_train_factorized", _fit_sql("regr_intercept(o_totalprice, l_quantity)", "regr_slope(o_totalprice, l_quantity)", "(SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"))
def _(spark, sf):
    lines = factorized.Table(_t(spark, sf, "lineitem"), ("l_quantity",))
    a = factorized.cofactor(factorized.Table(_t(spark, sf, "orders"), ("o_totalprice",)).join("o_orderkey", lines, "l_orderkey"))
    return _fit_rows(spark, LinearRegression.fit(a, "o_totalprice"))


_LATE = "(SELECT (o_orderkey * 7919 % 3600)::DOUBLE AS x, 3.0 * (o_orderkey * 7919 % 3600) + (o_custkey * 31 % 101) / 4.0 AS y FROM orders)"


@query("linreg_offset", f"SELECT 'slope' AS term, {_sql_sig('regr_slope(y, x)', 6)} AS value FROM {_LATE} UNION ALL SELECT 'sigma', {_sql_sig('sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*))', 6)} FROM {_LATE}")
def _(spark, sf):
    """Milliseconds since 1970 as a feature: the sums are taken about its mean."""
    x = F.col("o_orderkey") * 7919 % 3600 + F.lit(1_700_000_000_000)
    rows = _t(spark, sf, "orders").select(x.cast("double").alias("x"), (3.0 * x + F.col("o_custkey") * 31 % 101 / 4.0).alias("y"))
    m = LinearRegression.fit(rows, "y", ["x"], variance=True)
    return _tidy(spark, [("slope", float(m.weights[0])), ("sigma", m.sigma)], "term string, value double", 6)


@query("linreg_sql", f"{_fit_sql(f'regr_intercept({_XY})', f'regr_slope({_XY})')} UNION ALL SELECT 'predicted', {_sql_sig('avg(l_extendedprice)', 6)} FROM lineitem")
def _(spark, sf):
    """Training and prediction in SQL: partial sums, one row with the parameters, and its use."""
    sql.register(spark)
    _t(spark, sf, "lineitem").select("l_extendedprice", "l_quantity").createOrReplaceTempView("sql_lines")
    fitted = "SELECT params FROM linregr_train(TABLE(SELECT * FROM ring_sums(TABLE(SELECT * FROM sql_lines), 'l_extendedprice,l_quantity', '', '')) WITH SINGLE PARTITION, 'l_extendedprice', 0D, false, false)"
    rows = spark.sql(f"WITH m AS ({fitted}) SELECT max(params) AS params, avg(p) AS mean FROM (SELECT params, linregr_predict(params, array(l_quantity), array(), false, false) AS p FROM sql_lines, m)")
    terms_ = F.array(F.struct(F.lit("intercept").alias("term"), F.col("params")[1].alias("value")), F.struct(F.lit("l_quantity").alias("term"), F.col("params")[2].alias("value")), F.struct(F.lit("predicted").alias("term"), F.col("mean").alias("value")))
    return rows.select(F.inline(terms_)).select("term", _sig(F.col("value"), 6).alias("value"))


_UNLIKE_LINES = "(SELECT l_tax AS a, 100 * o_totalprice AS b, 1000 * l_tax + 0.001 * o_totalprice + ((l_orderkey * 31 + l_linenumber * 7) % 101 + 50) / 25.0 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("linreg_unscaled", f"SELECT term, value FROM (SELECT {_sql_sig('wa', 6)} AS a, {_sql_sig('wb', 6)} AS b, {_sql_sig('b0', 6)} AS c FROM ({_ols('y', 'a', 'b', _UNLIKE_LINES)})) UNPIVOT (value FOR term IN (a AS 'a', b AS 'b', c AS 'intercept'))")
def _(spark, sf):
    noise = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 101 + 50) / 25.0
    both = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(F.col("l_tax").alias("a"), (100 * F.col("o_totalprice")).alias("b"), (1000 * F.col("l_tax") + 0.001 * F.col("o_totalprice") + noise).alias("y"))
    return _fit_rows(spark, LinearRegression.fit(rows, "y", ["a", "b"]))


_WITHIN = "WITH g AS (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS ym, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS xm FROM lineitem), b AS (SELECT sum((l_quantity - xm) * (l_extendedprice - ym)) / sum((l_quantity - xm) * (l_quantity - xm)) AS slope FROM g), p AS (SELECT l_returnflag, l_linenumber, ym + slope * (l_quantity - xm) AS p FROM g, b)"


@query("linreg_predict", f"{_WITHIN} SELECT l_returnflag, l_linenumber, {_sql_sig('avg(p)', 6)} AS mean, {_sql_sig('min(p)', 6)} AS low, {_sql_sig('max(p)', 6)} AS high FROM p GROUP BY ALL")
def _(spark, sf):
    df = _t(spark, sf, "lineitem")
    p = df.withColumn("p", LinearRegression.fit(df, "l_extendedprice", ["l_quantity"], ["l_returnflag"], decimal=EXACT).predict_column())
    return p.groupBy("l_returnflag", "l_linenumber").agg(_sig(F.avg("p"), 6).alias("mean"), _sig(F.min("p"), 6).alias("low"), _sig(F.max("p"), 6).alias("high"))


@query("linreg_sparse", f"{_WITHIN.replace('PARTITION BY l_returnflag', 'PARTITION BY l_partkey')} SELECT l_returnflag, l_linenumber, {_sql_sig('avg(p)', 6)} AS mean, {_sql_sig('min(p)', 6)} AS low, {_sql_sig('max(p)', 6)} AS high FROM p GROUP BY ALL")
def _(spark, sf):
    """Every part is a category: conjugate gradients over a table of sums."""
    df = _t(spark, sf, "lineitem")
    p = df.withColumn("p", sparse.fit(df, "l_extendedprice", ["l_quantity"], ["l_partkey"]).predict_column())
    return p.groupBy("l_returnflag", "l_linenumber").agg(_sig(F.avg("p"), 6).alias("mean"), _sig(F.min("p"), 6).alias("low"), _sig(F.max("p"), 6).alias("high"))


# classifiers: bands of price from quantity and discount
_BANDS = "(SELECT *, CASE WHEN l_extendedprice < 15000 THEN 0 WHEN l_extendedprice < 40000 THEN 1 ELSE 2 END AS band, l_quantity AS x, 100 * l_discount AS y FROM lineitem)"


def _banded(spark, sf) -> DataFrame:
    band = F.when(F.col("l_extendedprice") < 15000, 0).when(F.col("l_extendedprice") < 40000, 1).otherwise(2)
    return _t(spark, sf, "lineitem").withColumns({"band": band, "x": F.col("l_quantity"), "y": 100 * F.col("l_discount")})


def _confusion(df: DataFrame, predicted: Column) -> DataFrame:
    return df.withColumn("predicted", predicted).groupBy("band", "predicted").agg(F.count("*").alias("n"))


def _classes(bands: str) -> str:
    return f"WITH t AS (SELECT * FROM {bands}), k AS (SELECT band, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM t GROUP BY band), a AS (SELECT sum(n) AS n FROM k)"


def _lda_sql(bands: str, shrinkage: float = 0.0) -> str:
    """Within-class moments, the 2 x 2 inverse, and weights and intercept of each class."""
    keep, spread = 1 - shrinkage, shrinkage / 2
    return f"{_classes(bands)}, u AS (SELECT sum(k.n * vx) / max(a.n) AS xx, sum(k.n * vy) / max(a.n) AS yy, sum(k.n * vxy) / max(a.n) AS xy FROM k, a), w AS (SELECT {keep} * xx + {spread} * (xx + yy) AS xx, {keep} * yy + {spread} * (xx + yy) AS yy, {keep} * xy AS xy FROM u), m AS (SELECT band, (yy * mx - xy * my) / (xx * yy - xy * xy) AS wx, (xx * my - xy * mx) / (xx * yy - xy * xy) AS wy, mx, my, k.n / a.n AS prior FROM k, w, a), f AS (SELECT band, wx, wy, ln(prior) - (wx * mx + wy * my) / 2 AS b FROM m)"


def _predicted_sql(fitted: str, score: str) -> str:
    """How often each class gets each prediction, ties to the first class."""
    return f"{fitted}, s AS (SELECT t.band, f.band AS predicted, row_number() OVER (PARTITION BY id ORDER BY {score} DESC, f.band) AS r FROM (SELECT *, row_number() OVER () AS id FROM t) t, f) SELECT band, predicted, count(*) AS n FROM s WHERE r = 1 GROUP BY ALL"


_CLASSES, _LDA_SQL, _LINEAR = _classes(_BANDS), _lda_sql(_BANDS), "wx * x + wy * y + b"
_SQUARE = "qx * x * x + qy * y * y + qxy * x * y + wx * x + wy * y + b"


@query("lda_train", f"{_LDA_SQL} SELECT band, 'x' AS term, {_sql_sig('wx', 6)} AS value FROM f UNION ALL SELECT band, 'y', {_sql_sig('wy', 6)} FROM f UNION ALL SELECT band, 'intercept', {_sql_sig('b', 6)} FROM f")
def _(spark, sf):
    m = LDA.fit(_banded(spark, sf), "band", ["x", "y"])
    rows = [(y, n, float(w)) for y, ws in zip(m.labels, m.weights, strict=True) for n, w in zip(m.names, ws, strict=True)]
    return _tidy(spark, rows + [(y, "intercept", float(b)) for y, b in zip(m.labels, m.intercepts, strict=True)], "band int, term string, value double", 6)


@query("lda_predict", _predicted_sql(_LDA_SQL, _LINEAR))
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, LDA.fit(df, "band", ["x", "y"]).predict_column())


def _qda_sql(bands: str) -> str:
    return f"{_classes(bands)}, f AS (SELECT band, -vy / (2 * d) AS qx, -vx / (2 * d) AS qy, vxy / d AS qxy, (vy * mx - vxy * my) / d AS wx, (vx * my - vxy * mx) / d AS wy, -(vy * mx * mx - 2 * vxy * mx * my + vx * my * my) / (2 * d) - ln(d) / 2 + ln(n / total) AS b FROM (SELECT k.*, vx * vy - vxy * vxy AS d, a.n AS total FROM k, a))"


_QDA_SQL = _qda_sql(_BANDS)


@query("qda_train", f"{_QDA_SQL} " + " UNION ALL ".join(f"SELECT band, '{t}' AS term, {_sql_sig(v, 5)} AS value FROM f" for t, v in (("xx", "qx"), ("yy", "qy"), ("x", "wx"), ("y", "wy"), ("intercept", "b"))))
def _(spark, sf):
    m = QDA.fit(_banded(spark, sf), "band", ["x", "y"])
    rows = []
    for y, q, w, b in zip(m.labels, m.squares, m.weights, m.intercepts, strict=True):
        rows += [(y, "xx", float(q[0, 0])), (y, "yy", float(q[1, 1])), (y, "x", float(w[0])), (y, "y", float(w[1])), (y, "intercept", b)]
    return _tidy(spark, rows, "band int, term string, value double", 5)


@query("qda_predict", _predicted_sql(_QDA_SQL, _SQUARE))
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, QDA.fit(df, "band", ["x", "y"]).predict_column())


# the same on columns of very unlike units, with a category, and shrunk
_UNLIKE = "(SELECT (l_orderkey + l_linenumber) % 2 AS band, 0.001 * ((l_orderkey + l_linenumber) % 2) + 0.002 * ((l_orderkey * 31 + l_linenumber * 17) % 1009) / 1009 AS x, 1000 * l_extendedprice AS y FROM lineitem)"
_STATUS = _BANDS.replace("100 * l_discount AS y", "(l_linestatus = 'O')::INT AS y")
_SHRUNK = f"(SELECT band, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM {_BANDS})"


def _unlike(spark, sf) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    band = (key + line) % 2
    return _t(spark, sf, "lineitem").select(band.cast("int").alias("band"), (0.001 * band + 0.002 * ((key * 31 + line * 17) % 1009) / 1009).alias("x"), (1000 * F.col("l_extendedprice")).alias("y"))


def _class_weights(spark, m: LDA) -> DataFrame:
    return _tidy(spark, [(int(y), n, float(w)) for y, ws in zip(m.labels, m.weights, strict=True) for n, w in zip(m.names, ws, strict=True)], "band int, term string, value double", 5)


@query("lda_unscaled", f"{_lda_sql(_UNLIKE)} SELECT band::INT AS band, 'x' AS term, {_sql_sig('wx', 5)} AS value FROM f UNION ALL SELECT band::INT, 'y', {_sql_sig('wy', 5)} FROM f")
def _(spark, sf):
    return _class_weights(spark, LDA.fit(_unlike(spark, sf), "band", ["x", "y"]))


@query("lda_unscaled_predict", _predicted_sql(_lda_sql(_UNLIKE), _LINEAR).replace("SELECT band, predicted", "SELECT band::INT AS band, predicted::INT AS predicted"))
def _(spark, sf):
    df = _unlike(spark, sf)
    return _confusion(df, LDA.fit(df, "band", ["x", "y"]).predict_column())


@query("qda_unscaled_predict", _predicted_sql(_qda_sql(_UNLIKE), _SQUARE).replace("SELECT band, predicted", "SELECT band::INT AS band, predicted::INT AS predicted"))
def _(spark, sf):
    df = _unlike(spark, sf)
    return _confusion(df, QDA.fit(df, "band", ["x", "y"]).predict_column())


@query("lda_categorical_predict", _predicted_sql(_lda_sql(_STATUS), _LINEAR))
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, LDA.fit(df, "band", ["x"], ["l_linestatus"]).predict_column())


@query("qda_categorical_predict", _predicted_sql(_qda_sql(_STATUS), _SQUARE))
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, QDA.fit(df, "band", ["x"], ["l_linestatus"]).predict_column())


@query("lda_shrunk_predict", _predicted_sql(_lda_sql(_SHRUNK, 0.2), _LINEAR))
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, LDA.fit(df, "band", ["x", "y"], shrinkage=0.2, norm=True).predict_column())


@query("qda_norm_predict", _predicted_sql(_qda_sql(_SHRUNK), _SQUARE))
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, QDA.fit(df, "band", ["x", "y"], norm=True).predict_column())


@query("nb_train", f"{_CLASSES}, c AS (SELECT band, l_linestatus, count(*) AS c FROM t GROUP BY ALL) SELECT band, 'prior' AS term, NULL::VARCHAR AS k, {_sql_sig('k.n / a.n', 6)} AS value FROM k, a UNION ALL SELECT band, 'mean x', NULL, {_sql_sig('mx', 6)} FROM k UNION ALL SELECT band, 'var x', NULL, {_sql_sig('vx', 6)} FROM k UNION ALL SELECT band, 'mean y', NULL, {_sql_sig('my', 6)} FROM k UNION ALL SELECT band, 'var y', NULL, {_sql_sig('vy', 6)} FROM k UNION ALL SELECT c.band, 'prob', l_linestatus, {_sql_sig('c.c / k.n', 6)} FROM c JOIN k ON c.band = k.band")
def _(spark, sf):
    m = NaiveBayes.fit(_banded(spark, sf), "band", ["x", "y"], ["l_linestatus"])
    rows = []
    for k, y in enumerate(m.labels):
        rows.append((y, "prior", None, float(m.priors[k])))
        for i, c in enumerate(m.cont):
            rows += [(y, f"mean {c}", None, float(m.mean[k][i])), (y, f"var {c}", None, float(m.var[k][i]))]
        rows += [(y, "prob", str(v), float(p)) for v, p in m.prob[k]["l_linestatus"].items() if p > 0]
    return _tidy(spark, rows, "band int, term string, k string, value double", 6)


@query("nb_predict", f"{_CLASSES}, c AS (SELECT band, l_linestatus, count(*) AS c FROM t GROUP BY ALL), s AS (SELECT t.band, k.band AS predicted, row_number() OVER (PARTITION BY id ORDER BY ln(k.n / a.n) - (x - mx) * (x - mx) / (2 * (vx + 1e-9)) - ln(2 * pi() * (vx + 1e-9)) / 2 - (y - my) * (y - my) / (2 * (vy + 1e-9)) - ln(2 * pi() * (vy + 1e-9)) / 2 + coalesce(ln(c.c / k.n), '-infinity'::DOUBLE) DESC, k.band) AS r FROM (SELECT *, row_number() OVER () AS id FROM t) t CROSS JOIN k CROSS JOIN a LEFT JOIN c ON c.band = k.band AND c.l_linestatus = t.l_linestatus) SELECT band, predicted, count(*) AS n FROM s WHERE r = 1 GROUP BY ALL")
def _(spark, sf):
    df = _banded(spark, sf)
    return _confusion(df, NaiveBayes.fit(df, "band", ["x", "y"], ["l_linestatus"]).predict_column())


# features far from 0: classes are those of the same features near it
_NEAR = "(SELECT *, CASE WHEN l_extendedprice < 15000 THEN 0 WHEN l_extendedprice < 40000 THEN 1 ELSE 2 END AS band, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem)"


def _far(spark, sf) -> DataFrame:
    return _banded(spark, sf).withColumns({"x": F.col("l_quantity") + F.lit(1.7e12), "y": F.col("l_linenumber") + F.lit(1e9)})


@query("lda_offset", _predicted_sql(_lda_sql(_NEAR), _LINEAR))
def _(spark, sf):
    df = _far(spark, sf)
    return _confusion(df, LDA.fit(df, "band", ["x", "y"]).predict_column())


@query("qda_offset", _predicted_sql(_qda_sql(_NEAR), _SQUARE))
def _(spark, sf):
    df = _far(spark, sf)
    return _confusion(df, QDA.fit(df, "band", ["x", "y"]).predict_column())


@query("nb_offset", f"{_classes(_NEAR)}, s AS (SELECT t.band, k.band AS predicted, row_number() OVER (PARTITION BY id ORDER BY ln(k.n / a.n) - (x - mx) * (x - mx) / (2 * (vx + 1e-9)) - ln(2 * pi() * (vx + 1e-9)) / 2 - (y - my) * (y - my) / (2 * (vy + 1e-9)) - ln(2 * pi() * (vy + 1e-9)) / 2 DESC, k.band) AS r FROM (SELECT *, row_number() OVER () AS id FROM t) t, k, a) SELECT band, predicted, count(*) AS n FROM s WHERE r = 1 GROUP BY ALL")
def _(spark, sf):
    df = _far(spark, sf)
    return _confusion(df, NaiveBayes.fit(df, "band", ["x", "y"]).predict_column())


# imputation: two columns with deterministic gaps
_GAPS = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS x, CASE WHEN (l_orderkey * 31 + l_linenumber) % 5 = 0 THEN NULL ELSE l_extendedprice END AS p, CASE WHEN (l_orderkey * 17 + l_linenumber) % 7 = 0 THEN NULL ELSE 100 * l_tax END AS t, CASE WHEN (l_orderkey * 13 + l_linenumber) % 6 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem)"


def _gaps(spark, sf) -> DataFrame:
    gap = lambda a, m, c: F.when((F.col("l_orderkey") * a + F.col("l_linenumber")) % m != 0, c)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("x"), gap(31, 5, F.col("l_extendedprice")).alias("p"), gap(17, 7, 100 * F.col("l_tax")).alias("t"), gap(13, 6, F.col("l_returnflag")).alias("f"))


@query("impute_initial_fill", f"SELECT 'p' AS c, {_sql_sig('avg(p)', 6)} AS value FROM {_GAPS} UNION ALL SELECT 't', {_sql_sig('avg(t)', 6)} FROM {_GAPS} UNION ALL SELECT 'f', (SELECT f FROM {_GAPS} WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)")
def _(spark, sf):
    v = imputation.initial_values(_gaps(spark, sf), ["p", "t"], ["f"])
    numbers = _tidy(spark, [("p", v["p"]), ("t", v["t"])], "c string, value double", 6)
    return numbers.unionByName(spark.createDataFrame([("f", v["f"])], "c string, value string"))


@query("null_partitioning", f"SELECT (p IS NULL)::INT + 2 * (t IS NULL)::INT + 4 * (f IS NULL)::INT AS null_mask, ((p IS NULL)::INT + (t IS NULL)::INT + (f IS NULL)::INT) AS null_cnt, CASE WHEN p IS NULL AND t IS NOT NULL AND f IS NOT NULL THEN 1 WHEN p IS NOT NULL AND t IS NULL AND f IS NOT NULL THEN 2 WHEN p IS NOT NULL AND t IS NOT NULL AND f IS NULL THEN 3 END AS null_col_id, count(*) AS n FROM {_GAPS} GROUP BY ALL")
def _(spark, sf):
    return imputation.partitioned(_gaps(spark, sf), ["p", "t", "f"]).groupBy("null_mask", "null_cnt", "null_col_id").agg(F.count("*").alias("n")).withColumn("null_mask", F.col("null_mask").cast("int"))


def _imputed_sql(gaps: str) -> str:
    """One round over p and t, in closed form."""
    return f"WITH g AS (SELECT *, p IS NULL AS np, t IS NULL AS nt FROM {gaps}), v AS (SELECT avg(p) AS ap, avg(t) AS t_mean FROM g), s0 AS (SELECT np, nt, x, coalesce(p, ap) AS p, coalesce(t, t_mean) AS t FROM g, v), m1 AS ({_ols('p', 'x', 't', 's0 WHERE NOT np')}), s1 AS (SELECT np, nt, x, t, CASE WHEN np THEN b0 + wa * x + wb * t ELSE p END AS p FROM s0, m1), m2 AS ({_ols('t', 'x', 'p', 's1 WHERE NOT nt')}), s2 AS (SELECT np, nt, p, CASE WHEN nt THEN b0 + wa * x + wb * p ELSE t END AS t FROM s1, m2) SELECT np::INT + 2 * nt::INT AS mask, count(*) AS n, {_sql_sig('avg(p)', 5)} AS p, {_sql_sig('max(p)', 5)} AS p_high, {_sql_sig('avg(t)', 5)} AS t, {_sql_sig('min(t)', 5)} AS t_low FROM s2 GROUP BY ALL"


def _impute(strategy: str, unlike: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        gaps = _gaps(spark, sf)
        if unlike:
            gaps = gaps.withColumns({"p": 1000 * F.col("p"), "t": F.col("t") / 100_000})
        found = imputation.impute(gaps, ["x", "p", "t"], (), ["p", "t"], (), iterations=1, strategy=strategy).frame
        return found.groupBy(F.col(imputation.MASK).cast("int").alias("mask")).agg(F.count("*").alias("n"), _sig(F.avg("p"), 5).alias("p"), _sig(F.max("p"), 5).alias("p_high"), _sig(F.avg("t"), 5).alias("t"), _sig(F.min("t"), 5).alias("t_low"))

    return run


for _strategy in imputation.STRATEGIES:
    query(f"impute_{_strategy}", _imputed_sql(_GAPS))(_impute(_strategy))
query("impute_unscaled", _imputed_sql(_GAPS.replace("100 * l_tax", "0.001 * l_tax").replace("ELSE l_extendedprice", "ELSE 1000 * l_extendedprice")))(_impute("low", True))


def _mixed_sql(rounds: int) -> str:
    """Rounds of a discriminant for f and a regression with a base a category for p."""
    out = [f"g AS (SELECT x, p, f, p IS NULL AS np, f IS NULL AS nf, row_number() OVER () AS id FROM {_GAPS})", "s0 AS (SELECT id, np, nf, x, coalesce(p, (SELECT avg(p) FROM g)) AS p, coalesce(f, (SELECT f FROM g WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)) AS f FROM g)"]
    for r in range(1, rounds + 1):
        last = f"s{r - 1}"
        out += [
            f"k{r} AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(p) AS mp, var_pop(x) AS vx, var_pop(p) AS vp, covar_pop(x, p) AS vxp FROM {last} WHERE NOT nf GROUP BY f)",
            f"w{r} AS (SELECT sum(n) AS n, sum(n * vx) / sum(n) AS xx, sum(n * vp) / sum(n) AS pp, sum(n * vxp) / sum(n) AS xp FROM k{r})",
            f"m{r} AS (SELECT f, (pp * mx - xp * mp) / d AS wx, (xx * mp - xp * mx) / d AS wp, ln(k.n / w.n) - ((pp * mx - xp * mp) * mx + (xx * mp - xp * mx) * mp) / d / 2 AS b FROM k{r} k, (SELECT *, xx * pp - xp * xp AS d FROM w{r}) w)",
            f"h{r} AS (SELECT t.id, m.f, row_number() OVER (PARTITION BY t.id ORDER BY wx * x + wp * p + b DESC, m.f) AS o FROM {last} t, m{r} m WHERE t.nf)",
            f"f{r} AS (SELECT t.id, np, nf, x, p, coalesce(h.f, t.f) AS f FROM {last} t LEFT JOIN (SELECT * FROM h{r} WHERE o = 1) h ON t.id = h.id)",
            f"b{r} AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(p) AS mp, var_pop(x) AS vx, covar_pop(x, p) AS vxp FROM f{r} WHERE NOT np GROUP BY f)",
            f"s{r} AS (SELECT id, np, nf, x, t.f, CASE WHEN np THEN mp + slope * (x - mx) ELSE p END AS p FROM f{r} t JOIN b{r} b ON t.f = b.f, (SELECT sum(n * vxp) / sum(n * vx) AS slope FROM b{r}))",
        ]
    return f"WITH {', '.join(out)} SELECT nf::INT + 2 * np::INT AS mask, f, count(*) AS n, {_sql_sig('avg(p)', 5)} AS p FROM s{rounds} GROUP BY ALL"


@query("impute_mixed", _mixed_sql(2))
def _(spark, sf):
    """A nullable category and a nullable number, two rounds."""
    found = imputation.impute(_gaps(spark, sf).drop("t"), ["x", "p"], ["f"], ["p"], ["f"], iterations=2, strategy="low").frame
    return found.groupBy(F.col(imputation.MASK).cast("int").alias("mask"), "f").agg(F.count("*").alias("n"), _sig(F.avg("p"), 5).alias("p"))


@query("impute_layout", f"SELECT (p IS NOT NULL) AS p_ISNOTNULL, (t IS NOT NULL) AS t_ISNOTNULL, ((p IS NOT NULL)::INT + (t IS NOT NULL)::INT) AS not_null_cnt, CASE WHEN p IS NULL AND t IS NULL THEN 0 WHEN t IS NULL THEN 1 WHEN p IS NULL THEN 2 END AS not_null_col_id, count(*) AS n, count(*) AS row_ids FROM {_GAPS} GROUP BY ALL")
def _(spark, sf):
    rows = imputation.layout(_gaps(spark, sf), ["p", "t"], "high")
    return rows.groupBy("p_ISNOTNULL", "t_ISNOTNULL", "not_null_cnt", "not_null_col_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("row_ids"))


_LAID_OUT = "SELECT (p IS NULL) AS p_ISNULL, (t IS NULL) AS t_ISNULL, {more}count(*) AS n, count(*) AS row_ids FROM " + _GAPS + " GROUP BY ALL"


@query("impute_layout_low", _LAID_OUT.format(more="((p IS NULL)::INT + (t IS NULL)::INT) AS null_cnt, CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN 0 WHEN t IS NOT NULL THEN 1 WHEN p IS NOT NULL THEN 2 END AS null_col_id, "))
def _(spark, sf):
    rows = imputation.layout(_gaps(spark, sf), ["p", "t"], "low")
    return rows.groupBy("p_ISNULL", "t_ISNULL", "null_cnt", "null_col_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("row_ids"))


@query("impute_layout_baseline", _LAID_OUT.format(more=""))
def _(spark, sf):
    rows = imputation.layout(_gaps(spark, sf), ["p", "t"], "baseline")
    return rows.groupBy("p_ISNULL", "t_ISNULL").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("row_ids"))


@query("impute_trace", "SELECT iteration, c, phase, true AS timed, (SELECT count(*) FROM lineitem) AS n FROM (VALUES (0, NULL, 'fill'), (1, 'f', 'train'), (1, 'f', 'impute'), (1, 'p', 'train'), (1, 'p', 'impute')) v(iteration, c, phase)")
def _(spark, sf):
    """Steps of a run as it tells them."""
    found = imputation.impute(_gaps(spark, sf).drop("t"), ["x", "p"], ["f"], ["p"], ["f"], iterations=1, strategy="high")
    rows = [(t["iteration"], t["column"], t["phase"], t["ms"] > 0) for t in found.trace]
    return spark.createDataFrame(rows, "iteration int, c string, phase string, timed boolean").withColumn("n", F.lit(found.frame.count()))


@query("impute_table", f"{_imputed_sql(_GAPS).split(' SELECT np::INT + 2 * nt::INT AS mask')[0]} SELECT NOT np AS p_ISNOTNULL, NOT nt AS t_ISNOTNULL, 2 - np::INT - nt::INT AS not_null_cnt, CASE WHEN np AND nt THEN 0 WHEN nt THEN 1 WHEN np THEN 2 END AS not_null_col_id, count(*) AS n, count(*) AS row_ids, {_sql_sig('avg(p)', 5)} AS p FROM s2 GROUP BY ALL")
def _(spark, sf):
    """From a named table to a written one, in the strategy's layout."""
    _gaps(spark, sf).createOrReplaceTempView("selected_gaps")
    path = tables.step(spark)
    imputation.impute_table(spark, "selected_gaps", path, ["x", "p", "t"], (), ["p", "t"], strategy="high", iterations=1)
    rows = tables.read(spark, path)
    return rows.groupBy("p_ISNOTNULL", "t_ISNOTNULL", "not_null_cnt", "not_null_col_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("row_ids"), _sig(F.avg("p"), 5).alias("p"))


# sources and sinks
@query("source_query_text", "SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def _(spark, sf):
    """A table whose name begins like a query, and a query that begins with a comment."""
    _t(spark, sf, "customer").createOrReplaceTempView("selected_customers")
    _t(spark, sf, "nation").createOrReplaceTempView("with_nations")
    both = tables.read(spark, "selected_customers").join(tables.read(spark, "-- all of them\n(SELECT * FROM with_nations)"), F.col("n_nationkey") == F.col("c_nationkey"))
    return both.groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("source_pandas", "SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_regionkey::DOUBLE END AS x FROM nation")
def _(spark, sf):
    """A pandas frame with NaN, which is null here."""
    frame = _t(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("double")).alias("x")).toPandas()
    return tables.from_pandas(spark, frame)


@query("source_written", f"SELECT c_mktsegment, count(*) AS n, {_sql_sig('sum(CAST(c_acctbal AS DECIMAL(12,2)))')} AS total FROM customer GROUP BY ALL")
def _(spark, sf):
    """A table written in folders by a column, and read again."""
    path = tables.step(spark)
    tables.write(_t(spark, sf, "customer"), path, ["c_mktsegment"])
    return tables.read(spark, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), _sig(F.sum(F.col("c_acctbal").cast("decimal(12,2)"))).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
