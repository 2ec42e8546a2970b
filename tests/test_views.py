"""Sums over a join kept under changes, and regression over many categories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.operators import sparse
from tallyring.operators.models import LinearRegression
from tallyring.plans import aggregate, factorized
from tallyring.plans.aggregate import Spec
from tallyring.streaming.views import Views
from tests.test_ring import same

SPEC = Spec(("l_quantity", "o_totalprice", "c_acctbal"), ("l_returnflag", "o_orderpriority", "c_mktsegment"))


def tree(orders, lines, customers):
    child = factorized.Table(lines, ("l_quantity",), ("l_returnflag",))
    return factorized.Table(orders, ("o_totalprice",), ("o_orderpriority",)).join("o_orderkey", child, "l_orderkey").join("o_custkey", factorized.Table(customers, ("c_acctbal",), ("c_mktsegment",)), "c_custkey")


@pytest.fixture(scope="module")
def tables(spark, sf):
    orders, lines, customers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    return orders.where("o_orderkey < 300"), lines.where("l_orderkey < 300"), customers


def fresh(orders, lines, customers):
    return aggregate.cofactor(orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(customers, orders.o_custkey == customers.c_custkey), SPEC)


def test_inserts_and_deletes_in_every_table(spark, tables, tmp_path):
    orders, lines, customers = tables
    views = Views(spark, tree(*tables), f"file://{tmp_path}/views")
    assert views.root() is None
    for table, rows in enumerate((orders.where("o_orderkey < 250"), lines.where("l_linenumber < 4"), customers.where("c_custkey % 3 > 0"))):
        views.change(table, rows)
    assert same(views.root(), fresh(orders.where("o_orderkey < 250"), lines.where("l_linenumber < 4"), customers.where("c_custkey % 3 > 0")))
    views.change(2, customers.where("c_custkey % 3 = 0"))
    views.change(0, orders.where("o_orderkey >= 250"))
    views.change(1, lines.where("l_linenumber >= 4"))
    assert same(views.root(), fresh(*tables))
    views.change(1, lines.where("l_linenumber = 1"), -1)
    views.change(0, orders.where("o_orderkey < 20"), -1)
    views.change(2, customers.where("c_custkey % 5 = 0"), -1)
    left = orders.where("o_orderkey >= 20"), lines.where("l_linenumber <> 1"), customers.where("c_custkey % 5 <> 0")
    assert same(views.root(), fresh(*left))
    views.compact()
    assert same(views.root(), fresh(*left))
    # a step that is run again replaces what it wrote
    for _ in range(2):
        views.change(1, lines.where("l_linenumber = 1"), 1, step=100)
    assert same(views.root(), fresh(left[0], lines, left[2]))
    # the work is that of the keys touched, not of the tables
    one = lines.where("l_linenumber = 2").orderBy(*lines.columns).limit(1)
    views.change(1, one, -1)
    assert 0 < views.touched() < 60


def test_stored_once_and_dealt_once(spark, tables, tmp_path):
    """Sums of a table with none below are stored once, and stored sums travel once until they are joined."""
    orders, lines, _ = tables
    two = factorized.Table(orders, ("o_totalprice",), ("o_orderpriority",)).join("o_orderkey", factorized.Table(lines, ("l_quantity",), ("l_returnflag",)), "l_orderkey")
    views = Views(spark, two, f"file://{tmp_path}/views")
    views.change(1, lines)
    assert not (tmp_path / "views" / "view-1").exists()
    views.change(0, orders)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = views._product(0, views._read("local", 0, 9), {1: views._read("view", 1, 9)}).rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and same(views.root(), factorized.cofactor(two))


def test_changes_from_a_stream(spark, tables, tmp_path):
    orders, lines, customers = tables
    views = Views(spark, tree(*tables), f"file://{tmp_path}/views")
    views.change(0, orders, step=0)
    views.change(2, customers, step=1)
    changes = lines.withColumn("sign", F.lit(1)).unionByName(lines.where("l_linenumber = 2").withColumn("sign", F.lit(-1)))
    changes.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    views.follow(stream, 1, "sign", str(tmp_path / "checkpoint"), first=2).awaitTermination(180)
    assert views.step >= 5 and same(views.root(), fresh(orders, lines.where("l_linenumber <> 2"), customers))


def test_sparse_fit_equals_dense(spark, sf):
    """Two categorical features with hundreds of categories, and a number far from 0."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").limit(3000).withColumns({"p": F.col("l_partkey") % 60, "s": F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string")), "at": F.col("l_quantity") * 3 + 1e9})
    rows = rows.withColumn("y", F.col("l_extendedprice") + 100 * (F.col("p") % 7))
    for ridge in (0.0, 0.5):
        dense = LinearRegression.fit(rows, "y", ["at", "l_tax"], ["p", "s", "l_returnflag"], ridge=ridge)
        thin = sparse.fit(rows, "y", ["at", "l_tax"], ["p", "s", "l_returnflag"], ridge=ridge)
        a, b = ([r[0] for r in rows.select(m.predict_column()).collect()] for m in (dense, thin))
        assert np.allclose(a, b, rtol=1e-6, atol=1e-3)
        by_name = dict(zip(thin.names, thin.weights, strict=True))
        assert np.allclose([by_name[n] for n in dense.names], dense.weights, rtol=1e-4, atol=1e-3)


def test_sparse_fit_of_many_categories(spark):
    """20,000 categories: no matrix of their square, predictions as of a group's mean."""
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 20_000 * 0.5 + F.hash("id") % 100 / 50.0).alias("y"))
    m = sparse.fit(rows, "y", (), ["k"])
    joined = rows.withColumn("p", m.predict_column()).groupBy("k").agg(F.avg("y").alias("mean"), F.avg("p").alias("p"))
    assert joined.select(F.max(F.abs(F.col("mean") - F.col("p")))).first()[0] < 1e-6
    with pytest.raises(ValueError):
        sparse.fit(rows.limit(0), "y", (), ["k"])
