"""SUM of columns that hold cofactors or naive-Bayes aggregates, against the driver's ring."""

import pytest
from pyspark.sql import functions as F

from tallyring.functions import lift
from tallyring.operators.models import LinearRegression
from tallyring.operators.ring import Cofactor, NBAggregates
from tallyring.plans import aggregate, factorized, values
from tallyring.plans.aggregate import Spec
from tests.test_ring import same, total

ROWS = [(2, 35, 1, 4), (4, 12, 2, 9), (3, 1, 43, 0), (4, 3, -6, 9)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([*ROWS, (None, 1, 1, 77), (None, 1, 1, 4)], "A int, B int, C int, D int")


def test_shapes(table):
    """Sums of lifts, of products of single lifts, with constants; null values count for nothing."""
    want = total([Cofactor.lift({"A": float(a), "B": float(b)}, {"C": c, "D": d}) for a, b, c, d in ROWS])
    whole = values.value_sum(table, lift.to_cofactor(["A", "B"], ["C", "D"])).first()["total"]
    assert same(values.cofactor_of(whole, ["A", "B"], ["C", "D"]), want)
    product = lift.cofactor_mul(lift.cofactor_mul(lift.cat_to_cofactor("C"), lift.cont_to_cofactor("A")), lift.cofactor_mul(lift.cont_to_cofactor("B"), lift.cat_to_cofactor("D")))
    assert same(values.cofactor_of(values.value_sum(table, product).first()["total"], ["A", "B"], ["C", "D"]), want)
    tripled = lift.cofactor_mul(lift.const_to_cofactor(3), lift.cont_to_cofactor("A"))
    assert values.value_sum(table, tripled).first()["total"]["count"] == 12
    assert values.value_sum(table.select(lift.const_to_cofactor(333).alias("c")), "c").first()["total"]["count"] == 6 * 333


def test_groups_and_no_rows(table):
    value = lift.to_cofactor(["A"], ["C"])
    by = {r["D"]: r["total"] for r in values.value_sum(table, value, ["D"]).collect()}
    assert by[77] is None and by[4]["count"] == 1 and by[9]["lin"] == [8.0] and by[9]["cat1"] == [{2: 1.0, -6: 1.0}]
    assert [r["total"] for r in values.value_sum(table.limit(0), value).collect()] == [None]
    assert values.value_sum(table.limit(0), value, ["D"]).count() == 0
    assert values.value_sum(table.where("A IS NULL"), value).first()["total"] is None


def test_differences_keep_shape(table):
    """Counts that cancel stay as zeros, and empty maps keep their place."""
    value = lift.to_cofactor(["A"], ["C"])
    nothing = table.where("A IS NOT NULL").select(lift.cofactor_sub(value, value).alias("v"))
    got = values.value_sum(nothing, "v").first()["total"]
    assert got["count"] == 0 and set(got["cat1"][0].values()) == {0.0}
    empty = table.where("A IS NOT NULL").select(value.withField("cat1", F.array(F.map_filter(value["cat1"][0], lambda _k, _v: F.lit(False)))).alias("v"))
    assert values.value_sum(empty, "v").first()["total"]["cat1"] == [{}]
    mixed = table.select(F.when(F.col("B") > 5, lift.to_cofactor(["A"])).otherwise(lift.to_cofactor(["A", "B"])).alias("v"))
    with pytest.raises(Exception, match="different shapes"):
        values.value_sum(mixed, "v").collect()
    with pytest.raises(ValueError):
        values.value_sum(table, F.struct("A"))


def test_nb_values(table):
    want = total([NBAggregates.lift({"A": float(a)}, {"C": c}) for a, _, c, _ in ROWS])
    got = values.nb_of(values.value_sum(table, lift.to_nb_aggregates(["A"], ["C"])).first()["total"], ["A"], ["C"])
    assert (got.count, got.lin.tolist(), got.square.tolist(), got.by_cat) == (want.count, want.lin.tolist(), want.square.tolist(), want.by_cat)


def test_factorised_by_hand(spark, table):
    """Cofactors by key on both sides, multiplied where they meet, summed: what a join gives."""
    left = table.where("A IS NOT NULL").withColumn("k", F.col("D") % 2)
    right = spark.createDataFrame([(0, 1.5, 8), (0, 2.5, 9), (1, -1.0, 8)], "k int, E double, G int")
    a = aggregate.cofactor_frame(left, Spec(("A",), ("C",)), ["k"]).withColumnRenamed("cofactor", "a")
    b = aggregate.cofactor_frame(right, Spec(("E",), ("G",)), ["k"]).withColumnRenamed("cofactor", "b")
    got = values.cofactor_of(values.value_sum(a.join(b, "k"), lift.cofactor_mul(F.col("a"), F.col("b"))).first()["total"], ["A", "E"], ["C", "G"])
    assert same(got, aggregate.cofactor(left.join(right, "k"), Spec(("A", "E"), ("C", "G"))))
    tree = factorized.Table(left, ("A",), ("C",)).join("k", factorized.Table(right, ("E",), ("G",)))
    assert same(got, factorized.cofactor(tree))
    assert LinearRegression.fit(got, "E").weights.shape == (1 + 4 + 2,)


def test_plan(table):
    """Terms are summed before the shuffle, and nothing runs in Python."""
    plan = values.value_terms(table, lift.to_cofactor(["A"], ["C"]), ["D"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_frame_of_one_category_has_no_grouping_sets(spark):
    """A group's sums by its category are entries already; they are not repeated for every set."""
    rows = spark.createDataFrame([(1, 2.0, 5), (1, 3.0, 5), (1, 4.0, 6), (2, 1.0, 5)], "k long, A double, C long")
    frame = aggregate.cofactor_frame(rows, Spec(("A",), ("C",)), ["k"])
    assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["cofactor"].asDict() for r in frame.collect()}
    assert got[1] == {"count": 3, "lin": [9.0], "quad": [29.0], "cat1": [{5: 2.0, 6: 1.0}], "contcat": [{5: 5.0, 6: 4.0}], "catcat": []}
    assert got[2]["count"] == 1 and got[2]["contcat"] == [{5: 1.0}]
    assert aggregate.cofactor_frame(rows.limit(0), Spec(("A",), ("C",))).count() == 0
