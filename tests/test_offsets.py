"""Sums about shifts, and rows that are no terms of a sum: nulls, NaN, infinity."""

import itertools
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.operators import impute as imputation
from tallyring.operators.models import LDA, QDA, LinearRegression, NaiveBayes
from tallyring.operators.ring import Cofactor, NBAggregates
from tallyring.plans import aggregate, factorized
from tallyring.plans.aggregate import Spec
from tests.test_ring import same, total


@pytest.fixture(scope="module")
def near(spark):
    r = np.random.default_rng(4)
    k = r.integers(0, 2, 2000)
    x, z = r.integers(0, 3600, 2000), r.normal(2 * k, 1)
    return spark.createDataFrame([(float(a), float(b), float(3 * a + n), int(c)) for a, b, n, c in zip(x, z, r.normal(0, 1, 2000), k, strict=True)], "x double, z double, y double, k int").cache()


@pytest.mark.parametrize("offset", [0.0, 1e9, 1.7e12])
@pytest.mark.parametrize("decimal", [None, (30, 6)])
def test_slope(near, offset, decimal):
    far = near.withColumns({"x": F.col("x") + offset, "y": F.col("y") + 3 * offset})
    for options in ({}, {"norm": True}, {"solver": "gd", "norm": True}):
        m = LinearRegression.fit(far, "y", ["x"], variance=True, decimal=decimal, **options)
        # y itself is rounded at 5e12
        assert m.weights[0] == pytest.approx(3, abs=1e-4) and m.sigma == pytest.approx(1, abs=0.05)
    off = far.select(F.max(F.abs(m.predict_column() - F.col("y")))).first()[0]
    assert off < 6
    params = LinearRegression.from_params(LinearRegression.fit(far, "y", ["x"]).to_params(), ["x"])
    assert far.select(F.max(F.abs(params.predict_column() - F.col("y")))).first()[0] < 7


def test_small_residuals(spark):
    """The residual deviation to nine digits, where it is a difference of sums a million times larger."""
    n = 150_000
    x, e = [i * 7919 % 3600 for i in range(n)], [i * i * 31 % 101 for i in range(n)]
    y = [12 * a + b for a, b in zip(x, e, strict=True)]
    s = lambda u, v: n * sum(a * b for a, b in zip(u, v, strict=True)) - sum(u) * sum(v)
    exact = float(Fraction(s(y, y) * s(x, x) - s(x, y) ** 2, 16 * n * n * s(x, x))) ** 0.5
    rows = spark.range(0, n, 1, 1).withColumn("x", F.col("id") * 7919 % 3600 + F.lit(1_700_000_000_000))
    rows = rows.select(F.col("x").cast("double"), (3.0 * F.col("x") + F.col("id") * F.col("id") * 31 % 101 / 4.0).alias("y"))
    assert LinearRegression.fit(rows, "y", ["x"], variance=True).sigma == pytest.approx(exact, rel=1e-9)


@pytest.mark.parametrize("kind", [LDA, QDA, NaiveBayes])
def test_classes(near, kind):
    at0 = [r[0] for r in near.select(kind.fit(near, "k", ["z", "x"]).predict_column()).collect()]
    for offset in (1e6, 1e9):
        far = near.withColumns({"z": F.col("z") + offset, "x": F.col("x") - offset})
        for options in ({},) if kind is NaiveBayes else ({}, {"norm": True}):
            got = [r[0] for r in far.select(kind.fit(far, "k", ["z", "x"], **options).predict_column()).collect()]
            assert np.mean(np.array(got) == at0) > 0.995
    if kind is not NaiveBayes:
        far = near.withColumn("z", F.col("z") + 1e5)
        m = kind.fit(far, "k", ["z", "x"])
        again = kind.from_params(m.to_params(), ["z", "x"])
        assert np.mean(np.array([r[0] for r in far.select(again.predict_column()).collect()]) == at0) > 0.99


def test_one_pass_where_near(spark, near):
    """Sums are taken again only where the first ones have lost what varies."""
    spark.sparkContext.setJobGroup("near", "", False)
    assert not aggregate.cofactor(near, Spec(("x", "z"))).shift.any()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    spark.sparkContext.setJobGroup("far", "", False)
    assert aggregate.cofactor(near.withColumn("x", F.col("x") + 1e9), Spec(("x", "z"))).shift.all()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("far")) > jobs
    spark.sparkContext.setJobGroup("", "", False)


def test_wide_and_grouped(near):
    wide = near.select(*[(F.col("x") * i + 1e10 * i).alias(f"w{i}") for i in range(1, 15)], "k")
    a = aggregate.cofactor(wide, Spec(tuple(f"w{i}" for i in range(1, 15))))
    spread = np.var([r[0] for r in near.select("x").collect()])
    assert np.diag(a.quad)[0] / a.count - (a.lin[0] / a.count) ** 2 == pytest.approx(spread, rel=1e-6)
    apart = near.withColumn("z", F.col("z") + F.col("k") * 1e10)
    by = aggregate.cofactors(apart, Spec(("z",)), ["k"])
    assert by[(1,)].quad[0, 0] / by[(1,)].count - (by[(1,)].lin[0] / by[(1,)].count) ** 2 == pytest.approx(1, abs=0.1)


def test_shifts_move_exactly():
    rows = [(3.0, 1), (5.0, 2), (9.0, 1)]
    plain = total([Cofactor.lift({"x": v}, {"c": c}) for v, c in rows])
    moved = plain.about([4.0])
    assert same(moved.about(), plain) and moved.lin.tolist() == [5.0] and moved.quad.tolist() == [[27.0]] and moved.by_cat["c"][1].tolist() == [2.0, 4.0]
    assert same(moved + plain, plain + plain) and same(plain - moved + moved, plain) and moved.to_text() == plain.to_text()
    other = total([Cofactor.lift({"y": v}) for v, _ in rows]).about([1.0])
    assert same(moved * other, plain * other.about())
    nb = NBAggregates.lift({"x": 3.0}) + NBAggregates.lift({"x": 5.0})
    assert nb.about([4.0]).square.tolist() == [2.0] and (nb.about([4.0]) + nb).about().square.tolist() == [68.0]


def test_factorised_far_and_nulls(spark, near):
    left = near.withColumn("key", F.col("k")).withColumn("x", F.col("x") + 1e9).select("key", "x")
    right = spark.createDataFrame([(0, 1.0), (0, 2.5), (1, 4.0)], "key int, u double")
    joined = aggregate.cofactor(left.join(right, "key"), Spec(("x", "u")))
    for how in ("auto", "summed", "joined"):
        tree = factorized.cofactor(factorized.Table(left, ("x",)).join("key", factorized.Table(right, ("u",))), how)
        assert tree.shift.any() and same(tree.about(joined.shift), joined)
    rows = spark.createDataFrame([(1, 1.0, "a"), (1, None, "b"), (2, 3.0, None), (None, None, "c")], "key int, v double, g string")
    other = spark.createDataFrame([(1, 2.0), (2, 3.0)], "key int, w double")
    for (cont, cat), how in itertools.product(((("v",), ()), ((), ("g",))), ("auto", "summed", "joined")):
        with pytest.raises(Exception, match="a feature is null"):
            factorized.cofactor(factorized.Table(rows, cont, cat).join("key", factorized.Table(other, ("w",))), how)
        skipped = factorized.cofactor(factorized.Table(rows, cont, cat, "skip").join("key", factorized.Table(other, ("w",))), how)
        want = aggregate.cofactor(rows.join(other, "key"), Spec((*cont, "w"), cat, on_null="skip"))
        assert same(skipped, want) and skipped.count == 2


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_numbers_that_are_none(spark, near, bad):
    broken = near.withColumn("x", F.when(F.col("x") == 7, F.lit(bad)).otherwise(F.col("x")))
    for spec in (Spec(("x", "z")), Spec(tuple("xzy") + ("k",), ("k",))):
        with pytest.raises(Exception, match="NaN or infinite"):
            aggregate.cofactor(broken, spec)
    assert aggregate.cofactor(broken, Spec(("x",), on_null="skip")).count == near.where("x <> 7").count()
    with pytest.raises(Exception, match="NaN or infinite"):
        factorized.cofactor(factorized.Table(broken, ("x",)))


def test_null_labels_and_features(spark, near):
    half = near.withColumn("k", F.when(F.col("x") > 100, F.col("k")))
    for kind in (LDA, QDA, NaiveBayes):
        with pytest.raises(Exception, match="null"):
            kind.fit(half, "k", ["z"])
        m = kind.fit(half, "k", ["z"], on_null="skip")
        assert None not in m.labels
        assert near.limit(1).withColumn("z", F.lit(None).cast("double")).select(m.predict_column()).first()[0] is None
    by_cat = LinearRegression.fit(near, "y", ["x"], ["k"])
    assert near.limit(1).withColumn("k", F.lit(None).cast("int")).select(by_cat.predict_column()).first()[0] is None


def test_imputation_far_from_0(spark, near):
    gap = lambda off: near.withColumn("id", F.monotonically_increasing_id()).withColumns({"x": F.col("x") + off, "y": F.when(F.hash("id") % 3 != 0, F.col("y") + 3 * off)})
    out = {}
    for off in (0.0, 1e9):
        found = imputation.impute(gap(off), ["x", "y"], (), ["y"], strategy="low", iterations=1).frame
        out[off] = [r[0] - 3 * off for r in found.orderBy("id").select("y").collect()]
    assert np.allclose(out[0.0], out[1e9], atol=1e-3)


def test_queries_and_tables(spark, near):
    from tallyring.sources import tables

    for name in ("selected_rows", "with_rows", "values_of", "tables"):
        near.createOrReplaceTempView(name)
        assert tables.read(spark, name).count() == 2000
        for text in (f"SELECT * FROM {name}", f"-- a comment\nselect * from {name}", f"/* a\n b */ (SELECT * FROM {name})", f"WITH t AS (SELECT * FROM {name}) SELECT * FROM t"):
            assert tables.read(spark, text).count() == 2000
