"""Aggregates, factorised joins, models and imputation on Spark, against numpy and themselves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.functions import lift
from tallyring.operators import impute as imputation
from tallyring.operators.models import LDA, QDA, LinearRegression, NaiveBayes
from tallyring.operators.ring import Cofactor, NBAggregates
from tallyring.plans import aggregate, factorized
from tallyring.plans.aggregate import Spec
from tests.test_ring import same, total


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    n = 300
    c, d = r.integers(0, 3, n), r.integers(0, 4, n)
    x, z = r.normal(c, 1), r.normal(0, 2, n)
    y = 2 * x - z + np.array([0, 1, 5])[c] + r.normal(0, 0.1, n)
    return [(float(a), float(b), float(e), int(i), int(j)) for a, b, e, i, j in zip(x, y, z, c, d, strict=True)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, z double, c int, d int")


def test_sum_is_the_sum_of_lifts(df, rows):
    want = total([Cofactor.lift({"x": r[0], "y": r[1], "z": r[2]}, {"c": r[3], "d": r[4]}) for r in rows])
    assert same(aggregate.cofactor(df, Spec(("x", "y", "z"), ("c", "d"))), want)
    by = aggregate.cofactors(df, Spec(("x", "y", "z"), ("d",)), ["c"])
    assert same(total(list(by.values())), aggregate.cofactor(df, Spec(("x", "y", "z"), ("d",))))


def test_many_features(df):
    names = [f"w{i}" for i in range(15)]
    wide = df.select(*[(F.col("x") * i + F.col("y")).alias(n) for i, n in enumerate(names)], "c", *[(F.col("d") + i).alias(f"k{i}") for i in range(5)])
    a = aggregate.cofactor(wide, Spec(tuple(names), ("c", "k0", "k1", "k2", "k3", "k4")))
    x = np.array([[r[n] for n in names] for r in wide.collect()])
    assert np.allclose(a.quad, x.T @ x) and np.allclose(a.lin, x.sum(axis=0))
    assert sum(v[0] for v in a.by_cat["k4"].values()) == len(x) and len(a.by_pair) == 15


def test_nulls_and_no_rows(spark, df):
    gap = df.withColumn("x", F.when(F.col("d") > 0, F.col("x")))
    with pytest.raises(Exception, match="null"):
        aggregate.cofactor(gap, Spec(("x",), ("c",)))
    assert aggregate.cofactor(gap, Spec(("x",), ("c",), on_null="skip")).count == gap.where("x IS NOT NULL").count()
    assert aggregate.cofactor(df.limit(0), Spec(("x",), ("c",))) is None
    assert aggregate.cofactor(df.limit(0), Spec(tuple("xyz"))) is None


def test_factorised_equals_joined(spark, sf):
    lines, orders, customers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    child = factorized.Table(lines, ("l_quantity",), ("l_returnflag", "l_linestatus"))
    tree = factorized.Table(orders, ("o_totalprice",), ("o_orderpriority",)).join("o_orderkey", child, "l_orderkey").join("o_custkey", factorized.Table(customers, ("c_acctbal",), ("c_mktsegment",)), "c_custkey")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    want = aggregate.cofactor(joined, Spec(("l_quantity", "o_totalprice", "c_acctbal"), ("l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment")))
    for how in ("auto", "summed", "joined"):
        assert same(factorized.cofactor(tree, how), want)
    with pytest.raises(ValueError):
        factorized.cofactor(tree, "other")


def test_the_way_with_fewer_rows(spark):
    """Keys that do not repeat are joined as they are; keys that repeat on both sides are summed first."""
    one = spark.range(2000).select("id", (F.col("id") * 1.5).alias("u"), (F.col("id") % 20).alias("k"))
    other = spark.range(3000).select((F.col("id") % 2000).alias("id"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 20).alias("k"))
    unique = factorized.Table(one, ("u",)).join("id", factorized.Table(other, ("v",)))
    repeated = factorized.Table(one, ("u",)).join("k", factorized.Table(other, ("v",)))
    a, b = factorized.estimate(unique), factorized.estimate(repeated)
    assert a.joined <= a.summed and a.joined == pytest.approx(3000, rel=0.1)
    assert b.summed == 40 and b.joined == pytest.approx(2000 * 3000 / 20)
    for tree in (unique, repeated):
        assert same(factorized.cofactor(tree), factorized.cofactor(tree, "joined"))


def test_columns(spark):
    rows = spark.createDataFrame([(2, 35), (4, 12), (None, 3)], "a int, b int")
    out = rows.select(lift.to_cofactor(["a"], ["b"]).alias("c"), lift.relation_add(lift.to_relation(F.col("a")), lift.to_relation(F.col("b"))).alias("r"), lift.to_nb_aggregates(["a"], ["b"]).alias("n")).collect()
    assert out[0]["c"]["quad"] == [4.0] and out[0]["c"]["contcat"] == [{35: 2.0}] and out[2]["c"] is None and out[2]["r"] is None
    assert out[0]["r"] == {2: 1.0, 35: 1.0} and out[1]["n"]["square"] == [16.0]
    both = rows.dropna().select(lift.cofactor_sub(lift.cofactor_add(lift.to_cofactor(["a"], ["b"]), lift.to_cofactor(["a"], ["b"])), lift.to_cofactor(["a"], ["b"])).alias("c")).collect()
    assert both[1]["c"]["count"] == 1 and both[1]["c"]["cat1"] == [{12: 1.0}]


def test_column_products_equal_driver_products(spark):
    """Products, sums and differences of columns against the driver's ring, features in any roles."""
    table = spark.createDataFrame([(2, 35, 1, 4), (4, 12, 2, 9), (3, 1, 43, 0), (4, 3, 6, 9)], "A int, B int, C int, D int")
    left, right = (["A", "B"], ["C", "D"]), (["C", "D"], ["A", "B"])
    rows = table.select("*", lift.cofactor_mul(lift.to_cofactor(*left), lift.to_cofactor(*right)).alias("p"), lift.nb_mul(lift.to_nb_aggregates(*left), lift.to_nb_aggregates(*right)).alias("nb"), lift.cofactor_mul(lift.const_to_cofactor(3), lift.cont_to_cofactor("A")).alias("c")).collect()
    for r in rows:
        a, b = (Cofactor.lift({c: float(r[c]) for c in cont}, {c: r[c] for c in cat}) for cont, cat in (left, right))
        want = a * b
        assert (r["p"]["count"], r["p"]["lin"] + r["p"]["quad"]) == (want.count, want.scalars())
        got = [*r["p"]["cat1"], *r["p"]["contcat"], *[{tuple(k): v for k, v in m.items()} for m in r["p"]["catcat"]]]
        assert got == want.relations()
        x, y = (NBAggregates.lift({c: float(r[c]) for c in cont}, {c: r[c] for c in cat}) for cont, cat in (left, right))
        assert r["nb"]["lin"] == (x * y).lin.tolist() and r["nb"]["square"] == (x * y).square.tolist() and r["nb"]["cat1"] == (x * y).relations()
        assert r["c"]["count"] == 3 and r["c"]["quad"] == [3.0 * r["A"] ** 2]
    frame = aggregate.cofactor_frame(table, Spec(("A",), ("B", "D"))).first()["cofactor"]
    whole = aggregate.cofactor(table, Spec(("A",), ("B", "D")))
    assert [*frame["cat1"], *frame["contcat"]] == whole.relations()[:4] and {tuple(k): v for k, v in frame["catcat"][0].items()} == whole.by_pair["B", "D"]


def test_reference_shapes_of_regression(spark):
    """The shapes of four columns: saturated or rank deficient, so fitted values count."""
    table = spark.createDataFrame([(2, 35, 1, 4), (4, 12, 2, 9), (3, 1, 43, 0), (4, 3, 6, 9)], "A int, B int, C int, D int")
    y = {c: np.array([r[c] for r in table.collect()], dtype=float) for c in "ABCD"}
    for label, cont, cat, ridge in (("A", "ABCD", "", 0.0), ("A", "ABCD", "", 0.01), ("B", "ABCD", "", 0.0), ("A", "AB", "CD", 0.0), ("A", "A", "BCD", 0.0)):
        m = LinearRegression.fit(table, label, list(cont), list(cat), ridge=ridge)
        got = np.array([r[0] for r in table.select(m.predict_column()).collect()])
        assert np.allclose(got, y[label], atol=0.5 if ridge else 1e-6)
    single = [Cofactor.lift({"A": float(r["A"])}) * Cofactor.lift({}, {"B": r["B"]}) * Cofactor.lift({}, {"C": r["C"]}) * Cofactor.lift({}, {"D": r["D"]}) for r in table.collect()]
    whole = aggregate.cofactor(table, Spec(("A",), ("B", "C", "D")))
    assert same(total(single), whole)
    with pytest.raises(ValueError):
        LinearRegression.fit(table, "B", [], ["B", "C", "D"])


def test_units_do_not_matter(spark):
    """Scaling a feature by 1e-6 or 1e6 scales its weight and nothing else."""
    r = np.random.default_rng(8)
    x, z, k = r.normal(3, 1, 400), r.normal(-2, 1, 400), r.integers(0, 2, 400)
    for a, b in ((1e-6, 1e6), (1e5, 1e-5)):
        data = [(float(u * a), float(v * b), float(1e3 * u + 5 * v), int(c), float(u * a + 4 * a * c)) for u, v, c in zip(x, z, k, strict=True)]
        df = spark.createDataFrame(data, "x double, z double, y double, c int, w double")
        for norm in (False, True):
            m = LinearRegression.fit(df, "y", ["x", "z"], variance=True, norm=norm)
            assert m.weights[0] * a == pytest.approx(1e3, rel=1e-6) and m.weights[1] * b == pytest.approx(5, rel=1e-6) and m.sigma < 1e-3
            for kind in (LDA, QDA):
                got = [p[0] for p in df.select(kind.fit(df, "c", ["w", "z"], norm=norm).predict_column()).collect()]
                assert (np.array(got) == k).mean() > 0.95


def test_plans_of_sums(spark, df):
    """One read and one shuffle a table; an edge of a tree is one join."""
    plan = aggregate.grouped_sums(df, Spec(("x", "y"), ("c", "d")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Join") == 0
    child = factorized.Table(df.select("d", F.col("x").alias("u"), F.col("c").alias("k")), ("u",), ("k",))
    plan = factorized.sums(factorized.Table(df, ("y",), ("c",)).join("d", child, "d")).rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_regression(df, rows):
    x = np.array([[r[0], r[2], *(r[3] == k for k in range(3))] for r in rows], dtype=float)
    y = np.array([r[1] for r in rows])
    design = np.column_stack([np.ones(len(x)), x])
    fitted = design @ np.linalg.pinv(design) @ y
    for options in ({}, {"norm": True}, {"norm": True, "solver": "gd"}):
        m = LinearRegression.fit(df, "y", ["x", "z"], ["c"], variance=True, **options)
        got = np.array([r[0] for r in df.select(m.predict_column()).collect()])
        assert np.allclose(got, fitted, atol=1e-5)
        assert m.sigma == pytest.approx(np.sqrt(np.mean((y - fitted) ** 2)), rel=1e-4)
        again = LinearRegression.from_params(m.to_params(), ["x", "z"], ["c"], norm=bool(options))
        assert np.allclose([r[0] for r in df.select(again.predict_column()).collect()], got)
    unseen = df.limit(1).withColumn("c", F.lit(99)).select(m.predict_column()).first()[0]
    assert np.isfinite(unseen)
    with pytest.raises(ValueError):
        LinearRegression.fit(df, "c", [], ["c", "d"])


def test_noise(spark):
    """Noise has the residual deviation, and a seed gives the same again."""
    rows = spark.range(20_000).select((F.col("id") % 97).cast("double").alias("x"), (3.0 * (F.col("id") % 97) + F.randn(1) * 2).alias("y")).coalesce(1)
    m = LinearRegression.fit(rows, "y", ["x"], variance=True)
    off = [r[0] for r in rows.select(m.predict_column(noise_seed=5) - m.predict_column()).collect()]
    assert np.std(off) == pytest.approx(m.sigma, rel=0.03) and abs(np.mean(off)) < 0.1 and m.sigma == pytest.approx(2, rel=0.03)
    assert off == [r[0] for r in rows.select(m.predict_column(noise_seed=5) - m.predict_column()).collect()]


def test_classifiers(spark, df, rows):
    label = np.array([r[3] for r in rows])
    x = np.array([[r[0], r[1]] for r in rows])
    n, mu = np.bincount(label), np.array([x[label == k].mean(axis=0) for k in range(3)])
    within = sum(np.cov(x[label == k].T, bias=True) * n[k] for k in range(3)) / len(x)
    w = np.linalg.solve(within, mu.T).T
    want = np.argmax(x @ w.T - 0.5 * (mu * w).sum(axis=1) + np.log(n / len(x)), axis=1)
    for norm in (False, True):
        m = LDA.fit(df, "c", ["x", "y"], norm=norm)
        got = np.array([r[0] for r in df.select(m.predict_column()).collect()])
        assert (got == want).mean() > 0.99
        again = LDA.from_params(m.to_params(), ["x", "y"], norm=norm)
        assert [r[0] for r in df.select(again.predict_column()).collect()] == got.tolist()
    scores = []
    for k in range(3):
        s = np.cov(x[label == k].T, bias=True)
        e = x - mu[k]
        scores.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) - 0.5 * np.log(np.linalg.det(s)) + np.log(n[k] / len(x)))
    for norm in (False, True):
        m = QDA.fit(df, "c", ["x", "y"], norm=norm)
        got = [r[0] for r in df.select(m.predict_column()).collect()]
        assert (np.array(got) == np.argmax(scores, axis=0)).mean() > 0.99
        assert [r[0] for r in df.select(QDA.from_params(m.to_params(), ["x", "y"], norm=norm).predict_column()).collect()] == got
    m = NaiveBayes.fit(df, "c", ["x", "y"], ["d"])
    got = [r[0] for r in df.select(m.predict_column()).collect()]
    assert [r[0] for r in df.select(NaiveBayes.from_params(m.to_params(), ["x", "y"], ["d"]).predict_column()).collect()] == got
    assert df.withColumn("d", F.lit(77)).select(m.predict_column()).distinct().collect() == [(0,)]
    with_cat = LDA.fit(df, "c", ["x"], ["d"]), QDA.fit(df, "c", ["x"], ["d"])
    for model in with_cat:
        assert (np.array([r[0] for r in df.select(model.predict_column()).collect()]) == label).mean() > 0.4


def test_sql_functions(spark, df):
    from tallyring.functions import sql

    sql.register(spark)
    cases = [(LinearRegression.fit(df, "y", ["x", "z"], ["c"]), "linregr_predict", ["x", "z"], ["c"], ", false, false"), (LDA.fit(df, "c", ["x", "y"], ["d"]), "lda_predict", ["x", "y"], ["d"], ", false"), (QDA.fit(df, "c", ["x", "y"], ["d"]), "qda_predict", ["x", "y"], ["d"], ", false"), (NaiveBayes.fit(df, "c", ["x", "y"], ["d"]), "nb_predict", ["x", "y"], ["d"], "")]
    for model, name, cont, cat, more in cases:
        params = "array(" + ",".join(f"{p!r}D" for p in model.to_params()) + ")"
        got = df.select(F.expr(f"{name}({params}, array({','.join(cont)}), array({','.join(cat)}){more})"), model.predict_column()).collect()
        assert np.allclose([float(r[0]) for r in got], [float(r[1]) for r in got])
    # flags may differ by row, noise needs a deviation, no rows are fine
    plain, noisy = (sql.train(spark, "linregr", "SELECT * FROM own", "y", ["x", "z"], variance=v) for v in (False, True)) if df.createOrReplaceTempView("own") is None else ()
    call = "linregr_predict({}, array(x, z), array(), d = 0, false)"
    for params, differs in ((plain, False), (noisy, True)):
        rows = df.select("d", F.expr(call.format("array(" + ",".join(f"{p!r}D" for p in params) + ")")).alias("p"), LinearRegression.from_params(params, ["x", "z"]).predict_column().alias("q")).collect()
        assert all(abs(r["p"] - r["q"]) < 1e-9 for r in rows if r["d"]) and any(abs(r["p"] - r["q"]) > 1e-9 for r in rows if not r["d"]) == differs
    assert df.limit(0).select(F.expr(call.format("array(" + ",".join(f"{p!r}D" for p in noisy) + ")"))).count() == 0
    fits = {k: sql.train(spark, k, "own", "c", ["x", "y"], ["d"]) for k in ("lda", "qda", "nb")}
    assert fits["lda"] == LDA.fit(df, "c", ["x", "y"], ["d"]).to_params() and len(fits["nb"]) > len(fits["lda"]) > 5


@pytest.mark.parametrize("nulls", [1, 2, 3])
def test_imputation_strategies_agree(df, nulls):
    gaps = df.withColumn("k", F.monotonically_increasing_id()).withColumn("y", F.when(F.hash("k", "x") % 4 != 0, F.col("y")))
    if nulls > 1:
        gaps = gaps.withColumn("x", F.when(F.hash("k", "z") % 5 != 0, F.col("x")))
    if nulls > 2:
        gaps = gaps.withColumn("c", F.when(F.hash("k", "d") % 6 != 0, F.col("c")))
    args = dict(cont=["x", "y", "z"], cat=["c"], cont_null=["y", "x"][: min(nulls, 2)], cat_null=["c"] if nulls > 2 else [], iterations=2)
    out = {s: sorted(imputation.impute(gaps, strategy=s, **args).frame.select("k", "x", "y", "c").collect()) for s in imputation.STRATEGIES}
    for a, b in itertools.combinations(out.values(), 2):
        assert np.allclose(np.array([tuple(r) for r in a], dtype=float), np.array([tuple(r) for r in b], dtype=float), atol=1e-6)
    assert not any(v is None for r in out["low"] for v in r)
    noisy = imputation.impute(gaps, strategy="high", noise_seed=5, **args)
    assert len(noisy.trace) == 1 + 2 * 2 * len(args["cont_null"] + args["cat_null"])


def test_streaming(spark, df, tmp_path):
    from tallyring.streaming.maintain import maintained

    rows = df.withColumn("at", F.expr("timestamp '2020-01-01 00:00:00' + make_interval(0,0,0,0,0,d,0)")).withColumn("sign", F.lit(1))
    rows.unionByName(rows.where("d = 0").withColumn("sign", F.lit(-1))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = maintained(stream, Spec(("x", "y")), "at", "1 minute", "10 minutes", ["c"], "sign").writeStream.outputMode("complete").format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window_start"].minute, r["c"]): (r["count"], r["q0_1"]) for r in spark.table("kept").collect()}
    want = {(r["d"], r["c"]): (r["n"], r["q"]) for r in df.where("d > 0").groupBy("d", "c").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("q")).collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1]) for k, v in want.items())


def test_sources(spark, tmp_path):
    import pandas as pd

    from tallyring.sources import tables

    df = tables.from_pandas(spark, pd.DataFrame({"a": [1.0, float("nan")], "b": [1, 2]}))
    assert df.where("a IS NULL").count() == 1
    tables.write(df, str(tmp_path / "t"))
    df.createOrReplaceTempView("own")
    assert tables.read(spark, str(tmp_path / "t")).count() == tables.read(spark, "own").count() == tables.read(spark, "SELECT * FROM own").count() == 2
