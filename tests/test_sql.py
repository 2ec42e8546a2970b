"""Training and prediction in one SQL statement, against the models of Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.functions import sql
from tallyring.operators.models import LDA, QDA, LinearRegression, NaiveBayes


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    r = np.random.default_rng(5)
    c, d = r.integers(0, 3, 400), r.integers(4, 7, 400)
    x, z = r.normal(c, 1), r.normal(1e7, 2, 400)
    df = spark.createDataFrame([(float(a), float(b), float(2 * a + (b - 1e7) + k), int(k), int(m)) for a, b, k, m in zip(x, z, c, d, strict=True)], "x double, z double, y double, c int, d int").repartition(5)
    df.createOrReplaceTempView("sql_rows")
    return df


def sums(cont, cat, by=""):
    return f"TABLE(SELECT * FROM ring_sums(TABLE(SELECT * FROM sql_rows), '{cont}', '{cat}', '{by}')) WITH SINGLE PARTITION"


CASES = [
    ("linregr_train", sums("y,x,z", "d"), "'y', 0D, {norm}, true", "linregr_predict(params, array(x, z), array(d), false, {norm})", lambda df, norm: LinearRegression.fit(df, "y", ["x", "z"], ["d"], norm=norm)),
    ("linregr_train", sums("y,x", ""), "'y', 0.5D, {norm}, false", "linregr_predict(params, array(x), array(), false, {norm})", lambda df, norm: LinearRegression.fit(df, "y", ["x"], norm=norm, ridge=0.5)),
    ("lda_train", sums("x,y", "d,c"), "'c', 0.1D, {norm}", "lda_predict(params, array(x, y), array(d), {norm})", lambda df, norm: LDA.fit(df, "c", ["x", "y"], ["d"], norm=norm, shrinkage=0.1)),
    ("qda_train", sums("x,y", "d", "c"), "{norm}", "qda_predict(params, array(x, y), array(d), {norm})", lambda df, norm: QDA.fit(df, "c", ["x", "y"], ["d"], norm=norm)),
    ("nb_train", sums("x,y", "d", "c"), "", "nb_predict(params, array(x, y), array(d))", lambda df, norm: NaiveBayes.fit(df, "c", ["x", "y"], ["d"])),
]


@pytest.mark.parametrize("norm", [False, True])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_one_statement(spark, rows, case, norm):
    """Fitted and applied in one statement; what predicts has no Python in it."""
    train, source, options, call, fit = CASES[case]
    said = str(norm).lower()
    options = options.format(norm=said)
    model = f"SELECT params FROM {train}({source}{', ' + options if options else ''})"
    got = spark.sql(f"WITH m AS ({model}) SELECT x, y, d, {call.format(norm=said)} AS p FROM sql_rows, m").collect()
    want = {(r["x"], r["y"], r["d"]): r["p"] for r in rows.select("x", "y", "d", fit(rows, norm).predict_column().alias("p")).collect()}
    assert len(got) == 400 and np.allclose([r["p"] for r in got], [want[r["x"], r["y"], r["d"]] for r in got], atol=1e-6)
    params = ",".join(f"{p!r}D" for p in spark.sql(model).first()[0])
    plan = spark.sql(f"SELECT {call.format(norm=said).replace('params', f'array({params})')} AS p FROM sql_rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nulls_unseen_and_no_rows(spark, rows):
    params = "array(" + ",".join(f"{p!r}D" for p in NaiveBayes.fit(rows, "c", ["x"], ["d"]).to_params()) + ")"
    assert spark.sql(f"SELECT nb_predict({params}, array(1D), array(99))").first()[0] == 0
    assert spark.sql(f"SELECT nb_predict({params}, array(CAST(NULL AS DOUBLE)), array(4))").first()[0] is None
    linear = "array(" + ",".join(f"{p!r}D" for p in LinearRegression.fit(rows, "y", ["x"], ["d"]).to_params()) + ")"
    seen, unseen, none = spark.sql(f"SELECT linregr_predict({linear}, array(1D), array(4), false, false), linregr_predict({linear}, array(1D), array(99), false, false), linregr_predict({linear}, array(1D), array(NULL), false, false)").first()
    assert np.isfinite(seen) and np.isfinite(unseen) and none is None
    rows.limit(0).createOrReplaceTempView("sql_none")
    empty = sums("y,x", "").replace("sql_rows", "sql_none")
    assert spark.sql(f"SELECT * FROM linregr_train({empty}, 'y', 0D, false, false)").count() == 0
    rows.withColumn("x", F.when(F.col("d") > 4, F.col("x"))).createOrReplaceTempView("sql_gaps")
    with pytest.raises(Exception, match="null"):
        spark.sql(f"SELECT * FROM linregr_train({sums('y,x', '').replace('sql_rows', 'sql_gaps')}, 'y', 0D, false, false)").collect()
