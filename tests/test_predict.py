"""Predictions over many categories and many features."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.operators import models
from tallyring.operators.models import QDA, LinearRegression


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_many_categories(spark, kind):
    keys = [str(k) if kind == "string" else k for k in [*range(-500, 4500), 2**31 - 1]] + (["", "é", "a b"] if kind == "string" else [])
    values = {k: float(i) for i, k in enumerate(keys)}
    rows = spark.createDataFrame([(k,) for k in keys], f"c {kind}")
    got = {r[0]: r[1] for r in rows.select("c", models.lookup("c", values)).collect()}
    assert got == values
    unseen = spark.createDataFrame([("x" if kind == "string" else 99999,), (None,)], f"c {kind}")
    assert [r[0] for r in unseen.select(models.lookup("c", values)).collect()] == [None, None]


def test_look_ups_take_no_longer_with_many(spark):
    """5,000 categories against 50, over the same rows."""
    took = {}
    for n in (50, 5000):
        df = spark.range(400_000).select((F.col("id") % n).alias("c"))
        m = LinearRegression([("c", v) for v in range(n)], np.arange(n, dtype=float), 1.0)
        for _ in range(2):
            start = time.perf_counter()
            total = df.select(F.sum(m.predict_column())).first()[0]
            took[n] = time.perf_counter() - start
        assert total == 400_000 * (1 + (n - 1) / 2)
    assert took[5000] < 2 * took[50] + 1


def test_many_features_of_a_quadratic_form(spark):
    """Beyond DENSE features, matrix products over batches give the same labels."""
    r = np.random.default_rng(6)
    k = r.integers(0, 3, 1500)
    x = r.normal(k[:, None] * 0.4, 1 + 0.3 * k[:, None], (1500, 12))
    names = [f"x{i}" for i in range(12)]
    df = spark.createDataFrame([(*map(float, row), int(c), int(c + i % 2)) for i, (row, c) in enumerate(zip(x, k, strict=True))], ", ".join([*[f"{n} double" for n in names], "k int", "g int"]))
    for options in ({}, {"norm": True}):
        m = QDA.fit(df, "k", names, **options)
        by_batch = [r[0] for r in df.select(m.predict_column()).collect()]
        by_column = [r[0] for r in df.select(models._argmax(m.scores(), m.labels)).collect()]
        assert by_batch == by_column and np.mean(np.array(by_batch) == k) > 0.6
    mixed = QDA.fit(df, "k", names, ["g"])
    assert [r[0] for r in df.select(mixed.predict_column()).collect()] == [r[0] for r in df.select(models._argmax(mixed.scores(), mixed.labels)).collect()]
    assert df.limit(1).withColumn("x3", F.lit(None).cast("double")).select(m.predict_column()).first()[0] is None
    assert df.limit(0).select(m.predict_column()).count() == 0
