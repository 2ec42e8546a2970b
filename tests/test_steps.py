"""Imputation in steps: sums by column, not by pattern of gaps, and runs that are taken up again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.operators import impute as imputation
from tallyring.plans import aggregate
from tallyring.sources import tables


def gaps(spark, rows: int, columns: int):
    x = [((F.hash(F.lit(i), "id") % 1000) / 100.0 + F.col("id") % 7).alias(f"x{i}") for i in range(columns)]
    df = spark.range(rows).select("id", (F.col("id") % 13).cast("double").alias("base"), *x)
    return df.withColumns({f"x{i}": F.when(F.hash(F.lit(100 + i), "id") % 5 != 0, F.col(f"x{i}")) for i in range(columns)})


def test_aggregates_by_column(spark, monkeypatch):
    """12 nullable columns with hundreds of patterns: 13 aggregates are collected, or twice that where
    rows change places, and results are those of sums from scratch."""
    names = [f"x{i}" for i in range(12)]
    df = gaps(spark, 4000, 12)
    assert imputation.partitioned(df, names).select("null_mask").distinct().count() > 500
    real, collected = aggregate.cofactors, []
    monkeypatch.setattr(aggregate, "cofactors", lambda *a, **k: collected.append(real(*a, **k)) or collected[-1])
    out = {}
    for strategy in imputation.STRATEGIES:
        collected.clear()
        found = imputation.impute(df, ["base", *names], (), names, strategy=strategy, iterations=1)
        out[strategy] = np.array([list(r) for r in found.frame.orderBy("id").select(*names).collect()])
        assert max(map(len, collected)) <= (1 if strategy == "baseline" else 2 * 13)
        if strategy != "baseline":
            assert len(collected[0]) <= 13
    assert np.allclose(out["low"], out["baseline"], atol=1e-7) and np.allclose(out["high"], out["baseline"], atol=1e-7)


@pytest.mark.parametrize("strategy", imputation.STRATEGIES)
@pytest.mark.parametrize("moment", ["write", "commit"])
def test_resumes(spark, tmp_path, monkeypatch, strategy, moment):
    """A run that dies after a step's files are written, or while it commits them, goes on."""
    df, names = gaps(spark, 600, 3), ["x0", "x1", "x2"]
    args = dict(cont=["base", *names], cont_null=names, strategy=strategy, iterations=2)
    want = imputation.impute(df, **args).frame.orderBy("id").select("id", *names).collect()
    work, steps = f"file://{tmp_path}/run", []
    real = getattr(tables.Parts if moment == "write" else tables.Manifest, moment)

    def dies(self, *a):
        steps.append(1)
        if len(steps) == 4:
            if moment == "write":
                real(self, *a)
            raise RuntimeError("lost")
        return real(self, *a)

    monkeypatch.setattr(tables.Parts if moment == "write" else tables.Manifest, moment, dies)
    with pytest.raises(RuntimeError, match="lost"):
        imputation.impute(df, work=work, **args)
    found = imputation.impute(df, work=work, **args)
    got = found.frame.orderBy("id").select("id", *names).collect()
    assert np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), atol=1e-8)
    assert len(found.trace) == 1 + 2 * 2 * 3 and len(steps) < 4 + 2 * 3
    # a finished run gives its result; another one may not take its folder; nothing stale is left
    again = imputation.impute(df, work=work, **args).frame.orderBy("id").select("id", *names).collect()
    assert again == got
    with pytest.raises(ValueError, match="another run"):
        imputation.impute(df, work=work, **(args | {"iterations": 3}))
    left = [p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")]
    assert sum(n.startswith("manifest-") for n in left) == 1 and not any(n.startswith("draft-") for n in left)
    assert sum(n.startswith("part-") for n in left) <= 4


def test_steps_lie_in_the_applications_folder(spark):
    assert spark.sparkContext.applicationId in tables.step(spark)
