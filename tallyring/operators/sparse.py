"""Least squares over very many categories: the pairs of categories stay a table.

A dense matrix over 10^5 categories would have 10^10 numbers, of which only those of pairs that occur
are not 0. Here the driver keeps vectors alone (a few numbers a category); the counts of pairs are a
written table of (i, j, n). The normal equations are solved by conjugate gradients: each step
multiplies that table with a vector, which is broadcast: a task sums its rows, and one row a task and
feature is shuffled. Features are scaled to deviation 1, so the start at 0 leads to the
solution of least norm, that of the dense solve.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyring.operators.models import TINY, LinearRegression
from tallyring.plans.aggregate import Spec, grouped_sums, grouping_ids, shifts
from tallyring.sources import tables

#: Steps of the solver at most, and the share of the first residual at which it ends.
STEPS, ENOUGH = 1000, 1e-11


def _product(vector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = vector.value
        out = np.zeros(len(p))
        for b in batches:
            i, j, n = (b.column(c).to_numpy() for c in ("i", "j", "n"))
            out += np.bincount(i, weights=n * p[j], minlength=len(p)) + np.bincount(j, weights=n * p[i], minlength=len(p))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["i", "v"])

    return run


class Sigma:
    """Sums of products over continuous features and one-hot columns: ``mean`` and ``second`` (mean
    squares) a feature, the continuous rows dense, the pairs of categories as a table."""

    def __init__(self, df: DataFrame, cont: Sequence[str], cat: Sequence[str], **options) -> None:
        self.spark, self.cont, self.cat = df.sparkSession, list(cont), list(cat)
        spec = Spec(tuple(cont), tuple(cat), **options)
        off = shifts(spec.rows(df), cont)
        self.shift = np.array([off.get(c, 0.0) for c in cont])
        near = spec.rows(df).withColumns({f"__x{i}": spec.value(c) - F.lit(float(s)).cast(spec.kind) for i, (c, s) in enumerate(zip(cont, self.shift, strict=True))})
        rows = tables.checkpoint(grouped_sums(near, Spec(tuple(f"__x{i}" for i in range(len(cont))), tuple(cat))))
        ids, k = {s: i for i, s in grouping_ids(cat).items()}, len(cont)
        whole = rows.where(F.col("set") == ids[()]).first()
        if whole is None or not whole["n"]:
            raise ValueError("no rows to learn from")
        self.count = whole["n"]
        self.quad = np.array([[whole[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float).reshape(k, k)
        self.names: list = list(cont)
        known, sums = [], [np.zeros((0, 1 + k))]
        for c in cat:
            own = rows.where(F.col("set") == ids[(c,)]).select(c, "n", *[f"s{i}" for i in range(k)]).collect()
            own.sort(key=lambda r: r[0])
            known += [(c, str(r[0]), len(self.names) + i) for i, r in enumerate(own)]
            self.names += [(c, r[0]) for r in own]
            sums.append(np.array([list(r[1:]) for r in own], dtype=float).reshape(len(own), 1 + k))
        hot = np.concatenate(sums)
        self.hot, self.cross = hot[:, 0], hot[:, 1:]
        self.mean = np.concatenate([[whole[f"s{i}"] for i in range(k)], self.hot]) / self.count
        self.second = np.concatenate([np.diag(self.quad), self.hot]) / self.count
        self.pairs = self._pairs(rows, ids, known) if len(cat) > 1 else None

    def _pairs(self, rows: DataFrame, ids: dict, known: list[tuple]) -> DataFrame:
        """i, j, n of every pair of categories that occurs; places by Spark's join, broadcast while small."""
        place = self.spark.createDataFrame(known, "c string, k string, at long")
        out = None
        for a, b in combinations(self.cat, 2):
            own = rows.where(F.col("set") == ids[(a, b)]).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col("n").cast("double").alias("n"))
            for c, of, at in ((a, "a", "i"), (b, "b", "j")):
                own = own.join(place.where(F.col("c") == c).select(F.col("k").alias(of), F.col("at").alias(at)), of).drop(of)
            out = own.select("i", "j", "n") if out is None else out.unionByName(own.select("i", "j", "n"))
        return tables.checkpoint(out)

    def times(self, p: np.ndarray) -> np.ndarray:
        """The covariance matrix times a vector."""
        k = len(self.cont)
        out = np.concatenate([self.quad @ p[:k] + self.cross.T @ p[k:], self.cross @ p[:k] + self.hot * p[k:]])
        if self.pairs is not None:
            shared = self.spark.sparkContext.broadcast(p)
            met = self.pairs.mapInArrow(_product(shared), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
            out[met.column("i").to_numpy()] += met.column("v").to_numpy()
            shared.unpersist()
        return out / self.count - self.mean * float(self.mean @ p)


def solve(s: Sigma, label: str, ridge: float = 0.0, steps: int = STEPS) -> tuple[np.ndarray, int]:
    """Weights of all features but the label (whose weight is 0), and the steps taken."""
    y = s.cont.index(label)
    spread = s.second - s.mean**2
    varies = spread > TINY * s.second
    varies[y] = False
    scale = np.sqrt(np.where(varies, spread, 1.0))
    unit = np.zeros(len(s.mean))
    unit[y] = 1.0
    goal = np.where(varies, s.times(unit) / scale, 0.0)
    apply = lambda v: np.where(varies, s.times(np.where(varies, v / scale, 0.0)) / scale + ridge * v / scale**2, 0.0)
    x, r = np.zeros(len(goal)), goal.copy()
    p, size, first, taken = r.copy(), float(r @ r), float(goal @ goal), 0
    while taken < steps and size > ENOUGH**2 * first:
        q = apply(p)
        bend = float(p @ q)
        if bend <= 0:
            break
        x, r = x + size / bend * p, r - size / bend * q
        size, before = float(r @ r), size
        p, taken = r + size / before * p, taken + 1
    return x / scale, taken


def fit(df: DataFrame, label: str, cont: Sequence[str] = (), cat: Sequence[str] = (), *, ridge: float = 0.0, **options) -> LinearRegression:
    """Linear regression as :meth:`LinearRegression.fit`, for categories in any number."""
    s = Sigma(df, [*dict.fromkeys([label, *cont])], cat, **options)
    weights, _ = solve(s, label, ridge)
    y = s.cont.index(label)
    keep = [i for i in range(len(s.names)) if i != y]
    mean = s.mean + np.append(s.shift, np.zeros(len(s.names) - len(s.cont)))
    centre = (mean[keep], float(mean[y])) if s.shift.any() else None
    return LinearRegression([s.names[i] for i in keep], weights[keep], float(mean[y] - weights[keep] @ mean[keep]), None, None, centre)
