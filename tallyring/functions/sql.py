"""Training and prediction in SQL.

``register`` adds, for a session:

* ``linregr_predict``, ``lda_predict``, ``qda_predict`` and ``nb_predict`` of (params, cont, cat, ...):
  SQL functions over flat parameter arrays, which Catalyst puts in the place of their calls, so
  they run where the scan does, without Python;
* table functions that train. ``ring_sums(TABLE(...), cont, cat, by)`` sums what a partition holds,
  about its own shifts, as Arrow batches come: a row a partition and group; features are named, with
  commas between. ``linregr_train``, ``lda_train``, ``qda_train`` and ``nb_train`` add these few rows and
  return one row with the parameters:

      WITH m AS (SELECT params FROM linregr_train(TABLE(
          SELECT * FROM ring_sums(TABLE(SELECT * FROM t), 'y,x', 'c', '')) WITH SINGLE PARTITION, 'y'))
      SELECT t.*, linregr_predict(m.params, array(x), array(c), false, false) FROM t, m

  For quadratic discriminants and naive Bayes ``by`` names the label, which is no feature then.

Rows without a feature raise, as in all sums; categories and labels are whole numbers. ``train``
fits a model over a table's name or a query's text from Python, by Catalyst's own aggregates.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyring.operators.models import LDA, QDA, LinearRegression, NaiveBayes
from tallyring.operators.ring import Cofactor, NBAggregates
from tallyring.ship import ship
from tallyring.sources import tables

def _sum(of: str) -> str:
    return f"aggregate({of}, 0D, (total, term) -> total + term)"


def _dot(a: str, b: str) -> str:
    """Sum of products; a lambda may hold no call of a SQL function, so this is text."""
    return _sum(f"zip_with({a}, {b}, (left, right) -> left * right)")


def _turns(n: str) -> str:
    return f"slice(sequence(0, {n}), 1, {n})"


_WIDE, _QUADRATIC, _CLASS = "size(x)", "(size(x) * size(x) + size(x) + 1)", "(2 * size(cont) + size(hot))"
_FORM = f"(o + k + c * {_QUADRATIC})"
_OWN = f"(o + 2 * k + c * {_CLASS})"
# Where things stand in a flat array p, counted from 1: h is the place of the number of offsets, n how
# many categorical features there are, so offsets begin at h + 1 and categories at h + n + 2.
_HELPERS = {
    "ring_hot(p ARRAY<DOUBLE>, h INT, n INT) RETURNS INT": "IF(n > 0, CAST(p[h + n] AS INT), 0)",
    "ring_after(p ARRAY<DOUBLE>, h INT, n INT) RETURNS INT": "IF(n > 0, h + n + 2 + ring_hot(p, h, n), h + 1)",
    "ring_design(p ARRAY<DOUBLE>, h INT, n INT, cont ARRAY<DOUBLE>, cat ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": f"IF(n = 0, cont, concat(cont, flatten(transform({_turns('n')}, j -> transform(slice(p, CAST(h + n + 2 + p[h + j] AS INT), CAST(p[h + j + 1] - p[h + j] AS INT)), v -> IF(v = cat[j], 1D, 0D))))))",
    "ring_less(x ARRAY<DOUBLE>, p ARRAY<DOUBLE>, at INT, norm BOOLEAN) RETURNS ARRAY<DOUBLE>": f"IF(norm, zip_with(x, slice(p, at, {_WIDE}), (a, m) -> a - m), x)",
    "ring_known(cont ARRAY<DOUBLE>, cat ARRAY<DOUBLE>) RETURNS BOOLEAN": "NOT exists(cont, x -> x IS NULL) AND NOT exists(cat, x -> x IS NULL)",
    "ring_linear(p ARRAY<DOUBLE>, x ARRAY<DOUBLE>, o INT, norm BOOLEAN) RETURNS DOUBLE": f"p[o - 1] + {_dot(f'slice(p, o + 1, {_WIDE})', f'ring_less(x, p, o + 1 + {_WIDE}, norm)')}",
    "ring_best(scores ARRAY<DOUBLE>, p ARRAY<DOUBLE>, o INT) RETURNS BIGINT": "CAST(array_max(transform(scores, (s, k) -> struct(s AS s, -k AS k, p[o - 1 + k] AS y))).y AS BIGINT)",
    "ring_lda(p ARRAY<DOUBLE>, x ARRAY<DOUBLE>, k INT, o INT) RETURNS ARRAY<DOUBLE>": f"transform({_turns('k')}, c -> p[o - 1 + k + k * {_WIDE} + c] + {_dot(f'slice(p, o + k + c * {_WIDE}, {_WIDE})', 'x')})",
    "ring_qda(p ARRAY<DOUBLE>, x ARRAY<DOUBLE>, k INT, o INT) RETURNS ARRAY<DOUBLE>": f"transform({_turns('k')}, c -> {_sum('transform(x, (a, i) -> a * ' + _dot(f'slice(p, {_FORM} + i * {_WIDE}, {_WIDE})', 'x') + ')')} + {_dot(f'slice(p, {_FORM} + {_WIDE} * {_WIDE}, {_WIDE})', 'x')} + p[{_FORM} - 2 + {_QUADRATIC}])",
    "ring_nb(p ARRAY<DOUBLE>, cont ARRAY<DOUBLE>, hot ARRAY<DOUBLE>, n INT, k INT, o INT) RETURNS ARRAY<DOUBLE>": f"transform({_turns('k')}, c -> ln(p[o - 1 + k + c]) + "
    + _sum(f"transform(cont, (x, i) -> -(x - p[{_OWN} - 1 + 2 * i]) * (x - p[{_OWN} - 1 + 2 * i]) / (2 * (p[{_OWN} + 2 * i] + {NaiveBayes.ADDED!r}D)) - 0.5D * ln(2 * pi() * (p[{_OWN} + 2 * i] + {NaiveBayes.ADDED!r}D)))")
    + f" + IF({_sum('hot')} < n, -double('infinity'), "
    + _sum(f"zip_with(hot, slice(p, {_OWN} + 2 * size(cont), size(hot)), (a, q) -> CASE WHEN a = 0 THEN 0D WHEN q > 0 THEN ln(q) ELSE -double('infinity') END)")
    + "))",
}
_X = "ring_design(params, {h}, {n}, cont, cat)"
_PREDICT = {
    "linregr_predict(params ARRAY<DOUBLE>, cont ARRAY<DOUBLE>, cat ARRAY<DOUBLE>, add_noise BOOLEAN, norm BOOLEAN) RETURNS DOUBLE": "CASE WHEN ring_known(cont, cat) THEN ring_linear(params, {x}, {o}, norm) + IF(add_noise AND size(params) > {o} + size({x}) * IF(norm, 2, 1), params[size(params) - 1] * randn(), 0D) END".format(x=_X.format(h=1, n="CAST(params[0] AS INT)"), o="ring_after(params, 1, CAST(params[0] AS INT))"),
    "lda_predict(params ARRAY<DOUBLE>, cont ARRAY<DOUBLE>, cat ARRAY<DOUBLE>, norm BOOLEAN) RETURNS BIGINT": "CASE WHEN ring_known(cont, cat) THEN ring_best(ring_lda(params, ring_less({x}, params, {o} + {k} + {k} * size({x}) + {k}, norm), {k}, {o}), params, {o}) END".format(x=_X.format(h=2, n="CAST(params[1] AS INT)"), k="CAST(params[0] AS INT)", o="ring_after(params, 2, CAST(params[1] AS INT))"),
    "qda_predict(params ARRAY<DOUBLE>, cont ARRAY<DOUBLE>, cat ARRAY<DOUBLE>, norm BOOLEAN) RETURNS BIGINT": "CASE WHEN ring_known(cont, cat) THEN ring_best(ring_qda(params, ring_less({x}, params, {o} + {k} + {k} * (size({x}) * size({x}) + size({x}) + 1), norm), {k}, {o}), params, {o}) END".format(x=_X.format(h=2, n="GREATEST(CAST(params[1] AS INT) - 1, 0)"), k="CAST(params[0] AS INT)", o="ring_after(params, 2, GREATEST(CAST(params[1] AS INT) - 1, 0))"),
    "nb_predict(params ARRAY<DOUBLE>, cont ARRAY<DOUBLE>, cat ARRAY<DOUBLE>) RETURNS BIGINT": "CASE WHEN ring_known(cont, cat) THEN ring_best(ring_nb(params, cont, slice({x}, size(cont) + 1, size({x}) - size(cont)), {n}, {k}, {o}), params, {o}) END".format(x=_X.format(h=2, n="GREATEST(CAST(params[1] AS INT) - 1, 0)"), n="GREATEST(CAST(params[1] AS INT) - 1, 0)", k="CAST(params[0] AS INT)", o="ring_after(params, 2, GREATEST(CAST(params[1] AS INT) - 1, 0))"),
}


def _names(said: pa.Array | None) -> list[str]:
    text = said[0].as_py() if said is not None and len(said) else ""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def sums_of(batch: pa.RecordBatch, cont: Sequence[str], cat: Sequence[str], by: Sequence[str]) -> dict[tuple, Cofactor]:
    """Cofactors of the rows of a batch, by the values of ``by``, about the batch's means."""
    columns = [batch.column(c) for c in (*cont, *cat, *by)]
    if any(c.null_count for c in columns):
        raise ValueError("a feature is null")
    x = np.column_stack([np.ones(batch.num_rows), *[c.cast(pa.float64()).to_numpy() for c in columns[: len(cont)]]])
    if not np.isfinite(x).all():
        raise ValueError("a feature is NaN or infinite")
    codes = {c: np.unique(a.to_numpy(zero_copy_only=False), return_inverse=True) for c, a in zip((*cat, *by), columns[len(cont) :], strict=True)}
    shift = x[:, 1:].mean(axis=0)
    x[:, 1:] -= shift
    out: dict[tuple, Cofactor] = {}
    places = np.zeros(len(x), dtype=np.int64)
    for b in by:
        places = places * len(codes[b][0]) + codes[b][1]
    for place in np.unique(places):
        rows = np.flatnonzero(places == place)
        own, total = x[rows], x[rows].T @ x[rows]
        a = Cofactor(list(cont), list(cat), len(rows), total[0, 1:], total[1:, 1:], shift=shift)
        for c in cat:
            values, code = codes[c]
            sums = np.stack([np.bincount(code[rows], weights=own[:, i], minlength=len(values)) for i in range(own.shape[1])], axis=1)
            a.by_cat[c] = {v: s for v, s in zip(values.tolist(), sums, strict=True) if s[0]}
        for c, d in combinations(cat, 2):
            met, n = np.unique(codes[c][1][rows] * len(codes[d][0]) + codes[d][1][rows], return_counts=True)
            a.by_pair[c, d] = {(codes[c][0][i // len(codes[d][0])].item(), codes[d][0][i % len(codes[d][0])].item()): float(k) for i, k in zip(met.tolist(), n.tolist(), strict=True)}
        out[tuple(codes[b][0][codes[b][1][rows[0]]].item() for b in by)] = a
    return out


class RingSums:
    """Partial sums of a partition: a row a group, ``state`` an aggregate for the functions that train."""

    def __init__(self) -> None:
        self.held: dict[tuple, Cofactor] = {}

    def eval(self, rows: pa.RecordBatch, cont: pa.Array, cat: pa.Array, by: pa.Array) -> Iterator[pa.Table]:
        for key, a in sums_of(rows, _names(cont), _names(cat), _names(by)).items() if rows.num_rows else ():
            self.held[key] = self.held[key] + a if key in self.held else a
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        rows = list(self.held.items())
        yield pa.table({"label": pa.array([k[0] if k else None for k, _ in rows], pa.int64()), "state": pa.array([pickle.dumps(a) for _, a in rows], pa.binary())})


class _Train:
    """Adds partial sums and solves; one row."""

    def __init__(self) -> None:
        self.held: dict[int | None, Cofactor] = {}
        self.said: list = []

    def add(self, rows: pa.RecordBatch, *said: pa.Array) -> None:
        for label, state in zip(rows.column("label").to_pylist(), rows.column("state").to_pylist(), strict=True):
            a = pickle.loads(state)
            self.held[label] = self.held[label] + a if label in self.held else a
        self.said = [s[0].as_py() for s in said] if rows.num_rows else self.said

    def terminate(self) -> Iterator[pa.Table]:
        found = [self.solve().to_params()] if self.held else []
        yield pa.table({"params": pa.array(found, pa.list_(pa.float64()))})

    def whole(self) -> Cofactor:
        if set(self.held) != {None}:
            raise ValueError("sums by a label where none is wanted")
        return self.held[None]

    def classes(self) -> dict[int, Cofactor]:
        if None in self.held:
            raise ValueError("sums by the label are wanted")
        return {k: a.prune() for k, a in self.held.items()}


class TrainLinear(_Train):
    def eval(self, rows: pa.RecordBatch, label: pa.Array, ridge: pa.Array, norm: pa.Array, variance: pa.Array) -> Iterator[pa.Table]:
        self.add(rows, label, ridge, norm, variance)
        return iter(())

    def solve(self) -> LinearRegression:
        label, ridge, norm, variance = self.said
        return LinearRegression.fit(self.whole(), label, ridge=float(ridge), norm=norm, variance=variance)


class TrainLDA(_Train):
    def eval(self, rows: pa.RecordBatch, label: pa.Array, shrinkage: pa.Array, norm: pa.Array) -> Iterator[pa.Table]:
        self.add(rows, label, shrinkage, norm)
        return iter(())

    def solve(self) -> LDA:
        label, shrinkage, norm = self.said
        return LDA.fit(self.whole(), label, shrinkage=float(shrinkage), norm=norm)


class TrainQDA(_Train):
    def eval(self, rows: pa.RecordBatch, norm: pa.Array) -> Iterator[pa.Table]:
        self.add(rows, norm)
        return iter(())

    def solve(self) -> QDA:
        return QDA.fit(self.classes(), norm=self.said[0])


class TrainNB(_Train):
    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.add(rows)
        return iter(())

    def solve(self) -> NaiveBayes:
        parts = {k: NBAggregates(a.cont, a.cat, a.count, a.lin, np.diag(a.quad), {c: {v: float(s[0]) for v, s in by.items()} for c, by in a.by_cat.items()}, a.shift) for k, a in self.classes().items()}
        return NaiveBayes.fit(parts)


def train(spark: SparkSession, kind: str, source: str, label: str, cont: Sequence[str] = (), cat: Sequence[str] = (), **options) -> list[float]:
    """Parameters of ``linregr``, ``lda``, ``qda`` or ``nb``, fitted over a table, a path or a query."""
    kinds = {"linregr": LinearRegression, "lda": LDA, "qda": QDA, "nb": NaiveBayes}
    if kind not in kinds:
        raise ValueError(f"kind is one of {sorted(kinds)}")
    return kinds[kind].fit(tables.read(spark, source), label, cont, cat, **options).to_params()


def register(spark: SparkSession) -> None:
    """Add the functions of this module to the session."""
    ship(spark)
    for head, body in (_HELPERS | _PREDICT).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("ring_sums", F.arrow_udtf(RingSums, returnType="label long, state binary"))
    for name, kind in (("linregr_train", TrainLinear), ("lda_train", TrainLDA), ("qda_train", TrainQDA), ("nb_train", TrainNB)):
        spark.udtf.register(name, F.arrow_udtf(kind, returnType="params array<double>"))
