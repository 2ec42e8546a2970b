"""Models learnt from aggregates alone; predictions are Columns.

Training collects a cofactor (or naive-Bayes aggregates) and solves on the driver. What a
model predicts is arithmetic, conditions and look-ups over columns, so it fuses with the
scan it stands in; it is null where a feature is. Where sums were taken about shifts, predictions
are computed about them too (``centre``), as products of values far from 0 would lose what varies.
``to_params``/``from_params`` exchange flat arrays of numbers, about 0; categories must be numbers
there.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyring.operators.ring import Cofactor, NBAggregates
from tallyring.operators.sigma import Sigma, class_sums, dictionary, sigma
from tallyring.plans import aggregate
from tallyring.plans.aggregate import Spec

#: Eigenvalues of a correlation matrix up to this share of the largest count as 0, and so do
#: variances up to TINY of the mean square, which is about what sums in doubles leave of them.
RANK, TINY = 1e-12, 1e-13
#: Share of the label's variance below which that of the residuals is summed from the rows: as a
#: difference of sums it would hold few of their digits.
LITTLE = 1e-3
#: Categories up to which a look-up is one map.
FEW = 16
#: Features up to which a quadratic form is expressions of columns.
DENSE = 10


def _balance(matrix: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which features vary, their deviations (1 for others), and the correlations (0 for others)."""
    spread = np.diag(matrix)
    varies = spread > TINY * second
    scale = np.sqrt(np.where(varies, spread, 1.0))
    return varies, scale, np.where(np.outer(varies, varies), matrix / np.outer(scale, scale), 0.0)


def _inverse(matrix: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse of a covariance matrix on its range, and the log determinant there. Features are
    scaled to deviation 1 first, so units decide nothing. ``second``: mean squares of the features
    about 0, by which rounding is judged."""
    varies, scale, r = _balance(matrix, second)
    values, vectors = np.linalg.eigh(r)
    noise = 64 * np.finfo(float).eps * np.max(second[varies] / scale[varies] ** 2, initial=0.0)
    good = values > max(RANK, noise) * max(values.max(initial=0.0), 1e-300)
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T / np.outer(scale, scale)
    return inverse, float(np.log(values[good]).sum() + 2 * np.log(scale).sum())


def lookup(column: str, values: dict) -> Column:
    """Value of a category; null for one that is not there. A map is searched entry by entry, so
    many whole numbers or texts are dealt into maps of about 4 by their CRC, as one literal."""
    if not values:
        return F.lit(None).cast("double")
    if len(values) <= FEW or not all(type(v) in (int, str) for v in values):
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column))
    n = -(-len(values) // 4)
    maps: list[dict] = [{} for _ in range(n)]
    for k, v in values.items():
        maps[zlib.crc32(str(k).encode()) % n][str(k)] = v
    key = F.col(column).cast("string")
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")
    return F.element_at(F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")), key)


def _known(names: Sequence, out: Column) -> Column:
    """``out`` where no feature is null."""
    columns = dict.fromkeys(n[0] if isinstance(n, tuple) else n for n in names)
    return F.when(reduce(and_, [F.col(c).isNotNull() for c in columns]), out) if columns else out


def _linear(names: Sequence, weights: Sequence[float], intercept: float, means: np.ndarray | None = None, apart: bool = False) -> Column:
    """intercept + sum of weights * (feature - mean); ``apart``: means are taken off row by row."""
    if means is not None:
        intercept -= sum(float(w) * float(m) for n, w, m in zip(names, weights, means, strict=True) if not apart or isinstance(n, tuple))
    out, hot = F.lit(float(intercept)), {}
    for i, (n, w) in enumerate(zip(names, weights, strict=True)):
        if isinstance(n, tuple):
            hot.setdefault(n[0], {})[n[1]] = float(w)
        else:
            x = F.col(n).cast("double")
            out = out + F.lit(float(w)) * (x - F.lit(float(means[i])) if apart else x)
    return reduce(lambda c, kv: c + F.coalesce(lookup(*kv), F.lit(0.0)), hot.items(), out)


def _argmax(scores: Sequence[Column], labels: Sequence) -> Column:
    """Label of the highest score; of equal ones the first."""
    rows = [F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(y).alias("y")) for i, (s, y) in enumerate(zip(scores, labels, strict=True))]
    return F.array_max(F.array(*rows))["y"]


def _blocks(names: Sequence) -> tuple[list[str], dict[str, list]]:
    cont, cats = [n for n in names if not isinstance(n, tuple)], {}
    for n in names:
        if isinstance(n, tuple):
            cats.setdefault(n[0], []).append(n[1])
    return cont, cats


def _offsets(cats: dict[str, list]) -> list[float]:
    """Begin and end of each categorical feature in the joined categories, then those."""
    ends = np.cumsum([0, *[len(v) for v in cats.values()]])
    return [*map(float, ends), *[float(x) for v in cats.values() for x in v]]


def _read_offsets(p: list[float], m: int, cats: Sequence[str]) -> dict[str, list]:
    ends = [int(p.pop(0)) for _ in range(m + 1)]
    values = [int(p.pop(0)) for _ in range(ends[-1])]
    return {c: values[a:b] for c, a, b in zip(cats, ends, ends[1:], strict=False)}


def _names(cont: Sequence[str], cats: dict[str, list]) -> list:
    return [*cont, *[(c, v) for c, vs in cats.items() for v in vs]]


def _fitted(source, cont, cat, options) -> Cofactor:
    a = source if isinstance(source, Cofactor) else aggregate.cofactor(source, Spec(tuple(cont), tuple(cat), **options))
    if a is None or not a.count:
        raise ValueError("no rows to learn from")
    return a.prune()


def _by_label(sums, source: DataFrame, label: str, spec: Spec) -> dict:
    """An aggregate a class; rows without a label are as rows without a feature."""
    parts = {k[0]: v for k, v in sums(source, spec, [label]).items()}
    if None in parts and spec.on_null == "raise":
        raise ValueError(f"{label} is null in some rows")
    parts.pop(None, None)
    if not parts:
        raise ValueError("no rows to learn from")
    return parts


@dataclass
class LinearRegression:
    """Least squares, with a ridge penalty on all weights but the intercept."""

    names: list
    weights: np.ndarray
    intercept: float
    means: np.ndarray | None = None
    sigma: float | None = None
    #: means and prediction there, where features are far from 0
    centre: tuple[np.ndarray, float] | None = None

    @classmethod
    def fit(cls, source: DataFrame | Cofactor, label: str, cont: Sequence[str] = (), cat: Sequence[str] = (), *, ridge: float = 0.0, norm: bool = False, variance: bool = False, solver: str = "closed", step: float = 0.001, max_iterations: int = 10_000, **options) -> LinearRegression:
        """``cont`` without the label, which must be continuous."""
        if label in cat:
            raise ValueError("the label of a regression is continuous")
        a = _fitted(source, [*dict.fromkeys([label, *cont])], cat, options)
        if label not in a.cont:
            raise ValueError(f"{label} is no continuous feature of the aggregate")
        s = sigma(a)
        out = cls.from_sigma(s, label, ridge, norm, variance, solver, step, max_iterations)
        if variance and not isinstance(source, Cofactor) and not options.get("decimal"):
            y = s.at(label)
            if out.sigma**2 < LITTLE * (s.matrix[y, y] / s.count - (s.matrix[0, y] / s.count) ** 2):
                out.sigma = out._deviation(Spec(tuple(a.cont), tuple(a.cat), **options).rows(source), label, a.shift[a.cont.index(label)])
        return out

    def _deviation(self, rows: DataFrame, label: str, near: float) -> float:
        """Deviation of the residuals, from the rows; ``near``: a value near the label's."""
        means = np.zeros(len(self.names)) if self.centre is None else self.centre[0]
        off = F.col(label).cast("double") - F.lit(float(near)) - _linear(self.names, self.weights, 0.0, means, apart=True)
        return float(rows.agg(F.stddev_pop(off)).first()[0])

    @classmethod
    def from_packed(cls, triangle: Sequence[float], label: int, **options) -> LinearRegression:
        """From the packed upper triangle over [1, x0, x1, ...]; ``label`` is the place of an x."""
        p = int((np.sqrt(1 + 8 * len(triangle)) - 1) / 2)
        if p * (p + 1) // 2 != len(triangle) or not 0 <= label < p - 1:
            raise ValueError("no packed triangle with this label")
        m = np.zeros((p, p))
        m[np.triu_indices(p)] = triangle
        names = [f"x{i}" for i in range(p - 1)]
        return cls.from_sigma(Sigma(names, np.triu(m) + np.triu(m, 1).T), names[label], **options)

    @classmethod
    def from_sigma(cls, s: Sigma, label: str, ridge: float = 0.0, norm: bool = False, variance: bool = False, solver: str = "closed", step: float = 0.001, max_iterations: int = 10_000) -> LinearRegression:
        n, y = s.count, s.at(label) - 1
        x = [i for i in range(len(s.names)) if i != y]
        mean, second = s.matrix[0, 1:] / n, np.diag(s.matrix)[1:] / n
        c = s.matrix[1:, 1:] / n - np.outer(mean, mean)
        own, to = c[np.ix_(x, x)], c[x, y]
        varies, scale, r = _balance(own, second[x])
        to = np.where(varies, to, 0.0)
        penalty = ridge * (scale**2 if norm else np.ones(len(x)))
        if solver == "closed":
            weights = _inverse(own + np.diag(penalty), second[x] + penalty)[0] @ to
        else:
            weights = _descend(r, to / scale, penalty / scale**2, step, max_iterations) / scale
        residual = float(np.sqrt(max(0.0, c[y, y] - 2 * weights @ to + weights @ own @ weights))) if variance else None
        names, mean = [s.names[i] for i in x], mean + s.about
        centre = (mean[x], float(mean[y])) if s.about.any() else None
        return cls(names, weights, float(mean[y]) if norm else float(mean[y] - weights @ mean[x]), mean[x] if norm else None, residual, centre)

    def predict_column(self, noise_seed: int | None = None) -> Column:
        """Prediction; with a seed, plus normal noise of the residual deviation."""
        if self.centre is not None:
            out = _linear(self.names, self.weights, self.centre[1], self.centre[0], apart=True)
        else:
            out = _linear(self.names, self.weights, self.intercept, self.means)
        out = _known([n for n in self.names if isinstance(n, tuple)], out)
        return out if noise_seed is None else out + F.lit(float(self.sigma or 0.0)) * F.randn(noise_seed)

    def to_params(self) -> list[float]:
        cont, cats = _blocks(self.names)
        out = [float(len(cats)), *(_offsets(cats) if cats else []), self.intercept, *map(float, self.weights)]
        return out + ([*map(float, self.means)] if self.means is not None else []) + ([self.sigma] if self.sigma is not None else [])

    @classmethod
    def from_params(cls, params: Sequence[float], cont: Sequence[str], cat: Sequence[str] = (), norm: bool = False) -> LinearRegression:
        p = list(params)
        m = int(p.pop(0))
        names = _names(cont, _read_offsets(p, m, cat) if m else {})
        intercept, k = p.pop(0), len(names)
        means = np.array(p[k : 2 * k]) if norm else None
        rest = p[k * (2 if norm else 1) :]
        return cls(names, np.array(p[:k]), intercept, means, rest[0] if rest else None)


def _descend(a: np.ndarray, b: np.ndarray, penalty: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Gradient descent on the normal equations, steps by the secant rule, halved until the
    error falls."""
    theta = np.zeros(len(b))
    slope = lambda t: a @ t - b + penalty * t
    error = lambda t: t @ a @ t / 2 - b @ t + penalty @ t**2 / 2
    g = first = slope(theta)
    for _ in range(rounds):
        now, size = error(theta), step
        for _ in range(60):
            new = theta - size * g
            if error(new) <= now:
                break
            size /= 2
        moved, turned = new - theta, slope(new) - g
        theta, g = new, g + turned
        if np.linalg.norm(moved) < 1e-20 or np.linalg.norm(g) < 1e-12 * (1 + np.linalg.norm(first)):
            break
        bend = moved @ turned
        step = float(moved @ moved / bend) if bend > 0 else step
    return theta


@dataclass
class LDA:
    """Linear discriminant analysis; ties go to the first label in order."""

    names: list
    labels: list
    weights: np.ndarray
    intercepts: np.ndarray
    means: np.ndarray | None = None
    #: a shift of features far from 0 and the scores there
    centre: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def fit(cls, source: DataFrame | Cofactor, label: str, cont: Sequence[str] = (), cat: Sequence[str] = (), *, shrinkage: float = 0.0, norm: bool = False, **options) -> LDA:
        a = _fitted(source, cont, [*dict.fromkeys([*cat, label])], options)
        if label not in a.cat:
            raise ValueError("the label of a classifier is categorical")
        categories = dictionary([a], [c for c in a.cat if c != label])
        s, n = sigma(a, categories, skip=label), float(a.count)
        sums = class_sums(a, label, categories)
        labels = list(sums)
        centre, second = s.matrix[0, 1:] / n, np.diag(s.matrix)[1:] / n
        mean, std = np.zeros(len(s.names)), np.ones(len(s.names))
        if norm:
            _, mean, std = s.standardized()
        counts = np.array([sums[y][0] for y in labels])
        raw = np.array([sums[y][1:] / sums[y][0] for y in labels])
        # class means about the shift (what is the same for all classes decides nothing), or about the mean
        mu, apart = (raw - (mean - s.about if norm else 0)) / std, raw - centre
        within = (s.matrix[1:, 1:] / n - np.outer(centre, centre) - (apart * counts[:, None]).T @ apart / n) / np.outer(std, std)
        second = second / std**2
        within = np.where(np.diag(within) > TINY * second, 1.0, 0.0)[:, None] * within
        p = len(within)
        within = (1 - shrinkage) * within + shrinkage * np.trace(within) / max(1, p) * np.eye(p)
        weights = mu @ _inverse(within, second)[0].T if p else np.zeros((len(labels), 0))
        intercepts = -0.5 * np.einsum("ij,ij->i", mu, weights) + np.log(counts / n)
        weights = weights / std
        if not s.about.any():
            return cls(s.names, labels, weights, intercepts, mean if norm else None)
        place = mean if norm else s.about
        return cls(s.names, labels, weights, intercepts if norm else intercepts - weights @ place, mean if norm else None, (place, intercepts))

    def scores(self) -> list[Column]:
        if self.centre is not None:
            return [_linear(self.names, w, b, self.centre[0], apart=True) for w, b in zip(self.weights, self.centre[1], strict=True)]
        return [_linear(self.names, w, b, self.means) for w, b in zip(self.weights, self.intercepts, strict=True)]

    def predict_column(self) -> Column:
        return _known(self.names, _argmax(self.scores(), self.labels))

    def to_params(self) -> list[float]:
        _, cats = _blocks(self.names)
        out = [float(len(self.labels)), float(len(cats)), *(_offsets(cats) if cats else []), *map(float, self.labels)]
        out += [*map(float, self.weights.ravel()), *map(float, self.intercepts)]
        return out + ([*map(float, self.means)] if self.means is not None else [])

    @classmethod
    def from_params(cls, params: Sequence[float], cont: Sequence[str], cat: Sequence[str] = (), norm: bool = False) -> LDA:
        p = list(params)
        k, m = int(p.pop(0)), int(p.pop(0))
        names = _names(cont, _read_offsets(p, m, cat) if m else {})
        labels, q = [int(p.pop(0)) for _ in range(k)], len(names)
        return cls(names, labels, np.array(p[: k * q]).reshape(k, q), np.array(p[k * q : k * q + k]), np.array(p[k * q + k :]) if norm else None)


@dataclass
class QDA:
    """Quadratic discriminant analysis. The first category of each feature is the base of its
    one-hot columns; singular covariances are inverted on their range (eigenvalues of the
    correlations over RANK of the largest), with the determinant of that range times the variances."""

    names: list
    labels: list
    squares: list[np.ndarray]
    weights: list[np.ndarray]
    intercepts: list[float]
    means: np.ndarray | None = None
    #: a shift of features far from 0, and weights and intercepts about it
    centre: tuple[np.ndarray, list[np.ndarray], list[float]] | None = None

    @classmethod
    def fit(cls, source: DataFrame | dict, label: str | None = None, cont: Sequence[str] = (), cat: Sequence[str] = (), *, norm: bool = False, **options) -> QDA:
        """From rows, or from a cofactor per class."""
        parts = source if isinstance(source, dict) else _by_label(aggregate.cofactors, source, label, Spec(tuple(cont), tuple(cat), **options))
        labels = sorted(parts)
        first = parts[labels[0]]
        whole = [parts[y].aligned(first) for y in labels]
        categories = dictionary(whole, first.cat, drop_first=True)
        sigmas = [sigma(a, categories) for a in whole]
        names, n = sigmas[0].names, sum(a.count for a in whole)
        mean, std = np.zeros(len(names)), np.ones(len(names))
        pooled = [s.about for s in sigmas]
        shift = sum(s.count * a for s, a in zip(sigmas, pooled, strict=True)) / n
        if norm:
            common = [sigma(a.about(shift[: len(a.cont)]), categories) for a in whole]
            _, mean, std = Sigma(names, sum(s.matrix for s in common), shift if shift.any() else None).standardized()
        place = mean if norm else shift
        squares, weights, intercepts = [], [], []
        for s in sigmas:
            centre = s.matrix[0, 1:] / s.count
            mu = (centre + (s.about - place)) / std
            covariance = (s.matrix[1:, 1:] / s.count - np.outer(centre, centre)) / np.outer(std, std)
            inverse, logdet = _inverse(covariance, np.diag(s.matrix)[1:] / s.count / std**2)
            squares.append(-0.5 * inverse / np.outer(std, std))
            weights.append(inverse @ mu / std)
            intercepts.append(float(-0.5 * mu @ inverse @ mu - 0.5 * logdet + np.log(s.count / n)))
        if norm or not shift.any():
            return cls(names, labels, squares, weights, intercepts, mean if norm else None)
        own = [w - 2 * q @ shift for q, w in zip(squares, weights, strict=True)]
        at0 = [float(b + shift @ q @ shift - w @ shift) for q, w, b in zip(squares, weights, intercepts, strict=True)]
        return cls(names, labels, squares, own, at0, None, (shift, weights, intercepts))

    def _about(self) -> tuple[np.ndarray | None, list[np.ndarray], list[float]]:
        """What is taken off features, and weights and intercepts that go with it."""
        return self.centre if self.centre is not None else (self.means, self.weights, self.intercepts)

    def _features(self) -> list[Column]:
        return [F.when(F.col(n[0]) == F.lit(n[1]), 1.0).otherwise(0.0) if isinstance(n, tuple) else F.col(n).cast("double") for n in self.names]

    def scores(self) -> list[Column]:
        place, weights, intercepts = self._about()
        x = self._features()
        if place is not None:
            x = [c - F.lit(float(m)) for c, m in zip(x, place, strict=True)]
        out = []
        for square, weight, intercept in zip(self.squares, weights, intercepts, strict=True):
            total = F.lit(float(intercept))
            for i, c in enumerate(x):
                row = F.lit(float(weight[i]))
                for j in range(i, len(x)):
                    row = row + F.lit(float(square[i, j] * (1 if i == j else 2))) * x[j]
                total = total + row * c
            out.append(total)
        return out

    def predict_column(self) -> Column:
        """Labels by expressions of columns; beyond DENSE features, whose squares would be too many
        expressions, by matrix products over Arrow batches of the features alone."""
        if len(self.names) <= DENSE:
            return _known(self.names, _argmax(self.scores(), self.labels))
        place, weights, intercepts = self._about()
        squares, linear, base = np.stack(self.squares), np.stack(weights), np.array(intercepts)
        off = np.zeros(len(self.names)) if place is None else np.asarray(place)

        def best(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1) - off
                scores = np.stack([((x @ q) * x).sum(axis=1) + x @ w + b for q, w, b in zip(squares, linear, base, strict=True)])
                yield pa.array(scores.argmax(axis=0), pa.int32())

        best.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        place_of = F.arrow_udf(best, "int")(*[F.coalesce(c, F.lit(0.0)) for c in self._features()])
        return _known(self.names, F.get(F.array(*map(F.lit, self.labels)), place_of))

    def to_params(self) -> list[float]:
        _, cats = _blocks(self.names)
        out = [float(len(self.labels)), float(len(cats) + 1 if cats else 0), *(_offsets(cats) if cats else []), *map(float, self.labels)]
        for square, weight, intercept in zip(self.squares, self.weights, self.intercepts, strict=True):
            out += [*map(float, square.ravel()), *map(float, weight), intercept]
        return out + ([*map(float, self.means)] if self.means is not None else [])

    @classmethod
    def from_params(cls, params: Sequence[float], cont: Sequence[str], cat: Sequence[str] = (), norm: bool = False) -> QDA:
        p = list(params)
        k, m = int(p.pop(0)), int(p.pop(0))
        names = _names(cont, _read_offsets(p, m - 1, cat) if m else {})
        labels, q = [int(p.pop(0)) for _ in range(k)], len(names)
        squares, weights, intercepts = [], [], []
        for i in range(k):
            own = p[i * (q * q + q + 1) :][: q * q + q + 1]
            squares.append(np.array(own[: q * q]).reshape(q, q))
            weights.append(np.array(own[q * q : q * q + q]))
            intercepts.append(own[-1])
        return cls(names, labels, squares, weights, intercepts, np.array(p[k * (q * q + q + 1) :]) if norm else None)


@dataclass
class NaiveBayes:
    """Gaussian and categorical naive Bayes, in log space. An unseen category has probability 0;
    if all classes have, the first label in order is predicted."""

    cont: list[str]
    cats: dict[str, list]
    labels: list
    priors: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    prob: list[dict[str, dict]] = field(default_factory=list)
    ADDED = 1e-9

    @classmethod
    def fit(cls, source: DataFrame | dict, label: str | None = None, cont: Sequence[str] = (), cat: Sequence[str] = (), **options) -> NaiveBayes:
        """From rows, or from naive-Bayes aggregates per class."""
        parts: dict = source if isinstance(source, dict) else _by_label(aggregate.nb_aggregates, source, label, Spec(tuple(cont), tuple(cat), **options))
        labels = sorted(parts)
        a: list[NBAggregates] = [parts[y] for y in labels]
        n = np.array([x.count for x in a], dtype=float)
        mean = np.array([x.lin / x.count + x.shift for x in a])
        var = np.array([np.maximum(x.square / x.count - (x.lin / x.count) ** 2, 0) for x in a])
        cats = {c: sorted({v for x in a for v in x.by_cat[c]}) for c in a[0].cat}
        prob = [{c: {v: x.by_cat[c].get(v, 0.0) / x.count for v in cats[c]} for c in cats} for x in a]
        return cls(a[0].cont, cats, labels, n / n.sum(), mean, var, prob)

    def scores(self) -> list[Column]:
        out = []
        for k in range(len(self.labels)):
            score = F.lit(float(np.log(self.priors[k])))
            for i, c in enumerate(self.cont):
                v = float(self.var[k][i] + self.ADDED)
                score = score - F.pow(F.col(c).cast("double") - F.lit(float(self.mean[k][i])), 2) / F.lit(2 * v) - F.lit(0.5 * float(np.log(2 * np.pi * v)))
            for c, by in self.prob[k].items():
                logs = {v: float(np.log(q)) for v, q in by.items() if q > 0}
                score = score + F.coalesce(lookup(c, logs), F.lit(float("-inf")))
            out.append(score)
        return out

    def predict_column(self) -> Column:
        return _known([*self.cont, *self.cats], _argmax(self.scores(), self.labels))

    def to_params(self) -> list[float]:
        out = [float(len(self.labels)), float(len(self.cats) + 1 if self.cats else 0), *(_offsets(self.cats) if self.cats else []), *map(float, self.labels), *map(float, self.priors)]
        for k in range(len(self.labels)):
            out += [float(x) for mv in zip(self.mean[k], self.var[k], strict=True) for x in mv]
            out += [float(self.prob[k][c][v]) for c in self.cats for v in self.cats[c]]
        return out

    @classmethod
    def from_params(cls, params: Sequence[float], cont: Sequence[str], cat: Sequence[str] = ()) -> NaiveBayes:
        p = list(params)
        k, m = int(p.pop(0)), int(p.pop(0))
        cats = _read_offsets(p, m - 1, cat) if m else {}
        labels = [int(p.pop(0)) for _ in range(k)]
        priors = np.array([p.pop(0) for _ in range(k)])
        mean, var, prob = [], [], []
        for _ in range(k):
            pairs = [(p.pop(0), p.pop(0)) for _ in cont]
            mean.append([x for x, _ in pairs])
            var.append([x for _, x in pairs])
            prob.append({c: {v: p.pop(0) for v in vs} for c, vs in cats.items()})
        return cls(list(cont), cats, labels, priors, np.array(mean), np.array(var), prob)
