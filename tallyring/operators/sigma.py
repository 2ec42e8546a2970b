"""Dense matrices from a cofactor: the sums of products over [1, continuous, one-hot]."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tallyring.operators.ring import Cofactor


def dictionary(parts: Sequence[Cofactor], cats: Sequence[str], drop_first: bool = False) -> dict[str, list]:
    """Sorted categories of each feature over all parts; categories counted 0 times are none."""
    out = {}
    for c in cats:
        values = {k for p in parts for k, v in p.by_cat[c].items() if round(v[0]) != 0}
        out[c] = sorted(values, key=lambda v: (str(type(v)), v))[1 if drop_first else 0 :]
    return out


@dataclass
class Sigma:
    """``matrix`` with row and column 0 for the constant; ``names`` of the others: a column name,
    or a (column, category) pair."""

    names: list
    matrix: np.ndarray
    #: what the sums are about: a number a name (0 for one-hot columns); nothing for all 0
    shift: np.ndarray | None = None

    @property
    def about(self) -> np.ndarray:
        return np.zeros(len(self.names)) if self.shift is None else self.shift

    @property
    def count(self) -> float:
        return float(self.matrix[0, 0])

    def at(self, name) -> int:
        return 1 + self.names.index(name)

    def standardized(self) -> tuple[Sigma, np.ndarray, np.ndarray]:
        """Sums of products of z-scores (population deviation; a constant column counts as
        deviation 1), with means and deviations, the means about 0."""
        n = self.count
        mean = self.matrix[0, 1:] / n
        variance = np.diag(self.matrix)[1:] / n - mean**2
        scale = np.maximum(np.abs(np.diag(self.matrix)[1:]) / n, 1e-300)
        std = np.where(variance > 1e-14 * scale, np.sqrt(np.maximum(variance, 0)), 1.0)
        m = np.zeros_like(self.matrix)
        m[0, 0] = n
        m[1:, 1:] = (self.matrix[1:, 1:] - n * np.outer(mean, mean)) / np.outer(std, std)
        return Sigma(self.names, m), mean + self.about, std


def sigma(a: Cofactor, categories: dict[str, list] | None = None, skip: str | None = None) -> Sigma:
    """Dense matrix of a cofactor; ``skip`` leaves a categorical feature out."""
    cats = [c for c in a.cat if c != skip]
    categories = {c: v for c, v in (categories or dictionary([a], cats)).items() if c in cats}
    names = [*a.cont, *[(c, v) for c in cats for v in categories[c]]]
    at = {n: 1 + i for i, n in enumerate(names)}
    m = np.zeros((1 + len(names), 1 + len(names)))
    k = len(a.cont)
    m[0, 0] = a.count
    m[0, 1 : k + 1] = m[1 : k + 1, 0] = a.lin
    m[1 : k + 1, 1 : k + 1] = a.quad
    for c in cats:
        for v, s in a.by_cat[c].items():
            if (i := at.get((c, v))) is not None:
                m[i, i] = m[0, i] = m[i, 0] = s[0]
                m[i, 1 : k + 1] = m[1 : k + 1, i] = s[1:]
    for (c, d), counts in a.by_pair.items():
        for (v, w), n in counts.items():
            i, j = at.get((c, v)), at.get((d, w))
            if i is not None and j is not None:
                m[i, j] = m[j, i] = n
    return Sigma(names, m, np.append(a.shift, np.zeros(len(names) - k)) if a.shift.any() else None)


def class_sums(a: Cofactor, label: str, categories: dict[str, list]) -> dict:
    """Per class of a categorical label: [count, sums about the shift, one-hot sums]."""
    cats = [c for c in a.cat if c != label]
    out = {}
    for y in dictionary([a], [label])[label]:
        hot = []
        for c in cats:
            pair, turned = ((label, c), False) if (label, c) in a.by_pair else ((c, label), True)
            hot += [a.by_pair[pair].get((v, y) if turned else (y, v), 0.0) for v in categories[c]]
        out[y] = np.concatenate([a.by_cat[label][y], hot])
    return out
