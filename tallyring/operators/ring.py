"""Ring values on the driver: relation, cofactor and naive-Bayes aggregates.

A cofactor holds, for named continuous and categorical features, the sums that regression
and discriminant analysis need: row count, sums and sums of products of the continuous
features, counts per category, sums of each continuous feature per category, and counts per
pair of categories. Sums of rows are sums of cofactors; a join's cofactor is the sum over
keys of products. Names, not positions, tell features apart, so order never matters.

Sums may be taken about a shift of each continuous feature, as sums about 0 lose what varies in a
column whose values are far from 0. Shifts move exactly: sums about one are sums about another. The
ring's operations bring both sides to the shifts of the first; the text forms are about 0.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

Key = object


def _number(v: float, exact: bool) -> str:
    return repr(float(v)) if exact else f"{v:.6f}"


def _pack(key) -> int:
    """A composite key of two 32-bit codes as one number, the first in the low half."""
    return (key[0] & 0xFFFFFFFF) + (key[1] << 32) if isinstance(key, tuple) else key


def _entries(d: dict, exact: bool) -> str:
    return "{ " + ", ".join(f"{_pack(k)} -> {_number(v, exact)}" for k, v in d.items()) + " }" if d else "{ }"


_PAIR = re.compile(r"(-?\d+)\s*->\s*([^\s,}]+)")


class Relation(dict):
    """A sparse map from keys to numbers. ``+`` and ``-`` are keywise over the union of keys
    (keys that reach 0 stay unless ``prune``), ``*`` pairs every key of one with every key of
    the other."""

    @classmethod
    def lift(cls, key: int) -> Relation:
        return cls({key: 1.0})

    def __add__(self, other: Relation) -> Relation:
        out = Relation(self)
        for k, v in other.items():
            out[k] = out.get(k, 0.0) + v
        return out

    def __sub__(self, other: Relation) -> Relation:
        return self + other.scale(-1.0)

    def __mul__(self, other: Relation) -> Relation:
        first = lambda k: k[0] if isinstance(k, tuple) else k
        return Relation({(first(a), first(b)): x * y for a, x in self.items() for b, y in other.items()})

    def scale(self, by: float) -> Relation:
        return Relation({k: v * by for k, v in self.items()})

    def prune(self) -> Relation:
        return Relation({k: v for k, v in self.items() if v != 0})

    def to_text(self, exact: bool = True) -> str:
        return f"{len(self)}, {_entries(self, exact)}"

    @classmethod
    def from_text(cls, text: str) -> Relation:
        return cls({int(k): float(v) for k, v in _PAIR.findall(text)})


def _size(relations: list[dict]) -> int:
    return sum(8 + 16 * len(r) for r in relations)


def _same(a, b) -> None:
    if set(a.cont) != set(b.cont) or set(a.cat) != set(b.cat):
        raise ValueError(f"features differ: {a.cont} {a.cat} and {b.cont} {b.cat}")


def _further(names: list[str], taken: list[str]) -> dict[str, str]:
    """A name for each of ``names`` that none of ``taken`` has: itself, or with the next number."""
    out: dict[str, str] = {}
    for name in names:
        used, new, k = {*names, *taken, *out.values()}, name, 2
        while new in taken or new in out.values() or (new != name and new in used):
            new, k = f"{name}_{k}", k + 1
        out[name] = new
    return out


def _blend(a: dict, b: dict, sign: int) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = out[k] + sign * v if k in out else sign * v
    return out


@dataclass
class Cofactor:
    cont: list[str]
    cat: list[str]
    count: int = 0
    lin: np.ndarray | None = None
    quad: np.ndarray | None = None
    #: per categorical feature: category -> [count, sum of each continuous feature]
    by_cat: dict[str, dict[Key, np.ndarray]] = field(default_factory=dict)
    #: per pair of categorical features (in order of ``cat``): (category, category) -> count
    by_pair: dict[tuple[str, str], dict[tuple, float]] = field(default_factory=dict)
    #: what was taken off each continuous feature before it was summed
    shift: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.cont)
        self.shift = np.zeros(n) if self.shift is None else np.asarray(self.shift, dtype=float)
        self.lin = np.zeros(n) if self.lin is None else np.asarray(self.lin, dtype=float)
        self.quad = np.zeros((n, n)) if self.quad is None else np.asarray(self.quad, dtype=float)
        for c in self.cat:
            self.by_cat.setdefault(c, {})
        for i, a in enumerate(self.cat):
            for b in self.cat[i + 1 :]:
                if (b, a) in self.by_pair:
                    self.by_pair[a, b] = {(y, x): v for (x, y), v in self.by_pair.pop((b, a)).items()}
                self.by_pair.setdefault((a, b), {})

    # lifts
    @classmethod
    def const(cls, n: int) -> Cofactor:
        return cls([], [], n)

    @classmethod
    def lift(cls, cont: dict[str, float], cat: dict[str, Key] | None = None) -> Cofactor:
        cat, x = cat or {}, np.array(list(cont.values()), dtype=float)
        if any(v is None for v in [*cont.values(), *cat.values()]):
            raise ValueError("a feature is null")
        names = list(cat)
        pairs = {(a, b): {(cat[a], cat[b]): 1.0} for i, a in enumerate(names) for b in names[i + 1 :]}
        return cls(list(cont), names, 1, x, np.outer(x, x), {c: {v: np.append(1.0, x)} for c, v in cat.items()}, pairs)

    def about(self, shift: Sequence[float] | float = 0.0) -> Cofactor:
        """The same value as sums about another shift."""
        shift = np.broadcast_to(np.asarray(shift, dtype=float), self.shift.shape)
        d = shift - self.shift
        if not d.any():
            return self
        cross = np.outer(d, self.lin)
        quad = self.quad - cross - cross.T + self.count * np.outer(d, d)
        by_cat = {c: {k: np.append(v[0], v[1:] - v[0] * d) for k, v in by.items()} for c, by in self.by_cat.items()}
        return Cofactor(self.cont, self.cat, self.count, self.lin - self.count * d, quad, by_cat, self.by_pair, shift)

    def aligned(self, like: Cofactor) -> Cofactor:
        """The same value with features in another's order."""
        _same(self, like)
        if self.cont == like.cont and self.cat == like.cat:
            return self
        at = [self.cont.index(c) for c in like.cont]
        wide = [0, *[1 + i for i in at]]
        pairs = {k: dict(v) for k, v in self.by_pair.items()}
        return Cofactor(list(like.cont), list(like.cat), self.count, self.lin[at], self.quad[np.ix_(at, at)], {c: {k: v[wide] for k, v in self.by_cat[c].items()} for c in like.cat}, pairs, self.shift[at])

    def beside(self, other: Cofactor) -> Cofactor:
        """The same value with other names for features that ``other`` has in the same role: a
        feature that a product names twice is x and x_2. One column may be continuous and
        categorical."""
        x, k = _further(self.cont, other.cont), _further(self.cat, other.cat)
        return Cofactor([x[c] for c in self.cont], [k[c] for c in self.cat], self.count, self.lin, self.quad, {k[c]: d for c, d in self.by_cat.items()}, {(k[a], k[b]): d for (a, b), d in self.by_pair.items()}, self.shift)

    def _combine(self, other: Cofactor, sign: int) -> Cofactor:
        b = other.aligned(self).about(self.shift)
        return Cofactor(self.cont, self.cat, self.count + sign * b.count, self.lin + sign * b.lin, self.quad + sign * b.quad, {c: _blend(self.by_cat[c], b.by_cat[c], sign) for c in self.cat}, {p: _blend(self.by_pair[p], b.by_pair[p], sign) for p in self.by_pair}, self.shift)

    def __add__(self, other: Cofactor) -> Cofactor:
        return self._combine(other, 1)

    def __sub__(self, other: Cofactor) -> Cofactor:
        return self._combine(other, -1)

    def __mul__(self, other: Cofactor) -> Cofactor:
        a, b = self, other.beside(self)
        cross = np.outer(a.lin, b.lin)
        quad = np.block([[a.quad * b.count, cross], [cross.T, b.quad * a.count]])
        by_cat = {c: {k: np.concatenate([[v[0] * b.count], v[1:] * b.count, v[0] * b.lin]) for k, v in a.by_cat[c].items()} for c in a.cat}
        by_cat |= {c: {k: np.concatenate([[v[0] * a.count], v[0] * a.lin, v[1:] * a.count]) for k, v in b.by_cat[c].items()} for c in b.cat}
        pairs = {p: {k: v * b.count for k, v in d.items()} for p, d in a.by_pair.items()}
        pairs |= {p: {k: v * a.count for k, v in d.items()} for p, d in b.by_pair.items()}
        for x in a.cat:
            for y in b.cat:
                pairs[x, y] = {(i, j): u[0] * v[0] for i, u in a.by_cat[x].items() for j, v in b.by_cat[y].items()}
        return Cofactor([*a.cont, *b.cont], [*a.cat, *b.cat], a.count * b.count, np.concatenate([a.lin * b.count, b.lin * a.count]), quad, by_cat, pairs, np.concatenate([a.shift, b.shift]))

    def scale(self, by: int) -> Cofactor:
        return self * Cofactor.const(by)

    def prune(self) -> Cofactor:
        """Without categories whose count is 0, as differences leave them."""
        return Cofactor(self.cont, self.cat, self.count, self.lin, self.quad, {c: {k: v for k, v in d.items() if round(v[0]) != 0} for c, d in self.by_cat.items()}, {p: {k: v for k, v in d.items() if round(v) != 0} for p, d in self.by_pair.items()}, self.shift)

    # packed forms, about 0
    def scalars(self) -> list[float]:
        a = self.about()
        return [*a.lin, *a.quad[np.triu_indices(len(a.cont))]]

    def relations(self) -> list[dict]:
        """Counts per category; sums per category, continuous features outermost; pair counts."""
        out = [{k: v[0] for k, v in self.by_cat[c].items()} for c in self.cat]
        out += [{k: v[1 + i] for k, v in self.about().by_cat[c].items()} for i in range(len(self.cont)) for c in self.cat]
        return out + [self.by_pair[a, b] for i, a in enumerate(self.cat) for b in self.cat[i + 1 :]]

    def to_text(self, exact: bool = True) -> str:
        return _text(self, self.scalars(), exact)

    @classmethod
    def from_text(cls, text: str, cont: list[str] | None = None, cat: list[str] | None = None) -> Cofactor:
        n, m, count, scalars, relations = _parse(text)
        cont, cat = cont or [f"x{i}" for i in range(n)], cat or [f"c{i}" for i in range(m)]
        quad = np.zeros((n, n))
        quad[np.triu_indices(n)] = scalars[n:]
        quad = quad + np.triu(quad, 1).T
        by_cat = {c: {k: np.array([v, *[relations[m + i * m + j].get(k, 0.0) for i in range(n)]]) for k, v in relations[j].items()} for j, c in enumerate(cat)}
        rest = iter(relations[m + n * m :])
        pairs = {(cat[i], cat[j]): {(k & 0xFFFFFFFF, k >> 32): v for k, v in next(rest).items()} for i in range(m) for j in range(i + 1, m)}
        return cls(cont, cat, count, np.array(scalars[:n]), quad, by_cat, pairs)

    def stats(self) -> dict[str, float]:
        """Least, most, mean and standard deviation of the relations' sizes."""
        sizes = np.array([len(r) for r in self.relations()] or [0])
        return {"relations": len(self.relations()), "min": float(sizes.min()), "max": float(sizes.max()), "avg": float(sizes.mean()), "stddev": float(sizes.std())}


@dataclass
class NBAggregates:
    """What naive Bayes needs of a class: count, sums and sums of squares, category counts."""

    cont: list[str]
    cat: list[str]
    count: int = 0
    lin: np.ndarray | None = None
    square: np.ndarray | None = None
    by_cat: dict[str, dict[Key, float]] = field(default_factory=dict)
    #: as of a cofactor
    shift: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.cont)
        self.shift = np.zeros(n) if self.shift is None else np.asarray(self.shift, dtype=float)
        self.lin = np.zeros(n) if self.lin is None else np.asarray(self.lin, dtype=float)
        self.square = np.zeros(n) if self.square is None else np.asarray(self.square, dtype=float)
        for c in self.cat:
            self.by_cat.setdefault(c, {})

    @classmethod
    def lift(cls, cont: dict[str, float], cat: dict[str, Key] | None = None) -> NBAggregates:
        x = np.array(list(cont.values()), dtype=float)
        return cls(list(cont), list(cat or {}), 1, x, x * x, {c: {v: 1.0} for c, v in (cat or {}).items()})

    def beside(self, other: NBAggregates) -> NBAggregates:
        """As :meth:`Cofactor.beside`."""
        x, k = _further(self.cont, other.cont), _further(self.cat, other.cat)
        return NBAggregates([x[c] for c in self.cont], [k[c] for c in self.cat], self.count, self.lin, self.square, {k[c]: d for c, d in self.by_cat.items()}, self.shift)

    def about(self, shift: Sequence[float] | float = 0.0) -> NBAggregates:
        """As :meth:`Cofactor.about`."""
        shift = np.broadcast_to(np.asarray(shift, dtype=float), self.shift.shape)
        d = shift - self.shift
        return NBAggregates(self.cont, self.cat, self.count, self.lin - self.count * d, self.square - 2 * d * self.lin + self.count * d * d, self.by_cat, shift) if d.any() else self

    def _combine(self, other: NBAggregates, sign: int) -> NBAggregates:
        _same(self, other)
        at = [other.cont.index(c) for c in self.cont]
        b = NBAggregates(self.cont, self.cat, other.count, other.lin[at], other.square[at], other.by_cat, other.shift[at]).about(self.shift)
        return NBAggregates(self.cont, self.cat, self.count + sign * b.count, self.lin + sign * b.lin, self.square + sign * b.square, {c: _blend(self.by_cat[c], b.by_cat[c], sign) for c in self.cat}, self.shift)

    def __add__(self, other: NBAggregates) -> NBAggregates:
        return self._combine(other, 1)

    def __sub__(self, other: NBAggregates) -> NBAggregates:
        return self._combine(other, -1)

    def __mul__(self, other: NBAggregates) -> NBAggregates:
        a, b = self, other.beside(self)
        by_cat = {c: {k: v * b.count for k, v in d.items()} for c, d in a.by_cat.items()} | {c: {k: v * a.count for k, v in d.items()} for c, d in b.by_cat.items()}
        return NBAggregates([*a.cont, *b.cont], [*a.cat, *b.cat], a.count * b.count, np.concatenate([a.lin * b.count, b.lin * a.count]), np.concatenate([a.square * b.count, b.square * a.count]), by_cat, np.concatenate([a.shift, b.shift]))

    def relations(self) -> list[dict]:
        return [self.by_cat[c] for c in self.cat]

    def to_text(self, exact: bool = True) -> str:
        a = self.about()
        return _text(a, [*a.lin, *a.square], exact)

    @classmethod
    def from_text(cls, text: str, cont: list[str] | None = None, cat: list[str] | None = None) -> NBAggregates:
        n, m, count, scalars, relations = _parse(text)
        cont, cat = cont or [f"x{i}" for i in range(n)], cat or [f"c{i}" for i in range(m)]
        return cls(cont, cat, count, np.array(scalars[:n]), np.array(scalars[n:]), dict(zip(cat, relations, strict=True)))


def _text(a, scalars: list[float], exact: bool) -> str:
    relations = a.relations()
    numbers = "[ " + ", ".join(_number(s, exact) for s in scalars) + " ]" if scalars else "[ ]"
    maps = "[ " + ", ".join(f"{len(r)}: {_entries(r, exact)}" for r in relations) + " ]" if relations else "[ ]"
    return f"{_size(relations)}, {len(a.cont)}, {len(a.cat)}, {a.count}, {numbers}, {maps}"


def _parse(text: str) -> tuple[int, int, int, list[float], list[dict]]:
    m = re.fullmatch(r"\s*\d+,\s*(\d+),\s*(\d+),\s*(-?\d+),\s*\[(.*?)\],\s*\[(.*)\]\s*", text, re.S)
    if m is None:
        raise ValueError("not the text of an aggregate")
    scalars = [float(x) for x in m[4].split(",") if x.strip()]
    relations = [{int(k): float(v) for k, v in _PAIR.findall(body)} for body in re.findall(r"\{([^}]*)\}", m[5])]
    return int(m[1]), int(m[2]), int(m[3]), scalars, relations
