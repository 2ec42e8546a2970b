"""Ring laws, hand-made values and text forms of the driver-side values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyring.operators.ring import Cofactor, NBAggregates, Relation

AB = [(2, 35), (4, 12), (3, 1), (4, 3)]


def total(values):
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def same(a: Cofactor, b: Cofactor) -> bool:
    a, b = a.prune().about(), b.aligned(a).prune().about()
    maps = all(a.by_cat[c].keys() == b.by_cat[c].keys() and all(np.allclose(v, b.by_cat[c][k]) for k, v in a.by_cat[c].items()) for c in a.cat)
    pairs = all({k: v for k, v in a.by_pair[p].items()} == pytest.approx(b.by_pair[p]) for p in a.by_pair)
    return a.count == b.count and np.allclose(a.lin, b.lin) and np.allclose(a.quad, b.quad) and maps and pairs


def test_relation_values():
    a, b = Relation.lift(2), Relation.lift(35)
    assert a.to_text(exact=False) == "1, { 2 -> 1.000000 }"
    assert a + b == {2: 1.0, 35: 1.0}
    assert a * b == {(2, 35): 1.0}
    assert (a * b).to_text(exact=False) == "1, { 150323855362 -> 1.000000 }"
    assert total([Relation.lift(x) for x, _ in AB]) == {2: 1.0, 4: 2.0, 3: 1.0}
    assert (a - a) == {2: 0.0} and (a - a).prune() == {}
    assert Relation.from_text(a.scale(2.5).to_text()) == {2: 2.5}


def test_cofactor_values():
    rows = [Cofactor.lift({"A": a, "B": b}) for a, b in AB]
    assert rows[0].scalars() == [2, 35, 4, 70, 1225]
    assert total(rows).to_text(exact=False) == "0, 2, 0, 4, [ 13.000000, 51.000000, 45.000000, 133.000000, 1379.000000 ], [ ]"
    mixed = Cofactor.lift({"A": 2, "B": 35}, {"a": 2, "b": 35})
    assert mixed.relations() == [{2: 1}, {35: 1}, {2: 2}, {35: 2}, {2: 35}, {35: 35}, {(2, 35): 1}]
    assert Cofactor.lift({}, {"a": 2}).to_text(exact=False) == "24, 0, 1, 1, [ ], [ 1: { 2 -> 1.000000 } ]"
    product = Cofactor.lift({"A": 2}) * Cofactor.lift({}, {"b": 35}) * Cofactor.const(333)
    assert product.to_text(exact=False) == "48, 1, 1, 333, [ 666.000000, 1332.000000 ], [ 1: { 35 -> 333.000000 }, 1: { 35 -> 666.000000 } ]"
    lifted = total([Cofactor.lift({"A": a}) * Cofactor.lift({"B": b}) for a, b in AB])
    assert same(lifted, total(rows))


def test_sigma_of_four_columns():
    from tallyring.operators.sigma import sigma

    rows = [(2, 35, 1, 4), (4, 12, 2, 9), (3, 1, 43, 0), (4, 3, 6, 9)]
    m = sigma(total([Cofactor.lift(dict(zip("ABCD", r, strict=True))) for r in rows])).matrix
    want = np.array([[4, 13, 51, 52, 22], [13, 45, 133, 163, 80], [51, 133, 1379, 120, 275], [52, 163, 120, 1890, 76], [22, 80, 275, 76, 178]])
    assert np.array_equal(m, want)


row = st.tuples(st.integers(-5, 5), st.integers(-5, 5), st.integers(0, 3), st.integers(0, 3))


def lifted(rows, left):
    if left:
        return total([Cofactor.lift({"x": float(a)}, {"c": c}) for a, _, c, _ in rows])
    return total([Cofactor.lift({"y": float(b)}, {"d": d}) for _, b, _, d in rows])


@settings(max_examples=40, deadline=None)
@given(st.lists(row, min_size=1, max_size=6), st.lists(row, min_size=1, max_size=6), st.lists(row, min_size=1, max_size=6))
def test_ring_laws(a, b, c):
    x, y, z = lifted(a, True), lifted(b, True), lifted(c, False)
    assert same((x + y) * z, x * z + y * z)
    assert same((x - y) + y, x)
    assert same(x * Cofactor.const(1), x)
    assert same(x * z, z * x)
    assert same(Cofactor.from_text(x.to_text(), x.cont, x.cat), x)
    joined = total([Cofactor.lift({"x": float(i[0]), "y": float(j[1])}, {"c": i[2], "d": j[3]}) for i in a for j in c])
    assert same(x * z, joined)


def test_nb_product_keeps_squares():
    a = NBAggregates.lift({"x": 3.0}, {"c": 1}) + NBAggregates.lift({"x": 4.0}, {"c": 2})
    b = NBAggregates.lift({"y": 5.0})
    p = a * b * NBAggregates([], [], 2)
    assert p.count == 4 and p.square.tolist() == [50.0, 100.0] and p.by_cat["c"] == {1: 2.0, 2: 2.0}
    assert (a - a).count == 0 and NBAggregates.from_text(a.to_text(), ["x"], ["c"]).lin.tolist() == [7.0]


def test_shapes_must_agree():
    with pytest.raises(ValueError):
        Cofactor.lift({"x": 1.0}) + Cofactor.lift({"y": 1.0})


def test_features_in_two_roles():
    """Products that name a column twice, and a column that is continuous and categorical."""
    rows = [Cofactor.lift({"A": a, "B": b}, {"A": a, "B": b}) for a, b in AB]
    assert rows[0].relations() == [{2: 1}, {35: 1}, {2: 2}, {35: 2}, {2: 35}, {35: 35}, {(2, 35): 1}]
    assert total(rows).by_cat["A"][4].tolist() == [2, 8, 15]
    cat, cont = (lambda n, v: Cofactor.lift({}, {n: v})), (lambda n, v: Cofactor.lift({n: v}))
    twice = total([cat("A", a) * cat("B", b) * cat("B", b) for a, b in AB])
    assert twice.cat == ["A", "B", "B_2"] and twice.by_pair["B", "B_2"] == {(b, b): 1.0 for _, b in AB}
    mixed = total([cont("A", a) * cat("B", b) * cont("B", b) * cat("A", a) for a, b in AB])
    assert same(mixed, total(rows))
    square = cont("x", 3.0) * cont("x", 3.0) * cont("x", 3.0)
    assert square.cont == ["x", "x_2", "x_3"] and square.quad.tolist() == [[9.0] * 3] * 3
    nb = NBAggregates.lift({"x": 3.0}, {"c": 1})
    assert (nb * nb).cont == ["x", "x_2"] and (nb * nb).by_cat == {"c": {1: 1.0}, "c_2": {1: 1.0}}
