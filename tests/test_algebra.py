import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from octolake.functions import octonion as O

numbers = st.lists(st.floats(-5, 5, allow_nan=False), min_size=8, max_size=8).map(np.array)


def quaternion(p, q):
    a, b = p, q
    return np.array([
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ])


def doubled(x, y):
    """The Cayley-Dickson product of pairs of quaternions, written apart from the table of lines."""
    conj = lambda q: q * np.array([1, -1, -1, -1])
    a, b, c, d = x[:4], x[4:], y[:4], y[4:]
    return np.concatenate([quaternion(a, c) - quaternion(conj(d), b), quaternion(d, a) + quaternion(b, conj(c))])


def test_table_is_cayley_dickson():
    for i in range(8):
        for j in range(8):
            expected = doubled(np.eye(8)[i], np.eye(8)[j])
            sign, k = O.basis_product(i, j)
            assert np.array_equal(expected, sign * np.eye(8)[k]), (i, j)
    assert len(O.STRUCTURE) == 64


@settings(max_examples=60, deadline=None)
@given(numbers, numbers, numbers)
def test_identities(x, y, z):
    mul = lambda a, b: np.array(O.multiply(a, b))
    assert np.isclose(np.linalg.norm(mul(x, y)), np.linalg.norm(x) * np.linalg.norm(y), atol=1e-6)
    assert np.allclose(mul(x, y), doubled(x, y), atol=1e-9)
    c = mul(x, y) - mul(y, x)
    assert np.allclose(c[1:], O.commutator(x, y), atol=1e-9) and abs(c[0]) < 1e-9
    assert np.allclose(O.associator(x, x, y), 0, atol=1e-7)  # alternative
    assert np.allclose(np.array(O.associator(x, y, z)), -np.array(O.associator(y, x, z)), atol=1e-7)
    assert np.isclose(O.squared_norm(x), (x * x).sum())
    assert np.allclose(mul(x, np.array(O.conjugate(x))), [(x * x).sum()] + [0] * 7, atol=1e-7)


@settings(max_examples=30, deadline=None)
@given(numbers, numbers)
def test_lines_add_up_to_the_commutator(x, y):
    total = np.zeros(8)
    for (a, b, c), (on_c, on_a, on_b) in zip(O.LINES, O.line_terms(x, y)):
        total[c] += 2 * on_c
        total[a] += 2 * on_a
        total[b] += 2 * on_b
    assert np.allclose(total[1:], O.commutator(x, y))
