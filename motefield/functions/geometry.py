"""Internal coordinates, Legendre polynomials, damping functions and affine moves as Columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def angle(u, v) -> Column:
    """Radians between two vectors; null where one has no length."""
    size = norm(u) * norm(v)
    return F.when(size > 0, F.acos(clamp(dot(u, v) / size)))


def dihedral(b1, b2, b3) -> Column:
    """Signed torsion in radians of three consecutive bond vectors."""
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(norm(b2) * dot(b1, n2), dot(n1, n2))


def legendre(order: int, x: Column) -> Column:
    """P_order by the three-term recurrence."""
    before, now = F.lit(1.0), x
    if order == 0:
        return before
    for n in range(1, order):
        before, now = now, ((2 * n + 1) * x * now - n * before) / (n + 1)
    return now


def real_harmonics(order: int, x: Column, y: Column, z: Column) -> list[Column]:
    """The 2l+1 real spherical harmonics of a unit vector, so that their squares sum to
    (2l+1)/4pi: associated Legendre recurrences times cos and sin of multiples of phi, all as
    polynomials in x, y, z."""
    # (x + iy)^m = a_m + i b_m carries the sin(theta)^m of the associated functions
    a, b = [F.lit(1.0)], [F.lit(0.0)]
    for _ in range(order):
        a, b = [*a, a[-1] * x - b[-1] * y], [*b, a[-1] * y + b[-1] * x]
    out = []
    for m in range(order + 1):
        double = float(math.prod(range(1, 2 * m, 2)))
        before, now = F.lit(0.0), F.lit(double)
        for n in range(m, order):
            before, now = now, ((2 * n + 1) * z * now - (n + m) * before) / (n - m + 1)
        scale = math.sqrt((2 * order + 1) / (4 * math.pi) * math.factorial(order - m) / math.factorial(order + m))
        if m == 0:
            out.append(now * scale)
        else:
            out += [now * a[m] * (scale * math.sqrt(2)), now * b[m] * (scale * math.sqrt(2))]
    return out


def thole(r: Column, screening: Column, alpha_i: Column, alpha_j: Column) -> Column:
    """1 - (1 + s r / 2) exp(-s r) with s = screening / (alpha_i alpha_j)^(1/6)."""
    s = screening / F.pow(alpha_i * alpha_j, F.lit(1 / 6))
    return 1 - (1 + s * r / 2) * F.exp(-s * r)


def tang_toennies(r: Column, b: float, order: int = 4, c: float = 1.0) -> Column:
    total, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, order + 1):
        term = term * (b * r) / k
        total = total + term
    return 1 - c * F.exp(-b * r) * total


def rb_to_opls(c0, c1, c2, c3, c4, c5) -> tuple[Column, ...]:
    """Fourier coefficients F1..F4 in kcal of Ryckaert-Bellemans ones in kJ; C5 must be 0."""
    kcal = 1 / 4.184
    bad = F.assert_true(c5 == 0, "C5 must be zero").isNull()
    return tuple(F.when(bad, x * kcal) for x in (-2 * c1 - 1.5 * c3, -c2 - c4, -0.5 * c3, -0.25 * c4))


def rotation_matrix(axis, degrees: float) -> np.ndarray:
    """Rotation about an axis, counter-clockwise as seen from its tip."""
    u = np.array(axis, dtype=float)
    u /= np.linalg.norm(u)
    t = math.radians(degrees)
    k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return np.eye(3) * math.cos(t) + math.sin(t) * k + (1 - math.cos(t)) * np.outer(u, u)


def affine(xyz, matrix=None, shift=(0.0, 0.0, 0.0), about=(0.0, 0.0, 0.0)):
    """matrix (xyz - about) + about + shift."""
    c = tuple(F.col(v) if isinstance(v, str) else v for v in xyz)
    m = np.eye(3) if matrix is None else np.array(matrix, dtype=float)
    rel = tuple(v - F.lit(float(o)) for v, o in zip(c, about, strict=True))
    return tuple(sum((F.lit(float(m[i][j])) * rel[j] for j in range(3)), F.lit(0.0)) + F.lit(float(about[i] + shift[i])) for i in range(3))
