"""Periodic boxes as Column builders: wrapping, images, fractional coordinates, distances.

A box is a 3x3 matrix whose columns are the lattice vectors, an origin and a flag for each
periodic axis. Everything here is an expression for Catalyst; a box without volume is free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def _cols(xyz) -> Triple:
    return tuple(F.col(c) if isinstance(c, str) else c for c in xyz)


@dataclass(frozen=True)
class Box:
    """``matrix`` rows are x, y, z; its columns are the lattice vectors a, b, c."""

    matrix: tuple[tuple[float, float, float], ...]
    pbc: tuple[bool, bool, bool] = (True, True, True)
    origin: tuple[float, float, float] = field(default=(0.0, 0.0, 0.0))

    @staticmethod
    def orthogonal(lx: float, ly: float, lz: float, pbc=(True, True, True), origin=(0.0, 0.0, 0.0)) -> Box:
        return Box(((lx, 0.0, 0.0), (0.0, ly, 0.0), (0.0, 0.0, lz)), tuple(pbc), tuple(origin))

    @staticmethod
    def cubic(edge: float, **more) -> Box:
        return Box.orthogonal(edge, edge, edge, **more)

    @staticmethod
    def triclinic(lengths, tilts, **more) -> Box:
        (lx, ly, lz), (xy, xz, yz) = lengths, tilts
        return Box(((lx, xy, xz), (0.0, ly, yz), (0.0, 0.0, lz)), **more)

    @staticmethod
    def from_lengths_angles(lengths, angles, **more) -> Box:
        """Edge lengths and the angles alpha, beta, gamma in degrees."""
        a, b, c = lengths
        ca, cb, cg = (math.cos(math.radians(x)) for x in angles)
        sg = math.sqrt(1 - cg * cg)
        yz = c * (ca - cb * cg) / sg
        return Box(((a, b * cg, c * cb), (0.0, b * sg, yz), (0.0, 0.0, math.sqrt(max(0.0, c * c - (c * cb) ** 2 - yz**2)))), **more)

    @staticmethod
    def from_bounds(low, high, **more) -> Box:
        return Box.orthogonal(*(float(h - l) for l, h in zip(low, high, strict=True)), origin=tuple(map(float, low)), **more)

    @property
    def volume(self) -> float:
        return abs(float(np.linalg.det(np.array(self.matrix))))

    @property
    def style(self) -> str:
        m = np.array(self.matrix)
        if not m.any():
            return "free"
        return "orthogonal" if not (m - np.diag(np.diag(m))).any() else "triclinic"

    @property
    def lengths(self) -> tuple[float, ...]:
        return tuple(float(x) for x in np.linalg.norm(np.array(self.matrix), axis=0))

    @property
    def angles(self) -> tuple[float, ...]:
        m, n = np.array(self.matrix), np.array(self.lengths)
        cosine = lambda i, j: float(np.clip(m[:, i] @ m[:, j] / (n[i] * n[j]), -1, 1))
        return tuple(math.degrees(math.acos(cosine(i, j))) for i, j in ((1, 2), (0, 2), (0, 1)))

    @property
    def tilts(self) -> tuple[float, float, float]:
        return self.matrix[0][1], self.matrix[0][2], self.matrix[1][2]

    @property
    def face_distances(self) -> tuple[float, ...]:
        """Distances between opposite faces, which bound the cutoff of the minimum image."""
        m = np.array(self.matrix)
        return tuple(self.volume / float(np.linalg.norm(np.cross(m[:, (k + 1) % 3], m[:, (k + 2) % 3]))) for k in range(3))

    def _linear(self, m: np.ndarray, xyz: Triple) -> Triple:
        out = []
        for row in m:
            terms = [F.lit(float(v)) * c for v, c in zip(row, xyz, strict=True) if v]
            total = terms[0] if terms else F.lit(0.0)
            for t in terms[1:]:
                total = total + t
            out.append(total)
        return tuple(out)

    def fractional(self, xyz) -> Triple:
        x = _cols(xyz)
        moved = tuple(c - F.lit(o) if o else c for c, o in zip(x, self.origin, strict=True))
        if self.style == "orthogonal":
            return tuple(c / F.lit(self.matrix[k][k]) for k, c in enumerate(moved))
        return self._linear(np.linalg.inv(np.array(self.matrix)), moved)

    def absolute(self, frac) -> Triple:
        found = self._linear(np.array(self.matrix), _cols(frac))
        return tuple(c + F.lit(o) if o else c for c, o in zip(found, self.origin, strict=True))

    def images(self, xyz) -> Triple:
        """Which copy of the box a point lies in; 0 along free axes."""
        if self.style == "free":
            return (F.lit(0).cast("long"),) * 3
        return tuple(F.floor(f) if p else F.lit(0).cast("long") for f, p in zip(self.fractional(xyz), self.pbc, strict=True))

    def unwrap(self, xyz, images) -> Triple:
        shift = self._linear(np.array(self.matrix), tuple(c.cast("double") for c in _cols(images)))
        return tuple(c + s for c, s in zip(_cols(xyz), shift, strict=True))

    def wrap(self, xyz) -> Triple:
        """The point's copy inside the box; a free box leaves it."""
        x = _cols(xyz)
        if self.style == "free":
            return x
        back = tuple(-i for i in self.images(x))
        return self.unwrap(x, back)

    def contains(self, xyz) -> Column:
        inside = F.lit(True)
        for f in self.fractional(xyz):
            inside = inside & (f >= 0) & (f <= 1)
        return inside

    def minimum_image(self, dxyz) -> Triple:
        """The shortest copy of a difference of two points."""
        d = _cols(dxyz)
        if self.style == "free":
            return d
        if self.style == "orthogonal":
            return tuple(c - F.lit(self.matrix[k][k]) * F.rint(c / F.lit(self.matrix[k][k])) if self.pbc[k] else c for k, c in enumerate(d))
        frac = self._linear(np.linalg.inv(np.array(self.matrix)), d)
        back = tuple(F.rint(f) if p else F.lit(0.0) for f, p in zip(frac, self.pbc, strict=True))
        return tuple(c - s for c, s in zip(d, self._linear(np.array(self.matrix), back), strict=True))

    def distance(self, a, b) -> Column:
        dx, dy, dz = self.minimum_image(tuple(p - q for p, q in zip(_cols(a), _cols(b), strict=True)))
        return F.sqrt(dx * dx + dy * dy + dz * dz)
