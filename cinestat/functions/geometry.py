"""Plane, line and point arithmetic on columns.

A vector is a Python list of three columns, so that every expression stays flat
arithmetic inside whole-stage codegen.  A plane is ``Plane(row, col, pos, spacing)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

Vec = list[Column]


def vec(struct: Column, *names: str) -> Vec:
    return [struct[n] for n in names]


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, k: Column) -> Vec:
    return [x * k for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


@dataclass
class Plane:
    """Oriented image plane; ``spacing`` holds the pixel size along row and column.

    ``pack`` turns a plane into a struct column that carries its normal; project it
    and read it back with ``unpack``, so that later formulas stay short.
    """

    row: Vec
    col: Vec
    pos: Vec
    spacing: list[Column]
    known_normal: Vec | None = None

    @property
    def normal(self) -> Vec:
        return self.known_normal or cross(self.row, self.col)

    def pack(self) -> Column:
        named = {"r": self.row, "c": self.col, "p": self.pos, "n": self.normal, "s": self.spacing[:2]}
        return F.struct(*[v.alias(f"{k}{i}") for k, vs in named.items() for i, v in enumerate(vs)])

    @staticmethod
    def unpack(packed: Column) -> Plane:
        r, c, p, n = ([packed[f"{k}{i}"] for i in range(3)] for k in "rcpn")
        return Plane(r, c, p, [packed["s0"], packed["s1"]], n)

    @property
    def axes(self) -> tuple[Vec, Vec, Vec]:
        """Columns of the image-to-space matrix."""
        sx, sy = self.spacing[0], self.spacing[1]
        return scale(self.row, sx), scale(self.col, sy), scale(self.normal, sx)

    def distance(self, p: Vec) -> Column:
        return F.abs(dot(self.normal, sub(p, self.pos)))

    def to_space(self, x: Column, y: Column) -> Vec:
        a, b, _ = self.axes
        return add(self.pos, add(scale(a, x), scale(b, y)))

    def to_image(self, p: Vec) -> list[Column]:
        """Inverse of the 3x3 matrix by cofactors; NULL when it is singular."""
        a, b, c = self.axes
        d = sub(p, self.pos)
        det = dot(a, cross(b, c))
        return [F.try_divide(dot(d, cross(b, c)), det), F.try_divide(dot(d, cross(c, a)), det)]

    def angle_to_z(self) -> Column:
        n = self.normal
        return F.degrees(F.acos(F.try_divide(n[2], F.sqrt(dot(n, n)))))


def plane_line(p: Plane, q: Plane) -> tuple[Vec, Vec]:
    """Line of two planes as (point, direction); NULL point for parallel planes."""
    n1, n2 = p.normal, q.normal
    d1, d2 = dot(n1, p.pos), dot(n2, q.pos)
    a, b, m = dot(n1, n1), dot(n2, n2), dot(n1, n2)
    det = a * b - m * m
    c1 = F.try_divide(d1 * b - d2 * m, det)
    c2 = F.try_divide(d2 * a - d1 * m, det)
    return add(scale(n1, c1), scale(n2, c2)), cross(n1, n2)


def affine(m: list[list[Column]], x: Column, y: Column) -> list[Column]:
    """2x3 matrix applied to a point."""
    return [row[0] * x + row[1] * y + row[2] for row in m]


def rotation_about(angle_deg: Column, cx: Column, cy: Column) -> list[list[Column]]:
    """2x3 matrix of a rotation about a point (image axes: y grows downward)."""
    a, b = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    one = F.lit(1.0)
    return [[a, b, (one - a) * cx - b * cy], [-b, a, b * cx + (one - a) * cy]]


def rect_intersection(a: list[Column], b: list[Column]) -> list[Column]:
    """Overlap of two ``(x, y, w, h)`` boxes; zero size when they are apart."""
    x = F.greatest(a[0], b[0])
    y = F.greatest(a[1], b[1])
    w = F.greatest(F.least(a[0] + a[2], b[0] + b[2]) - x, F.lit(0))
    h = F.greatest(F.least(a[1] + a[3], b[1] + b[3]) - y, F.lit(0))
    return [x, y, w, h]


def rect_contains(r: list[Column], x: Column, y: Column) -> Column:
    """Half-open containment of a point."""
    return (x >= r[0]) & (x < r[0] + r[2]) & (y >= r[1]) & (y < r[1] + r[3])
