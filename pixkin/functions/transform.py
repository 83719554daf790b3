"""The separable cosine transform as column expressions: a product with a constant matrix on either side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pixkin.functions.imaging import dct_matrix


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once: named in a lambda, a column would be for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dot(row: Column, weights: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(row, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def by_rows(rows: Column, matrix: np.ndarray) -> Column:
    """rows: an array of n-arrays; matrix: m x n.  Each row times the matrix's transpose, an array of m-arrays."""
    return F.transform(rows, lambda row: F.array(*[_dot(row, w) for w in matrix]))


def transposed(rows: Column, width: int) -> Column:
    column = lambda j: F.transform(rows, lambda row: F.get(row, F.lit(j)))
    return F.array(*[column(j) for j in range(width)])


def split_rows(flat: Column, height: int, width: int) -> Column:
    """The rows of a picture that is given row after row."""
    return F.array(*[F.slice(flat, i * width + 1, width) for i in range(height)])


def dct2(rows: Column, height: int, width: int) -> Column:
    """The two-dimensional DCT-II of a picture, transposed: coefficient (u, v) is in row v, column u."""
    return let(by_rows(rows, dct_matrix(width)), lambda half: by_rows(transposed(half, width), dct_matrix(height)))


def band_energies(rows: Column, side: int) -> Column:
    """Shares of the power in the low quarter, in what is neither, and in the high half of the spectrum."""
    power = lambda part: F.aggregate(F.flatten(part), F.lit(0.0), lambda a, x: a + x * x)
    corner = lambda r, first, n: F.transform(F.slice(r, first, n), lambda row: F.slice(row, first, n))
    parts = lambda r: F.array(power(corner(r, 1, side // 4)), power(corner(r, side // 2 + 1, side - side // 2)), power(r) + 1e-9)
    share = lambda p: F.array(p[0] / p[2], (p[2] - p[0] - p[1]) / p[2], p[1] / p[2])
    return let(rows, lambda r: let(parts(r), share))
