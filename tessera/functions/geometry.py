"""Calibrated projection, ground grids and plane homographies as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points nearer or farther than this (metres ahead of the sensor) are not projected.
NEAR, FAR = 5.0, 80.0


def linear(coefficients: Sequence[float], *terms: Column) -> Column:
    """c0*t0 + c1*t1 + ... + c_last (a last coefficient without a term is the constant)."""
    out = F.lit(float(coefficients[0])) * terms[0]
    for c, t in zip(coefficients[1 : len(terms)], terms[1:], strict=True):
        out = out + F.lit(float(c)) * t
    return out + F.lit(float(coefficients[len(terms)])) if len(coefficients) > len(terms) else out


def fuse(*matrices: Sequence[Sequence[float]]) -> list[list[float]]:
    """The product of calibration matrices, padded to 4x4, as the 3x4 matrix that one projection needs."""
    out = np.eye(4)
    for m in matrices:
        m = np.asarray(m, float)
        full = np.eye(4)
        full[: m.shape[0], : m.shape[1]] = m
        out = out @ full
    return out[:3].tolist()


def project(matrix: Sequence[Sequence[float]], x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Image column and row of a point, truncated towards zero, so that (-1, 0) lands in 0."""
    u, v, w = (linear(row, x, y, z) for row in matrix)
    return F.try_divide(u, w).cast("int"), F.try_divide(v, w).cast("int")


def plane(matrix: Sequence[Sequence[float]], x: Column, z: Column) -> tuple[Column, Column]:
    """Dehomogenised 3x3 map of a ground point."""
    u, v, w = (linear(row, x, z) for row in matrix)
    return F.try_divide(u, w), F.try_divide(v, w)


def grid_cell(x: Column, y: Column, size: int = 800, cell: float = 0.2) -> tuple[Column, Column]:
    """Cell of a ground grid whose middle is the sensor."""
    half = size // 2
    return (F.lit(float(half)) - y / cell).cast("int"), (F.lit(float(half)) - x / cell).cast("int")


class BirdsEye:
    """Metric region and resolution of a bird's-eye view."""

    def __init__(self, res: float = 0.05, x: tuple[float, float] = (-10.0, 10.0), z: tuple[float, float] = (6.0, 46.0)):
        self.res, self.x, self.z = res, x, z
        self.rows, self.cols = round((z[1] - z[0]) / res), round((x[1] - x[0]) / res)

    def to_pixel(self, x: Column, z: Column) -> tuple[Column, Column]:
        """(column, row); rows grow towards the sensor."""
        return (x - self.x[0]) / self.res, F.lit(float(self.rows)) - (z - self.z[0]) / self.res

    def to_metric(self, col: Column, row: Column) -> tuple[Column, Column]:
        return col * self.res + self.x[0], (F.lit(float(self.rows)) - row) * self.res + self.z[0]

    def centre(self, col: Column, row: Column) -> tuple[Column, Column]:
        """Metric centre of a cell, rows counted from the far edge."""
        return col * self.res + (self.x[0] + self.res / 2), F.lit(self.z[1] - self.res / 2) - row * self.res
