"""Neighbourhood operators on dense cells ``row, col, v``: terrain derivatives, convolutions, box means.

The nine cells of each window come from strips of whole rows with a row of the strips beside them: one shuffle, and no
sort. What is computed from them are column expressions. Values are doubles inside, single precision on return.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid
from .kernels import by_strip

Kernel = Sequence[Sequence[float]]

#: Cells of a strip.
STRIP_CELLS = 1 << 17


def stored_value(value: Column) -> Column:
    single = value.cast("float")
    return F.when(~F.isnan(single), single)


def neighbours(cells: DataFrame, width: int, height: int, edge: bool = True, rows: int | None = None) -> DataFrame:
    """Add ``z0`` to ``z8`` (row by row from the north-west; z4 the cell itself) as doubles.

    ``edge``: beyond the border the nearest border cell counts; else it is null. The test is of the place, so a missing
    neighbour inside stays missing.
    """
    rows = rows or max(1, STRIP_CELLS // width)
    last = (height - 1) // rows
    first_strip = F.greatest(F.lit(0), F.floor((F.col("row") - 1) / rows).cast("int"))
    last_strip = F.least(F.lit(last), F.floor((F.col("row") + 1) / rows).cast("int"))
    dealt = cells.select("row", "col", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first_strip, last_strip)).alias("strip"))

    def run(table: pa.Table) -> pa.Table:
        begin = table.column("strip")[0].as_py() * rows
        end = min(height, begin + rows)
        block = np.full((end - begin + 2, width + 2), np.nan)
        row, col = np.asarray(table.column("row")).astype(np.int64), np.asarray(table.column("col")).astype(np.int64)
        block[row - begin + 1, col + 1] = table.column("v").to_numpy()
        if edge:
            if begin == 0:
                block[0] = block[1]
            if end == height:
                block[-1] = block[-2]
            block[:, 0], block[:, -1] = block[:, 1], block[:, -2]
        own = (row >= begin) & (row < end)
        r, c = row[own] - begin, col[own]
        parts = [block[r + i, c + j] for i in range(3) for j in range(3)]
        columns = [pa.array(row[own].astype(np.int32)), pa.array(col[own].astype(np.int32)), *(pa.array(x, mask=np.isnan(x)) for x in parts)]
        return pa.table(dict(zip(["row", "col", *(f"z{k}" for k in range(9))], columns, strict=True)))

    return dealt.groupBy("strip").applyInArrow(run, "row int, col int, " + ", ".join(f"z{k} double" for k in range(9)))


def z(k: int) -> Column:
    return F.col(f"z{k}")


def complete() -> Column:
    """All nine cells are there."""
    every = z(0).isNotNull()
    for k in range(1, 9):
        every = every & z(k).isNotNull()
    return every


def gradient(cell_x: float, cell_y: float) -> tuple[Column, Column]:
    """Horn's differences to the east and to the south."""
    return (
        ((z(2) + 2 * z(5) + z(8)) - (z(0) + 2 * z(3) + z(6))) / (8 * cell_x),
        ((z(6) + 2 * z(7) + z(8)) - (z(0) + 2 * z(1) + z(2))) / (8 * cell_y),
    )


def _result(near: DataFrame, value: Column) -> DataFrame:
    return near.select("row", "col", stored_value(F.when(complete(), value)).alias("v"))


def slope(near: DataFrame, cell_x: float = 1.0, cell_y: float = 1.0, percent: bool = False, z_factor: float = 1.0) -> DataFrame:
    gx, gy = gradient(cell_x, cell_y)
    rise = F.sqrt((z_factor * gx) * (z_factor * gx) + (z_factor * gy) * (z_factor * gy))
    return _result(near, rise * 100 if percent else F.atan(rise) * (180 / math.pi))


def aspect(near: DataFrame, cell_x: float = 1.0, cell_y: float = 1.0) -> DataFrame:
    """Degrees clockwise from north in which the surface falls; -1 where it is flat."""
    gx, gy = gradient(cell_x, cell_y)
    turn = 90.0 - F.atan2(gy, -gx) * (180 / math.pi)
    turn = F.when(turn < 0, turn + 360).when(turn >= 360, turn - 360).otherwise(turn)
    return _result(near, F.when((gx == 0) & (gy == 0), F.lit(-1.0)).otherwise(turn))


def shade(azimuth: float, altitude: float, cell_x: float, cell_y: float, z_factor: float) -> Column:
    gx, gy = gradient(cell_x, cell_y)
    gx, gy = z_factor * gx, z_factor * gy
    steep = F.atan(F.sqrt(gx * gx + gy * gy))
    facing = F.when((gx == 0) & (gy == 0), F.lit(0.0)).otherwise(F.atan2(-gx, gy))
    zenith, sun = math.radians(90 - altitude), math.radians(azimuth)
    lit = math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(F.lit(sun) - facing)
    return F.greatest(lit, F.lit(0.0)) * 255


def hillshade(near: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, cell_x: float = 1.0, cell_y: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    return _result(near, shade(azimuth, altitude, cell_x, cell_y, z_factor))


def multi_hillshade(near: DataFrame, altitude: float = 45.0, cell_x: float = 1.0, cell_y: float = 1.0, z_factor: float = 1.0, azimuths: Sequence[float] = (225.0, 270.0, 315.0, 360.0)) -> DataFrame:
    return _result(near, multi_shade(altitude, cell_x, cell_y, z_factor, azimuths))


def multi_shade(altitude: float, cell_x: float, cell_y: float, z_factor: float, azimuths: Sequence[float] = (225.0, 270.0, 315.0, 360.0)) -> Column:
    """The mean over several suns, each rounded to single precision first."""
    total = F.lit(0.0)
    for azimuth in azimuths:
        total = total + shade(azimuth, altitude, cell_x, cell_y, z_factor).cast("float").cast("double")
    return (total / len(azimuths)).cast("float")


def curvature(near: DataFrame, kind: str = "general", cell_x: float = 1.0, cell_y: float = 1.0) -> DataFrame:
    """Zevenbergen and Thorne's general, profile or plan curvature."""
    d = ((z(3) + z(5)) / 2 - z(4)) / (cell_x * cell_x)
    e = ((z(1) + z(7)) / 2 - z(4)) / (cell_y * cell_y)
    f = (-z(0) + z(2) + z(6) - z(8)) / (4 * cell_x * cell_y)
    g = (z(5) - z(3)) / (2 * cell_x)
    h = (z(1) - z(7)) / (2 * cell_y)
    if kind == "general":
        return _result(near, -2 * (d + e))
    square = g * g + h * h
    across = {"profile": d * g * g + e * h * h + f * g * h, "plan": d * h * h + e * g * g - f * g * h}[kind]
    safe = F.when(square < 1e-12, F.lit(1.0)).otherwise(square)
    return _result(near, F.when(square < 1e-12, -(d + e)).otherwise(-2 * across / safe))


def weighted_sum(kernel: Kernel, divisor: float = 1.0, offset: float = 0.0, fill: bool = True) -> Column:
    """The 3 x 3 weighted sum of ``convolve3`` in single precision."""
    total = F.lit(0.0)
    for k, w in enumerate(w for row in kernel for w in row):
        if w:
            total = total + (F.coalesce(z(k), z(4)) if fill else z(k)) * F.lit(float(w))
    return stored_value(F.when(z(4).isNotNull(), total / divisor + offset))


def convolve3(near: DataFrame, kernel: Kernel, divisor: float = 1.0, offset: float = 0.0, fill: bool = True) -> DataFrame:
    """A 3 x 3 weighted sum, divided and shifted. A missing neighbour takes the centre's value, or (not ``fill``) makes the
    result missing; cells of weight zero don't count. A missing centre stays missing."""
    return near.select("row", "col", weighted_sum(kernel, divisor, offset, fill).alias("v"))


MEAN3: Kernel = ((1, 1, 1), (1, 1, 1), (1, 1, 1))
SOBEL_X: Kernel = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y: Kernel = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
LAPLACE4: Kernel = ((0, -1, 0), (-1, 4, -1), (0, -1, 0))
LAPLACE8: Kernel = ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1))


def sharpen_kernel(amount: float = 1.0, size: int = 3) -> Kernel:
    n = size * size
    middle = size // 2
    return [[1 + amount - amount / n if (r, c) == (middle, middle) else -amount / n for c in range(size)] for r in range(size)]


def emboss_kernel(azimuth: float, size: int = 3) -> tuple[Kernel, float]:
    """Weights that rise towards the light, and the divisor."""
    turn = math.radians(azimuth)
    x, y = -math.sin(turn), math.cos(turn)
    most = max(abs(x), abs(y))
    x, y = (float(round(t / most)) if abs(t / most - round(t / most)) < 1e-9 else t / most for t in (x, y))
    half = size // 2
    kernel = [[dx * x + dy * y for dx in range(-half, half + 1)] for dy in range(-half, half + 1)]
    return kernel, most * sum(w * w for row in kernel for w in row)


def sobel(near: DataFrame) -> DataFrame:
    """The gradient's magnitude from the two Sobel sums (divided by 8), each rounded to single precision."""
    x, y = (weighted_sum(k, 8.0).cast("double") for k in (SOBEL_X, SOBEL_Y))
    return near.select("row", "col", stored_value(F.sqrt(x * x + y * y)).alias("v"))


def box_mean(cells: DataFrame, radius: int, grid: Grid) -> DataFrame:
    """The mean of valid cells within a square; a missing centre stays missing."""
    return weighted(cells, [1.0] * (2 * radius + 1), grid)


def gaussian(cells: DataFrame, sigma: float, grid: Grid) -> DataFrame:
    """Gaussian mean over ceil(3 sigma) cells each way, of valid cells in the raster; a missing centre stays missing."""
    radius = max(1, math.ceil(3 * sigma))
    return weighted(cells, [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)], grid)


def weighted(cells: DataFrame, weights: Sequence[float], grid: Grid, rows: int | None = None) -> DataFrame:
    """A separable weighted mean of valid cells: along rows, then along columns, sums and weights apart, by strips with a
    halo of the radius."""
    radius = len(weights) // 2

    def along(values: np.ndarray, axis: int) -> np.ndarray:
        out = np.zeros(values.shape)
        n = values.shape[axis]
        for k, w in zip(range(-radius, radius + 1), weights, strict=True):
            a, b = max(0, -k), min(n, n - k)
            if a < b:
                here, there = [slice(None)] * 2, [slice(None)] * 2
                here[axis], there[axis] = slice(a, b), slice(a + k, b + k)
                out[tuple(here)] += w * values[tuple(there)]
        return out

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        known = ~np.isnan(block)
        total, weight = (along(along(x, 1), 0) for x in (np.where(known, block, 0.0), known.astype(float)))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(known, total / weight, np.nan)[begin - low : end - low]

    return by_strip(cells, grid, radius, run, rows)
