"""Wide neighbourhoods by strips: blocks of rows with a halo, one Arrow batch and one NumPy kernel each.

A row goes to its own strip and to those whose halo holds it, so a result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid

#: Cells of a strip without its halo, about.
STRIP_CELLS = 1 << 20

#: (values with NaN for missing, row of the first, raster height, first and last row wanted) -> values of the rows wanted
Kernel = Callable[[np.ndarray, int, int, int, int], np.ndarray]


def by_strip(cells: DataFrame, grid: Grid, halo: int, kernel: Kernel, rows: int | None = None, factor: int = 1) -> DataFrame:
    """Apply a kernel to dense ``cells(row, col, v)``; it returns ``factor`` rows and columns for each wanted one."""
    rows = rows or max(1, STRIP_CELLS // grid.width)
    width, height = grid.width, grid.height
    last = (height - 1) // rows
    first_strip = F.greatest(F.lit(0), F.floor((F.col("row") - halo) / rows).cast("int"))
    last_strip = F.least(F.lit(last), F.floor((F.col("row") + halo) / rows).cast("int"))
    dealt = cells.select("row", "col", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first_strip, last_strip)).alias("strip"))

    def run(table: pa.Table) -> pa.Table:
        strip = table.column("strip")[0].as_py()
        begin, end = strip * rows, min(height, (strip + 1) * rows)
        low, high = max(0, begin - halo), min(height, end + halo)
        block = np.full((high - low, width), np.nan)
        block[np.asarray(table.column("row")) - low, np.asarray(table.column("col"))] = table.column("v").to_numpy()
        out = kernel(block, low, height, begin, end).astype(np.float32)
        r, c = np.divmod(np.arange(out.size), out.shape[1])
        flat = out.reshape(-1)
        return pa.table({"row": pa.array((r + begin * factor).astype(np.int32)), "col": pa.array(c.astype(np.int32)), "v": pa.array(flat, mask=np.isnan(flat))})

    return dealt.groupBy("strip").applyInArrow(run, "row int, col int, v float")


def convolve(cells: DataFrame, grid: Grid, weights: Sequence[Sequence[float]], divisor: float = 1.0, offset: float = 0.0, fill: bool = True, rows: int | None = None) -> DataFrame:
    """A weighted sum over an odd rectangle: nearest border cell beyond the edge, weight zero ignored, as in ``convolve3``."""
    kernel = np.array(weights, dtype=float)
    half_y, half_x = kernel.shape[0] // 2, kernel.shape[1] // 2
    if kernel.shape[0] % 2 == 0 or kernel.shape[1] % 2 == 0 or divisor == 0:
        raise ValueError("kernels have odd sides and a divisor other than zero")

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        at = np.arange(begin, end)
        centre = block[at - low]
        total = np.zeros_like(centre)
        columns = np.arange(block.shape[1])
        for i, j in zip(*np.nonzero(kernel), strict=True):
            part = block[np.clip(at + i - half_y, 0, height - 1) - low][:, np.clip(columns + j - half_x, 0, block.shape[1] - 1)]
            total += kernel[i, j] * (np.where(np.isnan(part), centre, part) if fill else part)
        return np.where(np.isnan(centre), np.nan, total / divisor + offset)

    return by_strip(cells, grid, half_y, run, rows)


def continued(values: np.ndarray, axis: int, front: bool) -> np.ndarray:
    """One sample beyond an edge, on the parabola through the three cells next to it (a line through two, one repeated)."""
    n = values.shape[axis]
    pick = lambda k: np.take(values, k if front else n - 1 - k, axis=axis)
    if n == 1:
        return pick(0)
    if n == 2:
        return 2 * pick(0) - pick(1)
    return 3 * pick(0) - 3 * pick(1) + pick(2)


def laplace(cells: DataFrame, grid: Grid, diagonals: bool = True, fill: bool = False, rows: int | None = None) -> DataFrame:
    """Four or eight times the centre less its neighbours; beyond the border the surface goes on as a parabola."""

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        at = np.arange(begin, end) - low
        centre = block[at]

        def around(values: np.ndarray) -> np.ndarray:
            wide = np.concatenate((continued(values, 1, True)[:, None], values, continued(values, 1, False)[:, None]), axis=1)
            top = continued(wide, 0, True)[None] if begin == 0 else None
            bottom = continued(wide, 0, False)[None] if end == height else None
            tall = np.concatenate([x for x in (top, wide, bottom) if x is not None])
            a = at + (top is not None)
            total = np.zeros_like(centre)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (diagonals or not (dy and dx)):
                        total += tall[a + dy][:, 1 + dx : 1 + dx + centre.shape[1]]
            return total

        count = 8 if diagonals else 4
        out = count * centre - around(block)
        if fill and np.isnan(block).any():
            for r, c in zip(*np.nonzero(np.isnan(out) & ~np.isnan(centre)), strict=True):  # where a neighbour is missing
                near = np.where(np.isnan(block), centre[r, c], block)
                lo, hi = max(0, int(at[r]) - 3), int(at[r]) + 4
                out[r, c] = run_filled(near, lo, hi, low, height, int(at[r]), int(c), count, diagonals)
        return np.where(np.isnan(centre), np.nan, out)

    return by_strip(cells, grid, 3, run, rows)


def run_filled(near: np.ndarray, lo: int, hi: int, low: int, height: int, r: int, c: int, count: int, diagonals: bool) -> float:
    """The Laplace sum of one cell whose missing neighbours were filled."""
    left, right = max(0, c - 3), min(near.shape[1], c + 4)
    part = near[lo:hi, left:right]
    r, c = r - lo, c - left
    rows, columns = [part], []
    if c == 0:
        columns.append(continued(part, 1, True)[:, None])
    columns.append(part)
    if left + part.shape[1] == near.shape[1] and c == part.shape[1] - 1:
        columns.append(continued(part, 1, False)[:, None])
    wide = np.concatenate(columns, axis=1)
    x = c + (c == 0)
    rows = [wide]
    if lo + low == 0 and r == 0:
        rows.insert(0, continued(wide, 0, True)[None])
    if lo + low + part.shape[0] == height and r == part.shape[0] - 1:
        rows.append(continued(wide, 0, False)[None])
    tall = np.concatenate(rows)
    y = r + (len(rows) > 1 and lo + low == 0 and r == 0)
    window = tall[y - 1 : y + 2, x - 1 : x + 2].copy()
    if not diagonals:
        window[::2, ::2] = 0
    return count * window[1, 1] - (window.sum() - window[1, 1])


def local_relief(cells: DataFrame, grid: Grid, radius: float, rows: int | None = None) -> DataFrame:
    """Value less the intercept of a Gaussian-weighted local line (sigma a third of the radius), along rows, then columns."""
    if radius < 1:
        raise ValueError("the radius is 1 cell at least")
    sigma = radius / 3
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]

    def intercept(values: np.ndarray, axis: int) -> np.ndarray:
        """Of the weighted least-squares line through each cell's known neighbours along an axis, at the cell itself."""
        padded = np.pad(values, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], constant_values=np.nan)
        weight, first, second, rise, moment = (np.zeros(values.shape) for _ in range(5))
        for k, w in zip(range(-reach, reach + 1), weights, strict=True):
            there = np.take(padded, np.arange(values.shape[axis]) + reach + k, axis=axis)
            known = ~np.isnan(there)
            over = np.where(known, there - values, 0.0)
            weight += known * w
            first += known * (w * k)
            second += known * (w * k * k)
            rise += over * w
            moment += over * (w * k)
        # normal equations: weight * b + first * m = rise, first * b + second * m = moment
        area = weight * second - first * first
        with np.errstate(divide="ignore", invalid="ignore"):
            return values + np.where(area > 1e-12 * weight * second, (rise * second - moment * first) / area, rise / weight)

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        trend = intercept(intercept(block, 1), 0)
        return (block - trend)[begin - low : end - low]

    return by_strip(cells, grid, reach, run, rows)


def tangent(before: np.ndarray, here: np.ndarray, after: np.ndarray, monotone: bool) -> np.ndarray:
    d = (after - before) / 2
    if not monotone:
        return d
    down, up = here - before, after - here
    limit = 3 * np.minimum(np.abs(down), np.abs(up))
    return np.where(down * up <= 0, 0.0, np.sign(d) * np.minimum(np.abs(d), limit))


def reflected(values: np.ndarray, axis: int, front: bool) -> np.ndarray:
    """Two samples beyond an edge, outermost first."""
    n = values.shape[axis]
    pick = lambda k: np.take(values, k if front else n - 1 - k, axis=axis)
    near = [2 * pick(0) - pick(min(k, n - 1)) for k in (2, 1)]
    return np.stack(near if front else near[::-1], axis=axis)


def extended(block: np.ndarray, low: int, height: int) -> tuple[np.ndarray, int]:
    """Whole rows from ``low`` on with two reflected cells beyond the raster's edges, and the number of the first row."""
    wide = np.concatenate((reflected(block, 1, True), block, reflected(block, 1, False)), axis=1)
    parts = [wide]
    if low == 0:
        parts.insert(0, reflected(wide, 0, True))
    if low + len(block) == height:
        parts.append(reflected(wide, 0, False))
    return np.concatenate(parts), low - (2 if low == 0 else 0)


def bezier_patch(z: dict[tuple[int, int], np.ndarray], u: np.ndarray | float, v: np.ndarray | float, tension: float, monotone: bool, strict: bool = False) -> np.ndarray:
    """Values at (u, v) of patches whose 4 x 4 nodes are z[-1..2, -1..2] (column, row)."""
    mix = lambda curved, straight: tension * curved + (1 - tension) * straight
    cross = z[1, 1] - z[1, 0] - z[0, 1] + z[0, 0]
    value = 0.0
    low = np.minimum(np.minimum(z[0, 0], z[1, 0]), np.minimum(z[0, 1], z[1, 1]))
    high = np.maximum(np.maximum(z[0, 0], z[1, 0]), np.maximum(z[0, 1], z[1, 1]))
    # Hermite form of the patch: a corner's value, two slopes and twist, each with its pair of cubic weights
    ends = lambda t: ((1 - t) ** 2 * (1 + 2 * t), t * t * (3 - 2 * t), t * (1 - t) ** 2, t * t * (t - 1))
    hu, hv = ends(u), ends(v)
    for a in (0, 1):
        for b in (0, 1):
            dx = mix(tangent(z[a - 1, b], z[a, b], z[a + 1, b], monotone), z[1, b] - z[0, b])
            dy = mix(tangent(z[a, b - 1], z[a, b], z[a, b + 1], monotone), z[a, 1] - z[a, 0])
            twist = 0.0 if monotone else (z[a + 1, b + 1] - z[a + 1, b - 1] - z[a - 1, b + 1] + z[a - 1, b - 1]) / 4
            value = value + z[a, b] * hu[a] * hv[b] + dx * hu[2 + a] * hv[b] + dy * hu[a] * hv[2 + b] + mix(twist, cross) * hu[2 + a] * hv[2 + b]
    if monotone:
        value = np.clip(value, low, high)
    whole = ~np.isnan(sum(z.values()))
    if strict:
        return np.where(whole, value, np.nan)
    corners, weights = [z[0, 0], z[1, 0], z[0, 1], z[1, 1]], [(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v]
    known = [~np.isnan(c) for c in corners]
    total = sum(np.where(k, w, 0.0) for k, w in zip(known, weights, strict=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        plain = sum(np.where(k, c * w, 0.0) for k, c, w in zip(known, corners, weights, strict=True)) / total
    return np.where(whole, value, plain)


def bezier_subdivide(cells: DataFrame, grid: Grid, factor: int = 4, tension: float = 1.0, monotone: bool = False, rows: int | None = None, strict: bool = False, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, Grid]:
    """``factor`` x ``factor`` cells for each, on bicubic patches through the cell centres.

    Tangents are central differences, blended with straight ones by the tension; ``monotone`` limits them and clamps a
    patch to its corners. Beyond the border the surface is reflected through it. Where a patch lacks a node, values are
    bilinear, or (``strict``) missing; a missing cell stays missing in all its parts. ``window`` (column, row, width,
    height): only these cells are subdivided, and only they and three more each way are read.
    """

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        g, top = extended(block, low, height)
        out = np.full(((end - begin) * factor, block.shape[1] * factor), np.nan)
        cols = np.arange(block.shape[1])
        own = np.arange(begin, end)
        for sy in range(factor):
            v = (sy + 0.5) / factor - 0.5
            py, ty = (own - 1, v + 1) if v < 0 else (own, v)
            for sx in range(factor):
                u = (sx + 0.5) / factor - 0.5
                px, tx = (cols - 1, u + 1) if u < 0 else (cols, u)
                z = {(a, b): g[(py + b - top)[:, None], (px + a + 2)[None, :]] for a in range(-1, 3) for b in range(-1, 3)}
                out[sy::factor, sx::factor] = bezier_patch(z, tx, ty, tension, monotone, strict)
        gaps = np.repeat(np.repeat(np.isnan(block[begin - low : end - low]), factor, axis=0), factor, axis=1)
        return np.where(gaps, np.nan, out)

    fine = Grid(grid.width * factor, grid.height * factor, grid.a, grid.b / factor, grid.c / factor, grid.d, grid.e / factor, grid.f / factor)
    if window is None:
        return by_strip(cells, grid, 3, run, rows, factor), fine
    x, y, width, height = window
    if not (0 <= x and 0 <= y and width > 0 and height > 0 and x + width <= grid.width and y + height <= grid.height):
        raise ValueError("the window lies within the raster")
    near = cells.where(F.col("row").between(y - 3, y + height + 2) & F.col("col").between(x - 3, x + width + 2))
    made = by_strip(near, grid, 3, run, rows, factor).where(F.col("row").between(y * factor, (y + height) * factor - 1) & F.col("col").between(x * factor, (x + width) * factor - 1))
    return made.select((F.col("row") - y * factor).alias("row"), (F.col("col") - x * factor).alias("col"), "v"), fine.window(x * factor, y * factor, width * factor, height * factor)


def bezier(points: DataFrame, cells: DataFrame, grid: Grid, tension: float = 1.0, monotone: bool = False, strict: bool = False, rows: int | None = None) -> DataFrame:
    """``id, value`` of the bicubic surface of ``bezier_subdivide`` at pixel coordinates ``points(id, x, y)``; null outside.

    Points meet the strip of rows that they lie in: one shuffle of each side, whatever the number of points.
    """
    rows = rows or max(1, STRIP_CELLS // grid.width)
    width, height = grid.width, grid.height
    last = (height - 1) // rows
    strip = lambda row: F.least(F.greatest(F.floor(row / rows), F.lit(0)), F.lit(last)).cast("int")
    inside = (F.col("x") >= 0) & (F.col("x") <= width) & (F.col("y") >= 0) & (F.col("y") <= height)
    asked = points.where(inside).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), strip(F.floor(F.col("y") - 0.5)).alias("strip"))
    dealt = cells.select("row", "col", F.col("v").cast("double").alias("v"), F.explode(F.sequence(strip(F.col("row") - 3), strip(F.col("row") + 3))).alias("strip"))

    def run(places: pa.Table, table: pa.Table) -> pa.Table:
        ids = places.column("id")
        if not len(places):
            return pa.table({"id": ids, "value": pa.array([], pa.float64())})
        begin = places.column("strip")[0].as_py() * rows
        low, high = max(0, begin - 3), min(height, begin + rows + 3)
        block = np.full((high - low, width), np.nan)
        block[np.asarray(table.column("row")) - low, np.asarray(table.column("col"))] = table.column("v").to_numpy()
        g, top = extended(block, low, height)
        u, v = places.column("x").to_numpy() - 0.5, places.column("y").to_numpy() - 0.5
        px, py = np.clip(np.floor(u), -1, width - 1).astype(np.int64), np.clip(np.floor(v), -1, height - 1).astype(np.int64)
        z = {(a, b): g[py + b - top, px + a + 2] for a in range(-1, 3) for b in range(-1, 3)}
        value = bezier_patch(z, np.clip(u - px, 0.0, 1.0), np.clip(v - py, 0.0, 1.0), tension, monotone, strict)
        return pa.table({"id": ids, "value": pa.array(value, mask=np.isnan(value))})

    found = asked.groupBy("strip").cogroup(dealt.groupBy("strip")).applyInArrow(run, "id long, value double")
    return points.select(F.col("id").cast("long").alias("id")).join(found, "id", "left")
