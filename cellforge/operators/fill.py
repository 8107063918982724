"""Gap filling within the convex hull of the valid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid
from .kernels import by_strip

Point = tuple[float, float]


def convex_hull(points: list[Point]) -> list[Point]:
    """Counter-clockwise from the lowest of the leftmost; points on an edge are left out; fewer than three come sorted."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(order: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return chain(points)[:-1] + chain(points[::-1])[:-1]


def hull_rows(cells: DataFrame) -> DataFrame:
    """``row, first, last``: the columns that the hull of valid cells covers in each row.

    Only the first and last valid cell of each row matter: two integers a row are brought together, not the raster.
    """
    ends = cells.where(F.col("v").isNotNull()).groupBy("row").agg(F.min("col").alias("a"), F.max("col").alias("b")).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = []
        for batch in batches:
            r = batch.column("row").to_pylist()
            points += zip(batch.column("a").to_pylist(), r, strict=True)
            points += zip(batch.column("b").to_pylist(), r, strict=True)
        hull = convex_hull(points)
        if not hull:
            return
        top = min(y for _, y in hull)
        n = max(y for _, y in hull) - top + 1
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        for (x0, y0), (x1, y1) in zip(hull, [*hull[1:], hull[0]], strict=True):
            rows = np.arange(min(y0, y1), max(y0, y1) + 1)
            xs = [x0 + (rows - y0) / (y1 - y0) * (x1 - x0)] if y0 != y1 else [np.array([x0]), np.array([x1])]
            for x in xs:
                low[rows - top] = np.minimum(low[rows - top], x)
                high[rows - top] = np.maximum(high[rows - top], x)
        yield pa.record_batch([pa.array((np.arange(n) + top).astype(np.int32)), pa.array(np.floor(low).astype(np.int32)), pa.array(np.ceil(high).astype(np.int32))], names=["row", "first", "last"])

    return ends.mapInArrow(run, "row int, first int, last int")


def gaps_in_hull(cells: DataFrame) -> DataFrame:
    """``n``: missing cells within the hull."""
    spans = hull_rows(cells)
    return cells.where(F.col("v").isNull()).join(spans, "row").where(F.col("col").between(F.col("first"), F.col("last"))).agg(F.count("*").alias("n"))


def nearest_source(values: np.ndarray) -> np.ndarray:
    """Values with every gap taken from the nearest valid cell, by two sweeps of summed steps.

    The sweeps visit cells in order and look at neighbours already visited; a tie keeps what came first.
    """
    height, width = values.shape
    source = np.where(np.isnan(values), -1, np.arange(values.size).reshape(values.shape))
    far = np.where(np.isnan(values), np.inf, 0.0)
    gap = source < 0
    diagonal = math.sqrt(2.0)
    for step in (1, -1):
        rows = range(height) if step == 1 else range(height - 1, -1, -1)
        for y in rows:
            if not gap[y].any():
                continue
            here, of, before = far[y], source[y], y - step
            above = 0 <= before < height
            columns = np.flatnonzero(gap[y])
            for x in (columns if step == 1 else columns[::-1]).tolist():
                around = [(y, x - step, 1.0)]
                if above:
                    around += [(before, x, 1.0), (before, x - step, diagonal), (before, x + step, diagonal)]
                for r, c, d in around:
                    if 0 <= c < width and source[r, c] >= 0:
                        reach = (math.sqrt(far[r, c]) + d) ** 2
                        if reach < here[x]:
                            here[x], of[x] = reach, source[r, c]
    out = values.copy()
    taken = gap & (source >= 0)
    out[taken] = values.reshape(-1)[source[taken]]
    return out


def fill_nearest(cells: DataFrame, grid: Grid) -> DataFrame:
    """Gaps in the hull take the nearest valid value. The sweeps are sequential by definition: a raster is one task."""

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        return nearest_source(block)

    swept = by_strip(cells, grid, 0, run, rows=grid.height).withColumnRenamed("v", "near")
    spans = hull_rows(cells)
    within = F.col("col").between(F.col("first"), F.col("last"))
    both = cells.select("row", "col", "v").join(swept, ["row", "col"]).join(spans, "row", "left")
    return both.select("row", "col", F.coalesce("v", F.when(within, F.col("near"))).cast("float").alias("v"))


def fill_idw(cells: DataFrame, grid: Grid, most: int = 100, smoothing: int = 0, directions: int = 16, power: float = 2.0, rows: int | None = None) -> DataFrame:
    """Gaps in the hull take the inverse-distance mean of the first valid cell in each direction, up to ``most`` cells away.

    Rays run within strips whose halo is as wide as they reach. Filled cells may be smoothed by 3 x 3 means; what no ray
    reached takes the nearest value.
    """
    spans = hull_rows(cells)
    marked = cells.select("row", "col", "v").join(spans, "row", "left")
    inside = F.coalesce(F.col("col").between(F.col("first"), F.col("last")), F.lit(False))
    # a gap outside the hull is marked by an infinity, which no valid cell has here
    coded = marked.select("row", "col", F.when(F.col("v").isNotNull(), F.col("v").cast("double")).when(~inside, F.lit(float("-inf"))).alias("v"))

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        outside = np.isneginf(block)
        values = np.where(outside, np.nan, block)
        from_, to = max(0, begin - smoothing), min(height, end + smoothing)
        gap_y, gap_x = np.nonzero((np.isnan(values) & ~outside)[from_ - low : to - low])
        gap_y = gap_y + from_ - low
        total, weight = np.zeros(len(gap_y)), np.zeros(len(gap_y))
        for d in range(directions):
            dx, dy = math.cos(2 * math.pi * d / directions), math.sin(2 * math.pi * d / directions)
            going = np.arange(len(gap_y))
            for step in range(1, most + 1):
                if not len(going):
                    break
                x, y = away(gap_x[going] + dx * step), away(gap_y[going] + low + dy * step)
                ok = (x >= 0) & (y >= 0) & (x < values.shape[1]) & (y < height)
                going, x, y = going[ok], x[ok], y[ok]
                found = values[y - low, x]
                hit = ~np.isnan(found)
                far = np.hypot(x - gap_x[going], y - low - gap_y[going])[hit]
                w = 1 / np.maximum(far, 1e-6) ** power
                total[going[hit]] += w * found[hit]
                weight[going[hit]] += w
                going = going[~hit]
        reached = weight > 0
        gy, gx = gap_y[reached], gap_x[reached]
        values[gy, gx] = (total[reached] / weight[reached]).astype(np.float32)
        for _ in range(smoothing):
            padded = np.pad(values, 1, constant_values=np.nan)
            near = np.stack([padded[gy + i, gx + j] for i in range(3) for j in range(3)])
            values[gy, gx] = np.nanmean(near, axis=0).astype(np.float32)
        return values[begin - low : end - low]

    filled = by_strip(coded, grid, most + smoothing, run, rows)
    return fill_nearest_from(filled, spans, grid)


def fill_nearest_from(filled: DataFrame, spans: DataFrame, grid: Grid) -> DataFrame:
    """The nearest value for gaps within given spans."""

    def run(block: np.ndarray, low: int, height: int, begin: int, end: int) -> np.ndarray:
        return nearest_source(block)

    open_ = filled.where(F.col("v").isNull()).join(spans, "row").where(F.col("col").between(F.col("first"), F.col("last"))).select("row", "col")
    swept = by_strip(filled, grid, 0, run, rows=grid.height).withColumnRenamed("v", "near")
    late = open_.join(swept, ["row", "col"]).select("row", "col", "near")
    return filled.join(late, ["row", "col"], "left").select("row", "col", F.coalesce("v", "near").alias("v"))


def away(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero."""
    return np.trunc(x + np.copysign(0.5, x)).astype(np.int64)
