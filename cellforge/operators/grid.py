"""The georeference of a raster and operations on its cells as a whole."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells up to which a raster may be broadcast.
BROADCAST_CELLS = 1 << 17


@dataclass(frozen=True)
class Grid:
    """Size and affine georeference: X = a + col * b + row * c, Y = d + col * e + row * f; cell corners are integers.

    Kept on the driver and put into plans as literals; the cells themselves are a DataFrame with ``row`` and ``col``.
    """

    width: int
    height: int
    a: float = 0.0
    b: float = 1.0
    c: float = 0.0
    d: float = 0.0
    e: float = 0.0
    f: float = 1.0

    @classmethod
    def of_header(cls, width: int, height: int, cell_x: float, cell_y: float, x: float, y: float, cell_col: float = 0.0, cell_row: float = 0.0, rotation: float = 0.0) -> Grid:
        """From cell sizes, the world place (x, y) of a registration cell, and a rotation in degrees; rows run south."""
        turn = math.radians(rotation)
        b, c = cell_x * math.cos(turn), cell_y * math.sin(turn)
        e, f = cell_x * math.sin(turn), -cell_y * math.cos(turn)
        return cls(width, height, x - cell_col * b - cell_row * c, b, c, y - cell_col * e - cell_row * f, e, f)

    @property
    def determinant(self) -> float:
        return self.b * self.f - self.c * self.e

    @property
    def invertible(self) -> bool:
        return abs(self.determinant) > 1e-15

    @property
    def cell_width(self) -> float:
        return math.hypot(self.b, self.e)

    @property
    def cell_height(self) -> float:
        return math.hypot(self.c, self.f)

    @property
    def cell_area(self) -> float:
        return abs(self.determinant)

    def world(self, x: Column | float, y: Column | float) -> tuple[Column | float, Column | float]:
        """World coordinates of pixel coordinates (a cell's centre lies at + 0.5)."""
        return self.a + x * self.b + y * self.c, self.d + x * self.e + y * self.f

    def pixel(self, x: Column | float, y: Column | float) -> tuple[Column | float, Column | float]:
        """Pixel coordinates of world coordinates."""
        if not self.invertible:
            raise ValueError("the georeference can't be inverted")
        u, v = x - self.a, y - self.d
        return (u * self.f - v * self.c) / self.determinant, (v * self.b - u * self.e) / self.determinant

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Column and row of the cell at world coordinates; null outside."""
        px, py = self.pixel(x, y)
        inside = (px >= 0) & (px < self.width) & (py >= 0) & (py < self.height)
        return F.when(inside, F.floor(px).cast("int")), F.when(inside, F.floor(py).cast("int"))

    def bounds(self) -> tuple[float, float, float, float]:
        """World bounds: least X, least Y, greatest X, greatest Y."""
        corners = [self.world(float(x), float(y)) for x in (0, self.width) for y in (0, self.height)]
        xs, ys = zip(*corners, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def window(self, x: int, y: int, width: int, height: int) -> Grid:
        """The georeference of a window of the raster."""
        left, top = self.world(float(x), float(y))
        return replace(self, width=width, height=height, a=left, d=top)

    def mismatch(self, other: Grid, crs: str | None = None, other_crs: str | None = None) -> str | None:
        """Why cells of two rasters can't be paired: size, coordinate system, or coefficients beyond 1e-9; None if they can."""
        if (self.width, self.height) != (other.width, other.height):
            return "size"
        if crs != other_crs:
            return "coordinate system"
        for name in "abcdef":
            p, q = getattr(self, name), getattr(other, name)
            if abs(p - q) > 1e-9 * max(1.0, abs(p), abs(q)):
                return f"coefficient {name}"
        return None


def normalised(cells: DataFrame, value: str, nodata: float | None = None) -> DataFrame:
    """Turn no-data (NaN, or the sentinel in single precision) into null; nothing after this knows of sentinels."""
    v = F.col(value).cast("float")
    missing = F.isnan(v)
    if nodata is not None and not math.isnan(nodata):
        missing = missing | (v == F.lit(nodata).cast("float"))
    return cells.withColumn(value, F.when(~missing, v))


def kept_apart(cells: DataFrame, count: int) -> DataFrame:
    """``cells`` for one side of a join, never to be broadcast if they are many: estimates from the size of files don't see
    the rows that an operator makes of one, and a broadcast goes through the driver."""
    return cells.hint("merge") if count > BROADCAST_CELLS else cells


def dense(cells: DataFrame, grid: Grid, *values: str) -> DataFrame:
    """A row for every cell of the grid; cells not given are null."""
    n = grid.width
    every = cells.sparkSession.range(grid.width * grid.height).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    return every.join(kept_apart(cells.select("row", "col", *values), grid.width * grid.height), ["row", "col"], "left")


def crop(cells: DataFrame, grid: Grid, x: int, y: int, width: int, height: int, *values: str) -> tuple[DataFrame, Grid]:
    """A window of exactly width x height cells; what lies outside the raster is null. The filter reaches the scan."""
    part = cells.where(F.col("row").between(y, y + height - 1) & F.col("col").between(x, x + width - 1))
    moved = part.select((F.col("row") - y).cast("int").alias("row"), (F.col("col") - x).cast("int").alias("col"), *values)
    cut = grid.window(x, y, width, height)
    return dense(moved, cut, *values), cut


def clip_window(grid: Grid, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """The pixel window (x, y, width, height; a cell at least) that covers world bounds, within the raster."""
    corners = [grid.pixel(x, y) for x in bounds[::2] for y in bounds[1::2]]
    xs, ys = zip(*corners, strict=True)
    left, top = max(0, math.floor(min(xs))), max(0, math.floor(min(ys)))
    right, bottom = min(grid.width, max(left + 1, math.ceil(max(xs)))), min(grid.height, max(top + 1, math.ceil(max(ys))))
    if left >= right or top >= bottom:
        raise ValueError("the extent doesn't meet the raster")
    return left, top, right - left, bottom - top


def overview_step(grid: Grid, most_width: int, most_height: int) -> int:
    """The least uniform step at which the raster fits the given size."""
    return max(1, math.ceil(grid.width / most_width), math.ceil(grid.height / most_height))


def overview(cells: DataFrame, grid: Grid, most_width: int, most_height: int) -> DataFrame:
    """Every step-th cell of every step-th row, renumbered; nothing is averaged."""
    step = overview_step(grid, most_width, most_height)
    kept = cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))
    return kept.withColumn("row", (F.col("row") / step).cast("int")).withColumn("col", (F.col("col") / step).cast("int"))
