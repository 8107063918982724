"""Sampling at points, profiles along lines, resampling and mosaics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .grid import Grid


def _tapped(points: DataFrame, cells: DataFrame, taps: list[tuple[int, int, Column]], fields: Sequence[str]) -> DataFrame:
    """Join each point with the cells at its taps (offsets from ``r0, c0`` and weights); weights of 0 or less drop out."""
    offsets = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), w.alias("w")) for dr, dc, w in taps))
    exploded = points.select(*fields, "r0", "c0", F.explode(offsets).alias("t")).where("t.w > 0")
    wanted = exploded.select(*fields, (F.col("r0") + F.col("t.dr")).cast("int").alias("row"), (F.col("c0") + F.col("t.dc")).cast("int").alias("col"), F.col("t.w").alias("w"))
    finite = F.when(F.abs(F.col("v").cast("double")) < float("inf"), F.col("v").cast("double"))
    return wanted.join(cells.select("row", "col", finite.alias("v")), ["row", "col"], "left")


def bilinear(points: DataFrame, cells: DataFrame, grid: Grid, strict: bool = False) -> DataFrame:
    """``id, value`` at pixel coordinates ``points(id, x, y)``, from the four cell centres around.

    Missing corners are left out and the rest weighed anew, or (``strict``) make the value missing. Beyond the raster
    there is no value.
    """
    u, v = F.col("x") - 0.5, F.col("y") - 0.5
    inside = (F.col("x") >= 0) & (F.col("x") <= grid.width) & (F.col("y") >= 0) & (F.col("y") <= grid.height)
    placed = points.where(inside).select("id", F.floor(u).alias("c0"), F.floor(v).alias("r0"), (u - F.floor(u)).alias("fx"), (v - F.floor(v)).alias("fy"))
    fx, fy = F.col("fx"), F.col("fy")
    taps = [(0, 0, (1 - fx) * (1 - fy)), (0, 1, fx * (1 - fy)), (1, 0, (1 - fx) * fy), (1, 1, fx * fy)]
    got = _tapped(placed, cells, taps, ["id"])
    known = F.col("v").isNotNull()
    found = got.groupBy("id").agg(F.sum(F.when(known, F.col("w") * F.col("v"))).alias("s"), F.sum(F.when(known, F.col("w"))).alias("w"), F.count_if(~known).alias("lost"))
    value = F.when(F.col("w") > 0, F.col("s") / F.col("w"))
    return points.select("id").join(found.select("id", F.when(F.col("lost") == 0, value).alias("value") if strict else value.alias("value")), "id", "left")


def bspline(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """``id, value`` of the uniform cubic B-spline over the 4 x 4 cells around; all must be valid and in the raster."""
    u, v = F.col("x") - 0.5, F.col("y") - 0.5
    placed = points.select("id", F.floor(u).alias("c"), F.floor(v).alias("r"), (u - F.floor(u)).alias("fx"), (v - F.floor(v)).alias("fy"))
    placed = placed.where((F.col("c") >= 1) & (F.col("r") >= 1) & (F.col("c") + 2 < grid.width) & (F.col("r") + 2 < grid.height))

    def weights(t: Column) -> list[Column]:
        return [(1 - 3 * t + 3 * t * t - t * t * t) / 6, (4 - 6 * t * t + 3 * t * t * t) / 6, (1 + 3 * t + 3 * t * t - 3 * t * t * t) / 6, t * t * t / 6]

    across, down = weights(F.col("fx")), weights(F.col("fy"))
    taps = [(i, j, F.greatest(across[j] * down[i], F.lit(1e-300))) for i in range(4) for j in range(4)]
    base = placed.select("id", (F.col("c") - 1).alias("c0"), (F.col("r") - 1).alias("r0"), "fx", "fy")
    got = _tapped(base, cells, taps, ["id"])
    found = got.groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"))
    return points.select("id").join(found.select("id", F.when(F.col("n") == 16, F.col("s")).alias("value")), "id", "left")


def at_points(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """``id, value`` of the cell at each world point ``id, x, y``; null outside and where no data."""
    col, row = grid.cell(F.col("x"), F.col("y"))
    placed = points.select("id", row.alias("row"), col.alias("col"))
    return placed.join(cells.select("row", "col", F.col("v").alias("value")), ["row", "col"], "left").select("id", "value")


def line_points(spark_frame: DataFrame, start: tuple[float, float], end: tuple[float, float], samples: int) -> DataFrame:
    """``id, distance, x, y``: evenly spaced points of a line, both ends included."""
    if samples < 2:
        raise ValueError("a profile has two samples at least")
    (x0, y0), (x1, y1) = start, end
    t = F.col("id") / F.lit(float(samples - 1))
    span = math.hypot(x1 - x0, y1 - y0)
    return spark_frame.sparkSession.range(samples).select("id", (t * span).alias("distance"), (x0 + t * (x1 - x0)).alias("x"), (y0 + t * (y1 - y0)).alias("y"))


def world_line(spark_frame: DataFrame, grid: Grid, start: tuple[float, float], end: tuple[float, float], samples: int) -> DataFrame:
    """``id, distance, x, y, world_x, world_y``: a line given in world coordinates, its distances in world units."""
    line = line_points(spark_frame, start, end, samples)
    px, py = grid.pixel(F.col("x"), F.col("y"))
    return line.select("id", "distance", px.alias("x"), py.alias("y"), F.col("x").alias("world_x"), F.col("y").alias("world_y"))


def polyline_points(vertices: DataFrame, spacing: float) -> DataFrame:
    """``id, distance, x, y`` along ``vertices(seq, x, y)``: each segment in max(1, ceil(length / spacing)) steps."""
    points = polylines_points(vertices.withColumn("line", F.lit(0)), spacing)
    return points.select("id", "distance", "x", "y")


def polylines_points(vertices: DataFrame, spacing: float) -> DataFrame:
    """``line, id, distance, x, y`` along each line of ``vertices(line, seq, x, y)``; windows are of one line's vertices.

    Samples aren't sorted: their number is that of the steps before their segment, and of their own.
    """
    order = Window.partitionBy("line").orderBy("seq")
    step = vertices.select("line", "seq", F.lag("x").over(order).alias("x0"), F.lag("y").over(order).alias("y0"), "x", "y")
    far = F.coalesce(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")), F.lit(0.0))
    steps = F.when(F.col("x0").isNull(), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("far") / spacing))).cast("long")
    timed = step.select("*", far.alias("far")).select("*", steps.alias("steps"))
    timed = timed.select("*", (F.sum("far").over(order) - F.col("far")).alias("so_far"), (F.sum("steps").over(order) - F.col("steps")).alias("before"))
    each = timed.select("*", F.explode(F.when(F.col("x0").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("steps"), F.lit(1))))).alias("k"))
    t = F.when(F.col("x0").isNull(), 1.0).otherwise(F.col("k") / F.col("steps"))
    at = lambda c: F.when(F.col("x0").isNull(), F.col(c)).otherwise(F.col(f"{c}0") + t * (F.col(c) - F.col(f"{c}0")))
    return each.select("line", (F.col("before") + F.col("k")).alias("id"), (F.col("so_far") + t * F.col("far")).alias("distance"), at("x").alias("x"), at("y").alias("y"))


def surface_length(profile: DataFrame) -> DataFrame:
    """``length`` over ``id, distance, value`` (ids count from 0); a step that touches a missing value counts its plain
    distance. Each sample meets the next by its number: no window over a whole profile."""
    after = profile.select((F.col("id") - 1).alias("id"), F.col("distance").alias("d1"), F.col("value").alias("z1"))
    d, dz = F.col("d1") - F.col("distance"), F.col("z1") - F.col("value")
    both = profile.select("id", "distance", "value").join(after, "id")
    return both.select(F.coalesce(F.sqrt(d * d + dz * dz), d).alias("step")).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """``id, value``: one series of samples (``id, value``) less another; null where either is."""
    return first.select("id", F.col("value").alias("a")).join(second.select("id", F.col("value").alias("b")), "id").select("id", (F.col("a") - F.col("b")).alias("value"))


def nearest(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """``id, value`` of the cell that holds pixel coordinates ``points(id, x, y)``."""
    placed = points.select("id", F.floor("y").cast("int").alias("row"), F.floor("x").cast("int").alias("col"))
    return placed.join(cells.select("row", "col", F.col("v").cast("double").alias("value")), ["row", "col"], "left").select("id", "value")


#: Ways to take a value at pixel coordinates.
SAMPLERS = {"nearest": nearest, "bilinear": bilinear, "bspline": bspline, "bezier": kernels.bezier}


def at_world(points: DataFrame, cells: DataFrame, grid: Grid, sampler: str = "bilinear") -> DataFrame:
    """``id, value`` at world coordinates ``points(id, x, y)``; null outside. The georeference must be invertible."""
    px, py = grid.pixel(F.col("x").cast("double"), F.col("y").cast("double"))
    return SAMPLERS[sampler](points.select("id", px.alias("x"), py.alias("y")), cells, grid)


def identify(points: DataFrame, layers: Sequence[tuple[str, DataFrame, Grid]]) -> DataFrame:
    """``id, layer, cell, bilinear, bezier``: what every layer has at world points, by cell and between cells."""
    out: DataFrame | None = None
    for name, cells, grid in layers:
        found = points.select("id", F.lit(name).alias("layer"))
        for column, sampler in (("cell", "nearest"), ("bilinear", "bilinear"), ("bezier", "bezier")):
            found = found.join(at_world(points, cells, grid, sampler).withColumnRenamed("value", column), "id")
        out = found if out is None else out.union(found)
    if out is None:
        raise ValueError("there is no layer")
    return out


def every_cell(cells: DataFrame, grid: Grid) -> DataFrame:
    every = cells.sparkSession.range(grid.width * grid.height)
    return every.withColumn("row", F.floor(F.col("id") / grid.width).cast("int")).withColumn("col", (F.col("id") % grid.width).cast("int"))


def resample(cells: DataFrame, grid: Grid, target: Grid, sampler: str = "bilinear") -> DataFrame:
    """``row, col, v`` of the target grid: sampled at the world place of each target cell's centre."""
    every = every_cell(cells, target)
    wx, wy = target.world(F.col("col") + 0.5, F.col("row") + 0.5)
    px, py = grid.pixel(wx, wy)
    values = SAMPLERS[sampler](every.select("id", px.alias("x"), py.alias("y")), cells, grid)
    return every.join(values, "id").select("row", "col", F.col("value").cast("float").alias("v"))


def subdivide(cells: DataFrame, grid: Grid, factor: int, sampler: str = "bilinear") -> tuple[DataFrame, Grid]:
    """``factor`` x ``factor`` cells for each, sampled at their centres."""
    fine = Grid(grid.width * factor, grid.height * factor, grid.a, grid.b / factor, grid.c / factor, grid.d, grid.e / factor, grid.f / factor)
    every = every_cell(cells, fine)
    values = SAMPLERS[sampler](every.select("id", ((F.col("col") + 0.5) / factor).alias("x"), ((F.col("row") + 0.5) / factor).alias("y")), cells, grid)
    return every.join(values, "id").select("row", "col", F.col("value").cast("float").alias("v")), fine


def mosaic(sources: Sequence[tuple[DataFrame, Grid]], overlap: str = "last") -> tuple[DataFrame, Grid]:
    """Merge rasters on the grid of the first, over the union of their bounds: ``first``, ``last`` or ``average`` wins.

    Each output centre takes the nearest cell of every source; missing cells never count.
    """
    cell_x, cell_y = sources[0][1].cell_width, sources[0][1].cell_height
    bounds = [g.bounds() for _, g in sources]
    left, top = min(b[0] for b in bounds), max(b[3] for b in bounds)
    right, bottom = max(b[2] for b in bounds), min(b[1] for b in bounds)
    out = Grid(max(1, math.ceil((right - left) / cell_x - 1e-9)), max(1, math.ceil((top - bottom) / cell_y - 1e-9)), left, cell_x, 0.0, top, 0.0, -cell_y)
    spark = sources[0][0].sparkSession
    every = spark.range(out.width * out.height).select((F.col("id") / out.width).cast("int").alias("row"), (F.col("id") % out.width).cast("int").alias("col"))
    wx, wy = out.world(F.col("col") + 0.5, F.col("row") + 0.5)
    parts = []
    for k, (cells, grid) in enumerate(sources):
        col, row = grid.cell(wx, wy)
        placed = every.select("row", "col", row.alias("src_row"), col.alias("src_col")).where("src_row IS NOT NULL AND src_col IS NOT NULL")
        valid = cells.where(F.col("v").isNotNull()).select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), "v")
        parts.append(placed.join(valid, ["src_row", "src_col"]).select("row", "col", F.lit(k).alias("k"), F.col("v").cast("double").alias("v")))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    value = {"first": F.min_by("v", "k"), "last": F.max_by("v", "k"), "average": F.avg("v")}[overlap]
    merged = found.groupBy("row", "col").agg(value.cast("float").alias("v"))
    return every.join(merged, ["row", "col"], "left"), out
