"""Polygons over cells: row spans by scanline, zonal statistics, masks, measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid

#: Spans up to this number are broadcast (some thirty bytes each); beyond, they are shuffled.
MOST_SPANS = 200_000
#: Points that are broadcast at once.
MOST_POINTS = 10_000


def polygons(spark_frame: DataFrame, zones: Sequence[tuple[str, Sequence[tuple[float, float]]]]) -> DataFrame:
    """``zone, points`` from rings given on the driver."""
    rows = [(name, [{"x": float(x), "y": float(y)} for x, y in ring]) for name, ring in zones]
    return spark_frame.sparkSession.createDataFrame(rows, "zone string, points array<struct<x:double,y:double>>")


def row_spans(zones: DataFrame, grid: Grid) -> DataFrame:
    """``zone, row, first, last``: the cells whose centres lie in each zone (even-odd), as spans of columns.

    World rings become pixel rings; each row's centre line is cut with all edges, crossings are sorted and paired. Spans
    are half open; values are clamped before they become integers, so that far vertices do no harm.
    """
    pixel = F.transform("points", lambda p: _pixel(p, grid))
    ring = zones.where(F.size("points") >= 3).select("zone", pixel.alias("p"))
    ring = ring.where(F.forall("p", lambda q: ~F.isnan(q["x"]) & ~F.isnan(q["y"])))
    ys = F.transform("p", lambda q: q["y"])
    top = F.greatest(F.lit(0.0), F.floor(F.greatest(F.array_min(ys), F.lit(0.0)) - 0.5).cast("double")).cast("int")
    bottom = F.least(F.lit(float(grid.height)), F.array_max(ys)).cast("int")
    rows = ring.select("zone", "p", F.explode(F.sequence(top, F.least(F.greatest(bottom, top), F.lit(grid.height - 1)))).alias("row"))
    rows = rows.where((F.col("row") >= 0) & (F.col("row") < grid.height))
    y = F.col("row") + 0.5
    edges = F.zip_with("p", F.concat(F.slice("p", F.size("p"), F.lit(1)), F.slice("p", F.lit(1), F.size("p") - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = F.filter(edges, lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    at = F.array_sort(F.transform(cut, lambda s: s["a"]["x"] + (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])))
    crossed = rows.select("zone", "row", at.alias("x"))
    pairs = crossed.where(F.size("x") >= 2).select("zone", "row", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda k: F.struct(F.get("x", 2 * k).alias("lo"), F.get("x", 2 * k + 1).alias("hi")))).alias("s"))
    bound = lambda v: F.ceil(F.least(F.greatest(v - 0.5, F.lit(0.0)), F.lit(float(grid.width)))).cast("int")
    return pairs.select("zone", "row", bound(F.col("s.lo")).alias("first"), (bound(F.col("s.hi")) - 1).alias("last")).where("first <= last")


def _pixel(p: Column, grid: Grid) -> Column:
    x, y = grid.pixel(p["x"], p["y"])
    return F.struct(x.alias("x"), y.alias("y"))


def inside(cells: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Cells joined with the spans that hold them: an equi-join on the row, the columns as a further condition."""
    s = spans.withColumnRenamed("row", "span_row")
    held = (cells["row"] == s["span_row"]) & cells["col"].between(s["first"], s["last"])
    joined = cells.join(s, held, how)
    return joined.drop("span_row", "first", "last") if how == "inner" else joined


def sized(spans: DataFrame, most: int | None = None) -> DataFrame:
    """Spans, to be broadcast if there are few: they are counted first, up to one more than that."""
    most = MOST_SPANS if most is None else most
    return F.broadcast(spans) if spans.limit(most + 1).count() <= most else spans


def boxes(zones: DataFrame) -> DataFrame:
    """``zone, points`` of boxes ``zone, min_x, min_y, max_x, max_y``."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return zones.select("zone", F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y")).alias("points"))


def zonal_layers(layers: Sequence[tuple[str, DataFrame, Grid]], zones: DataFrame, value: str = "v") -> DataFrame:
    """``layer`` and the columns of ``zonal``, for several rasters at once."""
    out: DataFrame | None = None
    for name, cells, grid in layers:
        found = zonal(cells, zones, grid, value).withColumn("layer", F.lit(name))
        out = found if out is None else out.union(found)
    if out is None:
        raise ValueError("there is no layer")
    return out.select("layer", *(c for c in out.columns if c != "layer"))


def zonal_csv(found: DataFrame, path: str) -> None:
    """Write zonal statistics as CSV with a header: nine digits, nothing where there is no value."""
    def number(c: str) -> Column:
        digits = F.round(F.col(c).cast("double"), 9) if c != "area" else F.col(c).cast("double")
        scale = F.pow(F.lit(10.0), 8 - F.floor(F.log10(F.abs(digits))))
        nine = F.when(digits == 0, F.lit(0.0)).otherwise(F.rint(digits * scale) / scale)
        whole = (F.abs(nine) < 1e9) & (nine == F.rint(nine))
        return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.when(whole, nine.cast("long").cast("string")).otherwise(nine.cast("string")))

    attribute = F.col("attribute") if "attribute" in found.columns else F.lit(None).cast("string")
    columns = [F.col("zone"), attribute.alias("attribute"), F.col("n").alias("cells"), F.col("n_missing").alias("nodata"), *(number(c).alias(c) for c in ("min", "max", "mean", "std", "sum", "area"))]
    found.select(*columns).write.mode("overwrite").csv(path, header=True)


def crosses(a: Column, b: Column, c: Column, d: Column, play: float = 1e-8) -> Column:
    """Whether the segments from a to b and from c to d (structs x, y) cross or touch."""
    apart = [F.least(a[k], b[k]) > F.greatest(c[k], d[k]) + play for k in ("x", "y")] + [F.greatest(a[k], b[k]) < F.least(c[k], d[k]) - play for k in ("x", "y")]
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    near = ~(apart[0] | apart[1] | apart[2] | apart[3])
    return near & (side(a, b, c) * side(a, b, d) <= play) & (side(c, d, a) * side(c, d, b) <= play)


def zonal(cells: DataFrame, zones: DataFrame, grid: Grid, value: str = "v", most: int | None = None) -> DataFrame:
    """Per zone: ``n, n_missing, min, max, mean, std, sum, area``; zones may overlap. Up to ``most`` spans are broadcast."""
    spans = row_spans(zones, grid)
    v = F.col(value).cast("double")
    found = inside(cells, sized(spans, most)).groupBy("zone").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
    )
    return found.withColumn("area", (F.col("n") + F.col("n_missing")) * grid.cell_area)


def length(points: Column) -> Column:
    """Length of a polyline."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda t, d: t + d)


def perimeter(points: Column) -> Column:
    """Length of a ring, closed; 0 with fewer than two points."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when(F.size(points) < 2, 0.0).otherwise(length(points) + F.hypot(first["x"] - last["x"], first["y"] - last["y"]))


def area(points: Column) -> Column:
    """Area of a ring by the shoelace formula; 0 with fewer than three points."""
    after = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    cross = F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda t, d: t + d)) / 2)


def smoothed(points: Column, rounds: int = 1) -> Column:
    """Corner cutting at a quarter and three quarters of each side; open lines keep their ends, closed ones stay closed."""
    for _ in range(rounds):
        points = _cut(points)
    return points


def _cut(points: Column) -> Column:
    n = F.size(points)
    first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    sides = F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), lambda a, b: F.array(_between(a, b, 0.25), _between(a, b, 0.75)))
    inner = F.flatten(sides)
    ring = F.concat(inner, F.slice(inner, F.lit(1), F.lit(1)))
    line = F.concat(F.array(first), F.slice(inner, F.lit(2), F.size(inner) - 2), F.array(last))
    return F.when(n < 3, points).when(closed, ring).otherwise(line)


def _between(a: Column, b: Column, t: float) -> Column:
    return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))


def nearest(points: DataFrame, features: DataFrame) -> DataFrame:
    """For each ``point(id, x, y)`` the feature (``seq, attribute, points``) with the nearest vertex; the first wins ties.

    Points are broadcast in blocks of a bounded number; vertices stay where they are, and only a least distance a point
    and task is shuffled.
    """
    vertices = features.select("seq", "attribute", F.explode("points").alias("p"))
    far = (F.col("p.x") - F.col("x")) * (F.col("p.x") - F.col("x")) + (F.col("p.y") - F.col("y")) * (F.col("p.y") - F.col("y"))
    blocks = max(1, -(-points.count() // (MOST_POINTS // 2)))  # by hash, so half as many a block on average
    out: DataFrame | None = None
    for k in range(blocks):
        some = points if blocks == 1 else points.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        met = vertices.crossJoin(F.broadcast(some)).select("id", "seq", "attribute", far.alias("d2"))
        best = met.groupBy("id").agg(F.min(F.struct("d2", "seq", "attribute")).alias("best")).select("id", "best.seq", "best.attribute", "best.d2")
        out = best if out is None else out.union(best)
    return out
