"""Contour levels and marching-squares segments."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zones import length, smoothed


def levels(low: float, high: float, interval: float) -> list[float]:
    """Whole multiples of the interval within the data, with a slack of 1e-9."""
    if interval <= 0:
        raise ValueError("the interval is positive")
    return [k * interval for k in range(math.ceil(low / interval - 1e-9), math.floor(high / interval + 1e-9) + 1)]


def nice_interval(span: float, lines: int = 10) -> float:
    """1, 2, 2.5 or 5 times a power of ten, near a share of the span."""
    raw = span / max(1, lines)
    if raw <= 0:
        return 1.0
    size = 10.0 ** math.floor(math.log10(raw))
    return next((m * size for m in (1, 2, 2.5, 5) if raw <= m * size), 10 * size)


def segments(cells: DataFrame, interval: float, least: float | None = None, most: float | None = None) -> DataFrame:
    """``level, row, col, k, x1, y1, x2, y2``: the pieces of contour in each square of four cell centres, in pixels.

    A corner on the level counts as above; a saddle is split by the mean of its corners; a square with a missing corner
    has none. Levels are the multiples of the interval between a square's least and greatest corner, and if given between
    ``least`` and ``most``.
    """
    along, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    v = F.col("v").cast("double")
    pairs = cells.select("row", "col", F.struct(v.alias("l"), F.lead(v).over(along).alias("r")).alias("t"))
    quads = pairs.select("row", "col", "t", F.lead("t").over(down).alias("b"))
    tl, tr, bl, br = F.col("t.l"), F.col("t.r"), F.col("b.l"), F.col("b.r")
    full = quads.select("row", "col", tl.alias("tl"), tr.alias("tr"), br.alias("br"), bl.alias("bl")).where("tl IS NOT NULL AND tr IS NOT NULL AND br IS NOT NULL AND bl IS NOT NULL")
    low = F.ceil(F.least("tl", "tr", "br", "bl") / interval - 1e-9)
    high = F.floor(F.greatest("tl", "tr", "br", "bl") / interval + 1e-9)
    if least is not None and most is not None:
        low, high = F.greatest(low, F.lit(math.ceil(least / interval - 1e-9)).cast("long")), F.least(high, F.lit(math.floor(most / interval + 1e-9)).cast("long"))
    crossed = full.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("n")).withColumn("level", F.col("n") * F.lit(float(interval)))
    level = F.col("level")
    mask = sum((F.when(F.col(c) >= level, bit).otherwise(0) for c, bit in (("tl", 8), ("tr", 4), ("br", 2), ("bl", 1))), F.lit(0))
    mean_above = (F.col("tl") + F.col("tr") + F.col("br") + F.col("bl")) / 4 >= level

    def share(a: str, b: str) -> Column:
        gap = F.col(b) - F.col(a)
        part = (level - F.col(a)) / F.when(F.abs(gap) < 1e-12, F.lit(1.0)).otherwise(gap)
        return F.when(F.abs(gap) < 1e-12, F.lit(0.5)).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))

    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    point = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
    top, bottom = point(x + share("tl", "tr"), y), point(x + share("bl", "br"), y + 1)
    left, right = point(x, y + share("tl", "bl")), point(x + 1, y + share("tr", "br"))
    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    m = F.col("mask")
    found = (
        F.when(m.isin(1, 14), F.array(piece(left, bottom)))
        .when(m.isin(2, 13), F.array(piece(bottom, right)))
        .when(m.isin(3, 12), F.array(piece(left, right)))
        .when(m.isin(4, 11), F.array(piece(top, right)))
        .when(m.isin(6, 9), F.array(piece(top, bottom)))
        .when(m.isin(7, 8), F.array(piece(left, top)))
        .when((m == 5) & mean_above | (m == 10) & ~mean_above, F.array(piece(left, top), piece(bottom, right)))
        .when(m == 5, F.array(piece(left, bottom), piece(top, right)))
        .when(m == 10, F.array(piece(top, right), piece(left, bottom)))
    )
    masked = crossed.withColumn("mask", mask).where((F.col("mask") > 0) & (F.col("mask") < 15))
    out = masked.select("level", "row", "col", F.posexplode(found).alias("k", "s"))
    return out.select("level", "row", "col", "k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def lines(pieces: DataFrame, interval: float, smoothing: int = 0, index_every: int = 5, least_length: float = 0.0) -> DataFrame:
    """``level, line, points, is_index, is_closed, length``: pieces chained where their ends are the same point.

    A chain starts with the first unused piece in row order and grows at its tail, then at its head, taking the first
    unused piece at the tip. Levels are chained apart, each in a task. Lines may then have corners cut; short ones go.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("row", "ascending"), ("col", "ascending"), ("k", "ascending")]).to_pylist()
        ends = [((p["x1"], p["y1"]), (p["x2"], p["y2"])) for p in rows]
        at: dict[tuple[float, float], list[int]] = {}
        for i, pair in enumerate(ends):
            for p in pair:
                at.setdefault(p, []).append(i)
        used = [False] * len(ends)

        def grown(tip: tuple[float, float]) -> list[tuple[float, float]]:
            out = []
            while (i := next((i for i in at[tip] if not used[i]), None)) is not None:
                used[i] = True
                tip = ends[i][1] if ends[i][0] == tip else ends[i][0]
                out.append(tip)
            return out

        found = []
        for i, (a, b) in enumerate(ends):
            if not used[i]:
                used[i] = True
                tail = grown(b)
                found.append([*reversed(grown(a)), a, b, *tail])
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        points = [[{"x": x, "y": y} for x, y in line] for line in found]
        level = rows[0]["level"] if rows else 0.0
        return pa.table({"level": pa.array([level] * len(found), pa.float64()), "line": pa.array(range(len(found)), pa.int64()), "points": pa.array(points, kind)})

    chained = pieces.groupBy("level").applyInArrow(run, "level double, line long, points array<struct<x:double,y:double>>")
    points = smoothed(F.col("points"), smoothing)
    first, last = F.get("points", F.lit(0)), F.get("points", F.size("points") - 1)
    drawn = chained.withColumn("points", points).select(
        "level", "line", "points", (F.pmod(F.rint(F.col("level") / interval).cast("long"), F.lit(index_every)) == 0 if index_every > 0 else F.lit(False)).alias("is_index"),
        ((first["x"] == last["x"]) & (first["y"] == last["y"])).alias("is_closed"), length(F.col("points")).alias("length"),
    )
    return drawn.where(F.col("length") >= least_length)
