"""Viewshed of one observer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid
from .tiles import SIDE, Ground, packed


def crossed(row: int, col: int, top: int, left: int, side: int) -> list[tuple[int, int]]:
    """Tiles that sight lines from a cell to the cells of a tile (its first cell is given) can touch, a cell's margin around them."""
    bottom, right = top + side - 1, left + side - 1
    ends = [(float(r), float(c)) for r in (top, bottom) for c in (left, right)]
    out = []
    for band in range((min(row, top) - 1) // side, (max(row, bottom) + 1) // side + 1):
        low, high = band * side - 1.0, (band + 1) * side + 0.0
        found = [float(col)] if low <= row <= high else []
        found += [x for r, x in ends if low <= r <= high]
        for r, x in ends:  # the lines to the corners bound the others
            for edge in (low, high):
                if r != row and 0 <= (t := (edge - row) / (r - row)) <= 1:
                    found.append(col + t * (x - col))
        if top <= high and bottom >= low:
            found += [float(left), float(right)]
        if found:
            out += [(band, c) for c in range(math.floor(min(found) - 1) // side, math.floor(max(found) + 1) // side + 1)]
    return out


def viewshed(cells: DataFrame, grid: Grid, col: int, row: int, height: float = 1.8, target: float = 0.0, most: int | None = None, side: int = SIDE) -> DataFrame:
    """``row, col, v``: 1 visible, 0 hidden; null beyond ``most`` cells and where no data. Without ``most`` all cells are in reach.

    A task takes the targets of one tile, and the tiles of terrain that their sight lines cross and no others; lines are
    followed a step of all of them at a time. So terrain of any size is answered, and no task holds more than a line of
    tiles to the observer.
    """
    if not (0 <= col < grid.width and 0 <= row < grid.height):
        raise ValueError("the observer stands outside the raster")
    if most is not None and most < 1:
        raise ValueError("the distance is 1 cell at least")
    reach = most if most is not None else math.ceil(math.hypot(grid.width, grid.height))
    own = cells.where((F.col("row") == row) & (F.col("col") == col)).select("v").first()
    if own is None or own["v"] is None:
        raise ValueError("the observer stands on no data")
    eye = float(own["v"]) + height
    near = cells.where(F.col("row").between(row - reach, row + reach) & F.col("col").between(col - reach, col + reach))
    tiles = packed(near, side)
    rows = (max(0, row - reach) // side, min(grid.height - 1, row + reach) // side)
    cols = (max(0, col - reach) // side, min(grid.width - 1, col + reach) // side)
    spark = cells.sparkSession
    targets = spark.range((rows[1] - rows[0] + 1) * (cols[1] - cols[0] + 1))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in batch.column("id").to_pylist():
                r, c = divmod(k, cols[1] - cols[0] + 1)
                r, c = r + rows[0], c + cols[0]
                found += [(r, c, *x) for x in crossed(row, col, r * side, c * side, side)]
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(x, pa.int32()) for x in columns], names=["of_row", "of_col", "tile_row", "tile_col"])

    def run(table: pa.Table) -> pa.Table:
        ground = Ground(zip(*(table.column(c).to_pylist() for c in ("tile_row", "tile_col", "data")), strict=True), side)
        top, left = table.column("of_row")[0].as_py() * side, table.column("of_col")[0].as_py() * side
        r, c = (x.reshape(-1) for x in np.mgrid[top : min(grid.height, top + side), left : min(grid.width, left + side)])
        z = ground.at(r, c) + target
        some = ~np.isnan(z) & ((r - row) ** 2 + (c - col) ** 2 <= reach**2)
        r, c, z = r[some], c[some], z[some]
        steps = np.maximum(np.abs(r - row), np.abs(c - col))
        seen = np.ones(len(r), dtype=bool)
        for i in range(1, int(steps.max(initial=0))):
            on = np.flatnonzero(seen & (steps > i))
            t = i / steps[on]
            line = ground.bilinear(row + (r[on] - row) * t, col + (c[on] - col) * t)
            seen[on[line > eye + t * (z[on] - eye) + 1e-6]] = False
        return pa.table({"row": pa.array(r.astype(np.int32)), "col": pa.array(c.astype(np.int32)), "seen": pa.array(seen.astype(np.float32))})

    wanted = targets.mapInArrow(needs, "of_row int, of_col int, tile_row int, tile_col int")
    judged = wanted.join(tiles, ["tile_row", "tile_col"]).groupBy("of_row", "of_col").applyInArrow(run, "row int, col int, seen float")
    placed = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return placed.join(judged, ["row", "col"], "left").select("row", "col", F.col("seen").alias("v"))
