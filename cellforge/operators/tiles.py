"""Square tiles of a raster, packed one a row, for operators that follow lines over long distances."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a side.
SIDE = 256


def packed(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """``tile_row, tile_col, data``: the values of a tile's cells as doubles, row by row; what is missing is NaN."""

    def run(table: pa.Table) -> pa.Table:
        out = np.full((side, side), np.nan)
        out[np.asarray(table.column("row")) % side, np.asarray(table.column("col")) % side] = table.column("v").to_numpy()
        return pa.table({"tile_row": table.column("tile_row")[:1], "tile_col": table.column("tile_col")[:1], "data": pa.array([out.tobytes()], pa.binary())})

    at = lambda c: F.floor(F.col(c) / side).cast("int")
    dealt = cells.where(F.col("v").isNotNull()).select(at("row").alias("tile_row"), at("col").alias("tile_col"), "row", "col", F.col("v").cast("double").alias("v"))
    return dealt.groupBy("tile_row", "tile_col").applyInArrow(run, "tile_row int, tile_col int, data binary")


class Ground:
    """Values by row and column over the tiles at hand; NaN elsewhere."""

    def __init__(self, tiles: Iterable[tuple[int, int, bytes]], side: int = SIDE) -> None:
        held = list(tiles)
        self.side = side
        self.first = (min((r for r, _, _ in held), default=0), min((c for _, c, _ in held), default=0))
        shape = (max((r for r, _, _ in held), default=0) - self.first[0] + 1, max((c for _, c, _ in held), default=0) - self.first[1] + 1)
        self.place = np.full(shape, len(held), dtype=np.int64)
        self.data = np.full((len(held) + 1, side, side), np.nan)  # the last one stands for tiles that aren't here
        for k, (r, c, data) in enumerate(held):
            self.place[r - self.first[0], c - self.first[1]] = k
            self.data[k] = np.frombuffer(data).reshape(side, side)

    def at(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        tr, tc = row // self.side - self.first[0], col // self.side - self.first[1]
        here = (tr >= 0) & (tc >= 0) & (tr < self.place.shape[0]) & (tc < self.place.shape[1])
        tile = np.where(here, self.place[np.where(here, tr, 0), np.where(here, tc, 0)], len(self.data) - 1)
        return self.data[tile, row % self.side, col % self.side]

    def bilinear(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Tolerant bilinear values where a cell's own value lies at whole numbers: of the known corners, by their weights."""
        r, c = np.floor(row).astype(np.int64), np.floor(col).astype(np.int64)
        fr, fc = row - r, col - c
        total, weight = np.zeros(row.shape), np.zeros(row.shape)
        for dr, dc, w in ((0, 0, (1 - fc) * (1 - fr)), (0, 1, fc * (1 - fr)), (1, 0, (1 - fc) * fr), (1, 1, fc * fr)):
            v = self.at(r + dr, c + dc)
            ok = (w > 0) & np.isfinite(v)
            total += np.where(ok, w * v, 0.0)
            weight += np.where(ok, w, 0.0)
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)
