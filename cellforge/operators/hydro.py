"""D8 hydrology: flow directions, accumulation by pointer doubling, stream cells."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .focal import neighbours
from .grid import kept_apart

#: Code, step east and step south of each of the eight directions, in order of precedence.
DIRECTIONS = ((1, 1, 0), (2, 1, 1), (4, 0, 1), (8, -1, 1), (16, -1, 0), (32, -1, -1), (64, 0, -1), (128, 1, -1))


class CycleError(ValueError):
    """Flow directions lead back to where they came from."""


def flow_direction(cells: DataFrame, width: int, height: int, cell_x: float = 1.0, cell_y: float = 1.0) -> DataFrame:
    """``row, col, v``: the code of the steepest strictly lower neighbour, 0 where there is none, null where no data."""
    near = neighbours(cells, width, height, edge=False)
    centre = F.col("z4")
    falls = []
    for place, (code, dx, dy) in enumerate(DIRECTIONS):
        far = (cell_x * cell_x * dx * dx + cell_y * cell_y * dy * dy) ** 0.5
        there = F.col(f"z{(dy + 1) * 3 + dx + 1}")
        steep = (centre - there) / far
        falls.append(F.when(there.isNotNull() & (steep > 0), F.struct(steep.alias("steep"), F.lit(-place).alias("place"), F.lit(code).alias("code"))))
    best = F.greatest(*falls)
    return near.select("row", "col", F.when(centre.isNotNull(), F.coalesce(best["code"], F.lit(0))).cast("int").alias("v"))


def flow_edges(directions: DataFrame) -> DataFrame:
    """``row, col, to_row, to_col``: where each valid cell drains; null where nowhere (no code, out of the raster, no data)."""
    known = F.col("v").isin([0, *(code for code, _, _ in DIRECTIONS)])
    east, south = F.lit(0), F.lit(0)
    for code, dx, dy in DIRECTIONS:
        east, south = F.when(F.col("v") == code, dx).otherwise(east), F.when(F.col("v") == code, dy).otherwise(south)
    checked = F.when(known, F.col("v")).otherwise(F.raise_error(F.lit("no flow direction")).cast("int"))
    valid = directions.where(F.col("v").isNotNull()).select("row", "col", checked.alias("v"))
    aimed = valid.select("row", "col", F.when(F.col("v") != 0, F.struct((F.col("row") + south).alias("row"), (F.col("col") + east).alias("col"))).alias("to"))
    target = valid.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    return aimed.join(target, (F.col("to.row") == F.col("to_row")) & (F.col("to.col") == F.col("to_col")), "left").select("row", "col", "to_row", "to_col")


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """``row, col, v``: the number of cells upstream of each valid cell, itself not counted, as a float.

    Pointer doubling: with jumps of 2**k cells, what flows in over up to 2**k steps is added from where the jump starts
    and jumps are joined with themselves, so a flow path of length n takes log2(n) rounds. A jump left after more rounds
    than any path could need is a cycle.
    """
    key = lambda r, c: F.struct(F.col(r).alias("row"), F.col(c).alias("col"))
    state = flow_edges(directions).select(key("row", "col").alias("id"), F.when(F.col("to_row").isNotNull(), key("to_row", "to_col")).alias("to"), F.lit(1).cast("long").alias("n"))
    state = stored(state)
    cells, rounds = state.count(), 0
    while open_ := state.where("to IS NOT NULL").count():
        if 1 << rounds > cells:
            raise CycleError("flow directions hold a cycle")
        flows = state.where("to IS NOT NULL")
        arrives = flows.groupBy("to").agg(F.sum("n").alias("more")).withColumnRenamed("to", "at")
        after = flows.select(F.col("id").alias("via"), F.col("to").alias("beyond"))
        joined = state.join(kept_apart(arrives, open_), F.col("id") == F.col("at"), "left").join(kept_apart(after, open_), F.col("to") == F.col("via"), "left")
        state = stored(joined.select("id", F.col("beyond").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), after=[state])
        rounds += 1
    valid = state.select("id.row", "id.col", (F.col("n") - 1).cast("float").alias("acc"))
    return directions.select("row", "col").join(kept_apart(valid, cells), ["row", "col"], "left").select("row", "col", F.col("acc").alias("v"))


def stream_cells(accumulation: DataFrame, threshold: float) -> DataFrame:
    """Cells whose accumulation reaches the threshold."""
    return accumulation.where(F.col("v") >= threshold)


def stream_segments(directions: DataFrame, accumulation: DataFrame, threshold: float) -> DataFrame:
    """``segment, strahler, accumulation, points``: reaches of the stream network, upstream to downstream, in pixels.

    A reach starts at every cell with other than one inflow and runs to the next such cell. Orders follow the whole
    network, so its cells (far fewer than the raster's) are one task.
    """
    mask = stream_cells(accumulation, threshold).select("row", "col", F.col("v").alias("acc"))
    cells = mask.join(directions.select("row", "col", F.col("v").alias("code")), ["row", "col"]).where("code IS NOT NULL")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("col", "ascending")])
        places = list(zip(table.column("row").to_pylist(), table.column("col").to_pylist(), strict=True))
        acc = dict(zip(places, table.column("acc").to_pylist(), strict=True))
        step = {code: (dy, dx) for code, dx, dy in DIRECTIONS}
        down = {}
        for (r, c), code in zip(places, table.column("code").to_pylist(), strict=True):
            dy, dx = step.get(code, (0, 0))
            down[r, c] = (r + dy, c + dx) if code and (r + dy, c + dx) in acc else None
        inflow = dict.fromkeys(places, 0)
        for to in down.values():
            if to:
                inflow[to] += 1
        left, order, arrived = dict(inflow), [p for p in places if not inflow[p]], {p: [] for p in places}
        strahler = {}
        for p in order:  # grows while it is walked: a cell follows once all its inflows have
            above = arrived[p]
            strahler[p] = (max(above) + (above.count(max(above)) > 1)) if above else 1
            if to := down[p]:
                arrived[to].append(strahler[p])
                left[to] -= 1
                if not left[to]:
                    order.append(to)
        if len(order) < len(places):
            raise CycleError("flow directions hold a cycle")
        out = []
        for head in order:
            if inflow[head] == 1:
                continue
            reach = [head]
            while (to := down[reach[-1]]) is not None:
                reach.append(to)
                if inflow[to] != 1:
                    break
            if len(reach) > 1:
                out.append((len(out), strahler[head], acc[reach[-1]], [{"x": c + 0.5, "y": r + 0.5} for r, c in reach]))
        ids, orders, flows, points = zip(*out, strict=True) if out else ((), (), (), ())
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table({"segment": pa.array(ids, pa.int64()), "strahler": pa.array(orders, pa.int32()), "accumulation": pa.array(flows, pa.float32()), "points": pa.array(points, kind)})

    return cells.withColumn("network", F.lit(0)).groupBy("network").applyInArrow(run, "segment long, strahler int, accumulation float, points array<struct<x:double,y:double>>")
