"""Datasets of a text header and a band-interleaved data file: opening, saving, and headers of what is derived from them."""

from __future__ import annotations

import copy
import math
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.grid import Grid
from . import bil
from .header import CELL_TYPES, Block, HeaderError, RasterHeader, data_file, degrees, parse, written

#: Entries that describe where a raster lies, and those of a dataset that stay with what is derived from it.
SPACE = ("Datum", "Projection", "CoordinateType", "Units", "Rotation")
KEPT = ("DataSetType", "DataType", "ByteOrder")


@dataclass(frozen=True)
class Dataset:
    """A header's DatasetHeader block, cells ``band, row, col, v``, and their georeference."""

    head: Block
    cells: DataFrame
    grid: Grid

    @property
    def bands(self) -> int:
        return int(self.head.child("RasterInfo").number("NrOfBands", 1.0))


def head_of(text: str) -> Block:
    head = next(iter(parse(text).children("DatasetHeader")), None)
    if head is None:
        raise HeaderError("no DatasetHeader block")
    return head


def load(spark: SparkSession, path: str, **options: object) -> Dataset:
    """A dataset by the path of its header; nothing of the data is read before it is asked for."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    about = RasterHeader.of(text)
    folder = os.path.dirname(os.path.abspath(path))
    found = data_file(os.path.abspath(path), about.data_file, {os.path.join(folder, x) for x in os.listdir(folder)})
    if found is None:
        raise HeaderError(f"the data of {path} isn't there")
    cells = bil.read(spark, found, about.grid, about.bands, cell_type=about.cell_type, big_endian=about.big_endian, offset=about.offset, null_value=about.null_value, **options)
    return Dataset(head_of(text), cells, about.grid)


def stamp(when: datetime) -> str:
    """A time as headers have it."""
    return when.astimezone(UTC).strftime("%a %b %d %H:%M:%S GMT %Y")


def save(data: Dataset, path: str, cell_type: str | None = None, big_endian: bool | None = None, data_name: str | None = None, keep_offset: bool = False, name: bool = True, time: bool = True) -> Dataset:
    """Write header and data side by side; the header says what was written, all else in it stays.

    ``cell_type`` and ``big_endian`` convert; an unknown byte order becomes the least significant first. The data file has
    the header's stem unless ``data_name`` is given; ``name`` and ``time`` stamp the header.
    """
    head = copy.deepcopy(data.head)
    info = head.inner("RasterInfo")
    kind = cell_type or next((t for t in CELL_TYPES if t.lower() == (info.get("CellType") or "").lower()), "IEEE4ByteReal")
    if kind not in CELL_TYPES:
        raise HeaderError(f"unknown cell type {kind}")
    order = (head.get("ByteOrder") or "").lower() == "msbfirst" if big_endian is None else big_endian
    offset = int(head.number("HeaderOffset", 0.0)) if keep_offset else 0
    data_name = data_name or os.path.splitext(os.path.basename(path))[0]
    info.put("CellType", kind)
    info.put("NrOfLines", data.grid.height)
    info.put("NrOfCellsPerLine", data.grid.width)
    info.put("NrOfBands", data.bands)
    head.put("DataSetType", "ERStorage")
    head.put("DataType", head.get("DataType") or "Raster")
    head.put("ByteOrder", "MSBFirst" if order else "LSBFirst")
    head.put("HeaderOffset", offset or None)
    head.put("DataFile", data_name)
    if name:
        head.put("Name", os.path.basename(path))
    if time:
        head.put("LastUpdated", stamp(datetime.now(UTC)))
    folder = os.path.dirname(os.path.abspath(path))
    bil.write(data.cells, os.path.join(folder, data_name), data.grid, data.bands, kind, order, info.number("NullCellValue"), offset)
    root = Block("")
    root.blocks.append(head)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(written(root) + "\n")
    return Dataset(head, data.cells, data.grid)


def placed(head: Block, grid: Grid, bands: int, cell_type: str, null_value: float | None, unrotated: bool = False) -> Block:
    """A new header for another raster in the same coordinate space: its origin is that of the grid."""
    out = Block("DatasetHeader")
    for key in KEPT:
        if head.get(key):
            out.put(key, head.get(key))
    space, old = out.inner("CoordinateSpace"), head.child("CoordinateSpace")
    for key in SPACE:
        if old.get(key):
            space.put(key, "0:0:0.0" if unrotated and key == "Rotation" else old.get(key))
    info, was = out.inner("RasterInfo"), head.child("RasterInfo")
    info.put("CellType", cell_type)
    info.put("NullCellValue", null_value)
    cell = info.inner("CellInfo")
    cell.put("Xdimension", grid.cell_width)
    cell.put("Ydimension", grid.cell_height)
    info.put("NrOfLines", grid.height)
    info.put("NrOfCellsPerLine", grid.width)
    corner = info.inner("RegistrationCoord")
    x, y = next((pair for pair in (("Eastings", "Northings"), ("MetersX", "MetersY"), ("Longitude", "Latitude")) if was.child("RegistrationCoord").get(pair[0])), ("Eastings", "Northings"))
    corner.put(x, float(grid.a))
    corner.put(y, float(grid.d))
    info.put("NrOfBands", bands)
    return out


def part(data: Dataset, cells: DataFrame, grid: Grid) -> Dataset:
    """A window or a subdivision of a dataset, with the names of its bands."""
    was = data.head.child("RasterInfo")
    head = placed(data.head, grid, data.bands, was.get("CellType") or "IEEE4ByteReal", was.number("NullCellValue"))
    head.inner("RasterInfo").blocks += [copy.deepcopy(b) for b in was.children("BandId")]
    return Dataset(head, cells, grid)


def derived(data: Dataset, cells: DataFrame, description: str = "Derived result", units: str | None = None) -> Dataset:
    """One band ``row, col, v`` computed from a dataset: its whole header, but for the data's own description."""
    head = copy.deepcopy(data.head)
    head.put("DataSetType", "ERStorage")
    head.put("DataFile", None)
    head.put("HeaderOffset", None)
    info = head.inner("RasterInfo")
    info.put("CellType", "IEEE4ByteReal")
    info.put("NullCellValue", None)
    info.put("NrOfBands", 1)
    info.blocks = [b for b in info.blocks if b.name.lower() != "bandid"]
    band = Block("BandId")
    band.put("Value", description)
    band.put("Units", units)
    info.blocks.append(band)
    return Dataset(head, cells.select(F.lit(0).alias("band"), "row", "col", "v"), data.grid)


def coloured(data: Dataset, image: DataFrame) -> Dataset:
    """Three bands of one byte from ``row, col, r, g, b`` and either ``alpha`` or nulls; 0 has no data."""
    head = placed(data.head, data.grid, 3, "Unsigned8BitInteger", 0.0)
    head.put("ByteOrder", "LSBFirst")
    seen = F.col("alpha") != 0 if "alpha" in image.columns else F.lit(True)
    parts = F.array(*(F.struct(F.lit(k).alias("band"), F.when(seen, F.col(c).cast("float")).alias("v")) for k, c in enumerate("rgb")))
    return Dataset(head, image.select("row", "col", F.explode(parts).alias("x")).select("x.band", "row", "col", "x.v"), data.grid)


def with_bands(data: Dataset, bands: Sequence[tuple[DataFrame, Grid]]) -> Dataset:
    """Other bands, each ``row, col, v``, all of one size; the header follows them."""
    if not bands or any((g.width, g.height) != (bands[0][1].width, bands[0][1].height) for _, g in bands):
        raise ValueError("bands have one size")
    head = copy.deepcopy(data.head)
    info = head.inner("RasterInfo")
    first = bands[0][1]
    for key, value in (("NrOfLines", first.height), ("NrOfCellsPerLine", first.width), ("NrOfBands", len(bands))):
        info.put(key, value)
    cells: DataFrame | None = None
    for k, (band, _) in enumerate(bands):
        own = band.select(F.lit(k).alias("band"), "row", "col", "v")
        cells = own if cells is None else cells.union(own)
    return Dataset(head, cells, replace(data.grid, width=first.width, height=first.height))


def replaced(data: Dataset, band: int, cells: DataFrame, grid: Grid) -> Dataset:
    """Another band in the place of one, of the same size."""
    if not 0 <= band < data.bands:
        raise ValueError(f"there is no band {band}")
    if (grid.width, grid.height) != (data.grid.width, data.grid.height):
        raise ValueError("a band is replaced by one of its size")
    return Dataset(data.head, data.cells.where(F.col("band") != band).union(cells.select(F.lit(band).alias("band"), "row", "col", "v")), data.grid)


def same_size(grids: dict[str, Grid]) -> None:
    """ValueError if bands given to an expression, used or not, differ in size."""
    if len({(g.width, g.height) for g in grids.values()}) > 1:
        raise ValueError("bands differ in size: " + ", ".join(f"{k} {g.width} x {g.height}" for k, g in grids.items()))


def mosaic(data: Sequence[Dataset], overlap: str = "last") -> Dataset:
    """The first bands merged on the grid of the first dataset, whose header the result has, without rotation."""
    if not data:
        raise ValueError("there is no dataset")
    merged, grid = sampling.mosaic([(d.cells.where("band = 0").select("row", "col", "v"), d.grid) for d in data], overlap)
    was = data[0].head.child("RasterInfo")
    head = placed(data[0].head, grid, 1, was.get("CellType") or "IEEE4ByteReal", was.number("NullCellValue"), unrotated=True)
    return Dataset(head, merged.select(F.lit(0).alias("band"), "row", "col", "v"), grid)


def profile_csv(series: Sequence[tuple[str, DataFrame]], path: str, unit: str = "m", write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Profiles ``id, distance, x, y, value`` of one line side by side, by sample: ``distance_<unit>, x, y`` and a column each."""
    base = series[0][1].select("id", F.col("distance").alias(f"distance_{unit}"), "x", "y")
    for name, profile in series:
        base = base.join(profile.select("id", F.col("value").alias(name)), "id", "left")
    table = base.coalesce(1).sortWithinPartitions("id").drop("id")  # one file: a profile has some thousand samples
    (write or (lambda df, to: df.write.mode("overwrite").csv(to, header=True)))(table, path)
    return table


def rotation(head: Block) -> float:
    """Radians that the header's grid is turned by."""
    return math.radians(degrees(head.child("CoordinateSpace").get("Rotation")))
