"""Band-interleaved rasters as a Python data source and sink.

Line 0 of band 0, line 0 of band 1, and so on. A partition is a range of lines; the options ``rows``, ``cols`` and
``bands_read`` (first:last) bound what is read. They are options and not pushed filters because Spark keeps a reader,
with what was pushed into it, for all later queries of the same DataFrame. Paths may be any URI that ``pyarrow.fs``
opens, so executors need not share a disk with the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.grid import Grid
from .header import CELL_TYPES

#: Cells of a partition, about.
CELLS = 1 << 20
#: Bytes read at once, about.
READ = 1 << 22


@dataclass
class Lines(InputPartition):
    first: int
    last: int


class BilReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.width, self.height, self.bands = (int(options[k]) for k in ("width", "height", "bands"))
        kind = CELL_TYPES[options.get("cell_type", "IEEE4ByteReal")]
        self.kind = np.dtype(kind).newbyteorder(">" if options.get("big_endian", "true").lower() == "true" else "<")
        self.offset = int(options.get("offset", "0"))
        null = options.get("null_value")
        self.null = None if null in (None, "", "None") else np.float32(null)
        self.step_x, self.step_y = int(options.get("step_x", "1")), int(options.get("step_y", "1"))
        limits = {"row": self.height, "col": self.width, "band": self.bands}
        self.bounds = {}
        for name, size in limits.items():
            low, _, high = options.get({"row": "rows", "col": "cols", "band": "bands_read"}[name], ":").partition(":")
            self.bounds[name] = (max(0, int(low or 0)), min(size - 1, int(high or size - 1)))

    def partitions(self):
        low, high = self.bounds["row"]
        lines = max(1, CELLS // max(1, self.width))
        return [Lines(a, min(a + lines - 1, high)) for a in range(low, high + 1, lines)] or [Lines(0, -1)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        (b0, b1), (c0, c1) = self.bounds["band"], self.bounds["col"]
        size = self.kind.itemsize
        columns = np.arange(c0 - c0 % self.step_x + (self.step_x if c0 % self.step_x else 0), c1 + 1, self.step_x)
        if not len(columns):
            return
        line = self.bands * self.width
        with fs.open_input_file(path) as f:
            for first in range(partition.first, partition.last + 1, each := max(1, READ // (line * size))):
                last = min(partition.last, first + each - 1)
                rows = np.arange(first, last + 1)
                rows = rows[rows % self.step_y == 0]
                if not len(rows):
                    continue
                # from the first wanted band's first column to the last one's last: what lies outside isn't read
                begin = (int(rows[0]) * self.bands + b0) * self.width + int(columns[0])
                end = (int(rows[-1]) * self.bands + b1) * self.width + int(columns[-1]) + 1
                data = f.read_at((end - begin) * size, self.offset + begin * size)
                if len(data) < (end - begin) * size:
                    raise OSError(f"{self.path} ends within lines {first} to {last}")
                every = np.frombuffer(data, dtype=self.kind)
                r, b, c = (x.reshape(-1) for x in np.meshgrid(rows, np.arange(b0, b1 + 1), columns, indexing="ij"))
                v = every[(r * self.bands + b) * self.width + c - begin].astype(np.float32)
                missing = np.isnan(v) if self.null is None else np.isnan(v) | (v == self.null)
                yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (b, r, c)] + [pa.array(v, mask=missing)], names=["band", "row", "col", "v"])


class BilSource(DataSource):
    """``spark.read.format("bil")`` with options path, width, height, bands, cell_type, big_endian, offset, null_value, step_x, step_y, rows, cols, bands_read."""

    @classmethod
    def name(cls) -> str:
        return "bil"

    def schema(self) -> str:
        return "band int, row int, col int, v float"

    def reader(self, schema) -> BilReader:
        return BilReader(dict(self.options))


def read(spark: SparkSession, path: str, grid: Grid, bands: int = 1, **options: object) -> DataFrame:
    spark.dataSource.register(BilSource)
    given = {"path": path, "width": grid.width, "height": grid.height, "bands": bands} | options
    return spark.read.format("bil").options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def encoded(values: np.ndarray, cell_type: str, big_endian: bool, null_value: float | None) -> bytes:
    """Values (NaN: missing) in a cell type: whole numbers are rounded half away from zero and clamped; missing cells are
    the null value, or 0 where there is none."""
    values = np.where(np.isnan(values), 0.0 if null_value is None else null_value, values)
    kind = np.dtype(CELL_TYPES[cell_type])
    if kind.kind in "iu":
        info = np.iinfo(kind)
        values = np.clip(np.trunc(values + np.copysign(0.5, values)), info.min, info.max)
    return values.astype(kind.newbyteorder(">" if big_endian else "<")).tobytes()


def write(cells: DataFrame, path: str, grid: Grid, bands: int = 1, cell_type: str = "IEEE4ByteReal", big_endian: bool = False, null_value: float | None = None, offset: int = 0) -> None:
    """Write ``cells(band, row, col, v)`` behind ``offset`` zero bytes; cells not given are missing.

    Executors encode blocks of whole lines; the driver appends them to the one file in order, a partition at a time, and
    holds no more than that.
    """
    width, each = grid.width, max(1, CELLS // (grid.width * bands))

    def lines(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        rows = min(each, grid.height - k * each)
        block = np.full((rows, bands, width), np.nan)
        known = table.filter(pc.is_valid(table.column("v")))
        at = tuple(np.asarray(known.column(c)).astype(np.int64) for c in ("row", "band", "col"))
        block[at[0] - k * each, at[1], at[2]] = known.column("v").to_numpy().astype(float)
        return pa.table({"block": pa.array([k], pa.int64()), "lines": pa.array([encoded(block, cell_type, big_endian, null_value)], pa.binary())})

    every = cells.sparkSession.range(-(-grid.height // each)).select(F.col("id").alias("block"), F.lit(0).alias("row"), F.lit(0).alias("band"), F.lit(0).alias("col"), F.lit(None).cast("float").alias("v"))
    given = cells.select(F.floor(F.col("row") / each).cast("long").alias("block"), F.col("row").cast("int").alias("row"), F.col("band").cast("int").alias("band"), F.col("col").cast("int").alias("col"), F.col("v").cast("float").alias("v"))
    done = every.union(given).groupBy("block").applyInArrow(lines, "block long, lines binary").orderBy("block")
    with open(path, "wb") as f:
        f.write(b"\0" * offset)
        for r in done.toLocalIterator():
            f.write(bytes(r["lines"]))
