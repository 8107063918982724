"""GeoTIFF: a reader that partitions by strips or tiles, and a writer of tiled, compressed single-precision files.

Read: classic and BigTIFF, strips and tiles, chunky and separate bands, integers and reals of 1 to 8 bytes, no compression
or deflate, predictors 1 to 3; the georeference from scale and tie point or from a matrix, the EPSG number from the geo
keys, the no-data value from its text tag. Paths may be any URI that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import struct
import zlib
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

#: Tag numbers, and struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, METADATA, NO_DATA = 33550, 33922, 34264, 34735, 42112, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
GEOGRAPHIC, PROJECTED = 2048, 3072

#: Cells along a tile that is written; blocks of one partition that is read, about.
TILE, CELLS = 256, 1 << 20


class TiffError(ValueError):
    pass


def opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


@dataclass(frozen=True)
class Tiff:
    """What a file's first image is: layout, georeference and where its blocks lie."""

    grid: Grid
    bands: int
    kind: str
    compression: int
    predictor: int
    separate: bool
    block: tuple[int, int]  # rows and columns
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    epsg: int | None
    no_data: float | None

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.grid.height // self.block[0])


def tags(f) -> tuple[str, dict[int, tuple]]:
    """The byte order and the fields of the first directory."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise TiffError("no TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read_at(8 if big else 2, at))[0]
    entry, start, inline = (20, at + 8, 8) if big else (12, at + 2, 4)
    data = f.read_at(entry * count, start)
    found = {}
    for k in range(count):
        part = data[entry * k : entry * (k + 1)]
        tag, kind = struct.unpack(f"{order}HH", part[:4])
        number = struct.unpack(f"{order}{'Q' if big else 'I'}", part[4 : 12 if big else 8])[0]
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(f"={code}") * number
        value = part[12 if big else 8 :][:size] if size <= inline else f.read_at(size, struct.unpack(f"{order}{'Q' if big else 'I'}", part[12 if big else 8 :])[0])
        found[tag] = (value,) if kind == 2 else struct.unpack(f"{order}{number * len(code) if len(code) > 1 else number}{code[0]}", value)
    return order, found


def described(path: str) -> Tiff:
    with opened(path) as f:
        order, t = tags(f)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, sample = set(t.get(BITS, (1,))), set(t.get(FORMAT, (1,)))
    if len(bits) != 1 or len(sample) != 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(sample)) not in (1, 2, 3):
        raise TiffError("bands are integers or reals of one size")
    kind = f"{order}{'_uif'[next(iter(sample))]}{next(iter(bits)) // 8}"
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if compression not in (1, 8, 32946) or predictor not in (1, 2, 3):
        raise TiffError(f"compression {compression} with predictor {predictor} isn't read")
    tiled = TILE_OFFSETS in t
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(height, one(ROWS_PER_STRIP, height)), width)
    if MATRIX in t:
        m = t[MATRIX]
        place = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in t and TIE_POINT in t:
        (sx, sy), (i, j, _, x, y) = t[PIXEL_SCALE][:2], t[TIE_POINT][:5]
        place = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        place = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    keys = t.get(GEO_KEYS, ())
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    epsg = next((named[k] for k in (PROJECTED, GEOGRAPHIC) if 0 < named.get(k, 0) < 32767), None)
    text = one(NO_DATA, b"").split(b"\0")[0].strip()
    return Tiff(
        Grid(width, height, *place), bands, kind, compression, predictor, one(PLANAR, 1) == 2 and bands > 1, block, tiled,
        t[TILE_OFFSETS if tiled else STRIP_OFFSETS], t[TILE_BYTES if tiled else STRIP_BYTES], epsg, float(text) if text else None,
    )


def unpredicted(block: np.ndarray, predictor: int, kind: np.dtype) -> np.ndarray:
    """Values of a block (rows, columns, samples as stored) whose differences were stored."""
    if predictor == 2:
        return np.cumsum(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    if predictor == 3:  # bytes of a row by significance, each the difference from the one a sample before
        rows, columns, samples = block.shape
        size = kind.itemsize
        raw = np.frombuffer(block.tobytes(), dtype=np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples)
    return block


def decoded(tiff: Tiff, data: bytes, rows: int) -> np.ndarray:
    """A block's values: rows, columns, bands (one where bands are separate)."""
    kind = np.dtype(tiff.kind)
    samples = 1 if tiff.separate else tiff.bands
    want = rows * tiff.block[1] * samples * kind.itemsize
    data = data if tiff.compression == 1 else zlib.decompress(data)
    if len(data) < want:
        raise TiffError("a block ends early")
    block = np.frombuffer(data[:want], dtype=kind).reshape(rows, tiff.block[1], samples)
    return unpredicted(block, tiff.predictor, kind)


@dataclass
class Blocks(InputPartition):
    first: int
    last: int


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.tiff = described(self.path)
        low, _, high = options.get("rows", ":").partition(":")
        self.rows = (int(low or 0), int(high or self.tiff.grid.height - 1))
        low, _, high = options.get("cols", ":").partition(":")
        self.cols = (int(low or 0), int(high or self.tiff.grid.width - 1))

    def partitions(self):
        t = self.tiff
        each = max(1, CELLS // (t.block[0] * t.block[1]))
        number = t.across * t.down
        return [Blocks(k, min(k + each, number)) for k in range(0, number, each)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        t = self.tiff
        with opened(self.path) as f:
            for k in range(partition.first, partition.last):
                down, across = divmod(k, t.across)
                top, left = down * t.block[0], across * t.block[1]
                rows, cols = min(t.block[0], t.grid.height - top), min(t.block[1], t.grid.width - left)
                if top > self.rows[1] or top + rows <= self.rows[0] or left > self.cols[1] or left + cols <= self.cols[0]:
                    continue  # a block outside the window isn't read
                r, c = (x.reshape(-1) for x in np.mgrid[top : top + rows, left : left + cols])
                inside = (r >= self.rows[0]) & (r <= self.rows[1]) & (c >= self.cols[0]) & (c <= self.cols[1])
                stored = t.block[0] if t.tiled else rows
                whole = None if t.separate else decoded(t, f.read_at(t.sizes[k], t.offsets[k]), stored)
                for band in range(t.bands):
                    at = band * t.across * t.down + k
                    block = whole[:, :, band] if whole is not None else decoded(t, f.read_at(t.sizes[at], t.offsets[at]), stored)[:, :, 0]
                    v = block[:rows, :cols].astype(np.float32).reshape(-1)[inside]
                    gone = np.isnan(v) | (False if t.no_data is None else v == np.float32(t.no_data))
                    yield pa.record_batch([pa.array(np.full(len(v), band, np.int32)), pa.array(r[inside].astype(np.int32)), pa.array(c[inside].astype(np.int32)), pa.array(v, mask=gone)], names=["band", "row", "col", "v"])


class TiffSource(DataSource):
    """``spark.read.format("geotiff")`` with options path, rows and cols (first:last, of the window to read)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "band int, row int, col int, v float"

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def read(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, Tiff]:
    """``band, row, col, v`` of a file, and its description."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("geotiff").options(path=path, **{k: str(v) for k, v in options.items()}).load(), described(path)


def compressed(values: np.ndarray) -> bytes:
    """A tile as stored: single precision, byte planes by significance, differences, deflate."""
    rows, columns = values.shape
    planes = values.astype(">f4").view(np.uint8).reshape(rows, columns, 4).transpose(0, 2, 1).reshape(rows, 4 * columns)
    return zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes(), 6)


def directory(entries: dict[int, tuple[int, bytes, int]], at: int, big: bool) -> bytes:
    """A directory at a place in the file, its longer values behind it."""
    size, word = (20, "Q") if big else (12, "I")
    inline = 8 if big else 4
    head = struct.pack("<Q" if big else "<H", len(entries))
    behind = at + len(head) + size * len(entries) + inline
    body, extra = b"", b""
    for tag in sorted(entries):
        kind, data, count = entries[tag]
        if len(data) <= inline:
            value = data.ljust(inline, b"\0")
        else:
            value = struct.pack(f"<{word}", behind + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        body += struct.pack("<HH", tag, kind) + struct.pack(f"<{word}", count) + value
    return head + body + b"\0" * inline + extra


def write(cells: DataFrame, path: str, grid: Grid, bands: int = 1, epsg: int | None = None, no_data: float | None = None, geographic: bool = False) -> None:
    """Write ``cells(band, row, col, v)``; cells not given are missing: the no-data value, or NaN where there is none.

    Executors fill and compress tiles; the driver appends them to the one file, a partition of compressed tiles at a
    time, and writes the directory last. Files that could pass 4 GB are BigTIFF.
    """
    across, down = -(-grid.width // TILE), -(-grid.height // TILE)
    number = across * down
    empty = np.float32(np.nan if no_data is None else no_data)

    def tile(table: pa.Table) -> pa.Table:
        k = table.column("tile")[0].as_py()
        block = np.full((TILE, TILE), empty, dtype=np.float32)
        known = table.filter(pc.is_valid(table.column("v")))
        block[np.asarray(known.column("row")) % TILE, np.asarray(known.column("col")) % TILE] = known.column("v").to_numpy()
        return pa.table({"tile": pa.array([k], pa.int64()), "data": pa.array([compressed(block)], pa.binary())})

    place = (F.col("band") * number + F.floor(F.col("row") / TILE) * across + F.floor(F.col("col") / TILE)).cast("long")
    given = cells.select(place.alias("tile"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("float").alias("v"))
    every = cells.sparkSession.range(number * bands).select(F.col("id").alias("tile"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(None).cast("float").alias("v"))
    done = every.union(given).groupBy("tile").applyInArrow(tile, "tile long, data binary").orderBy("tile")
    big = number * bands * TILE * TILE * 4 > 2**32 - 2**20
    offsets, sizes = [], []
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
        for row in done.toLocalIterator():
            data = bytes(row["data"])
            offsets.append(f.tell())
            sizes.append(len(data))
            f.write(data + b"\0" * (len(data) % 2))
        short = lambda *v: (3, struct.pack(f"<{len(v)}H", *v), len(v))
        longs = lambda v: (16, struct.pack(f"<{len(v)}Q", *v), len(v)) if big else (4, struct.pack(f"<{len(v)}I", *v), len(v))
        doubles = lambda *v: (12, struct.pack(f"<{len(v)}d", *v), len(v))
        entries = {
            WIDTH: longs([grid.width]), HEIGHT: longs([grid.height]), BITS: short(*[32] * bands), COMPRESSION: short(8), PHOTOMETRIC: short(1), SAMPLES: short(bands),
            PLANAR: short(2 if bands > 1 else 1), PREDICTOR: short(3), TILE_WIDTH: short(TILE), TILE_HEIGHT: short(TILE), TILE_OFFSETS: longs(offsets), TILE_BYTES: longs(sizes), FORMAT: short(*[3] * bands),
        }
        if grid.c or grid.e or grid.f >= 0:
            entries[MATRIX] = doubles(grid.b, grid.c, 0, grid.a, grid.e, grid.f, 0, grid.d, 0, 0, 0, 0, 0, 0, 0, 1)
        else:
            entries |= {PIXEL_SCALE: doubles(grid.b, -grid.f, 0), TIE_POINT: doubles(0, 0, 0, grid.a, grid.d, 0)}
        if epsg is not None:
            entries[GEO_KEYS] = short(1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg)
        if no_data is not None:
            text = f"{no_data:.17g}".encode() + b"\0"
            entries[NO_DATA] = (2, text, len(text))
        at = f.tell()
        f.write(directory(entries, at, big))
        f.seek(8 if big else 4)
        f.write(struct.pack("<Q" if big else "<I", at))
