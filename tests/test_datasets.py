import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.operators import grade, render, sampling, stats, visibility, zones
from cellforge.operators.grid import Grid
from cellforge.operators.tiles import Ground, packed
from cellforge.sources import dataset, geotiff, header

from .test_rasters import cells, filled, read
from .test_sources import HEADER


def banded(spark, *rasters):
    out = None
    for k, df in enumerate(rasters):
        own = df.select(F.lit(k).alias("band"), "row", "col", "v")
        out = own if out is None else out.union(own)
    return out


def by_place(df):
    return {(r.band, r.row, r.col): r.v for r in df.collect()}


@pytest.mark.parametrize("grid", [Grid(300, 270, 10.0, 2.0, 0.0, 50.0, 0.0, -2.0), Grid(300, 270, 1.0, 1.6, 0.6, 2.0, 1.2, -0.8)])
def test_geotiff_round_trip(spark, tmp_path, grid):
    path = str(tmp_path / "a.tif")
    data = banded(spark, filled(spark, 300, 270, lambda x, y: None if x == y else x * 0.37 - y), filled(spark, 300, 270, lambda x, y: x * y))
    geotiff.write(data, path, grid, 2, epsg=23700, no_data=-9999.0)
    got, about = geotiff.read(spark, path)
    assert (about.grid.width, about.grid.height, about.bands, about.epsg, about.no_data, about.predictor, about.compression) == (300, 270, 2, 23700, -9999.0, 3, 8)
    assert about.grid.world(3.0, 4.0) == pytest.approx(grid.world(3.0, 4.0))
    whole = by_place(data)
    assert by_place(got) == whole
    part, _ = geotiff.read(spark, path, rows="250:258", cols="254:260")
    assert by_place(part) == {k: v for k, v in whole.items() if 250 <= k[1] <= 258 and 254 <= k[2] <= 260}
    raw = open(path, "rb").read()
    k = about.offsets[0]
    assert len(zlib.decompress(raw[k : k + about.sizes[0]])) == 256 * 256 * 4


def stripped(order, kind, values, predictor, chunky=True):
    """A plain TIFF in strips of two rows, as other programs write it."""
    data = values.astype(np.dtype(kind).newbyteorder(order))
    height, width, bands = values.shape
    strips = []
    for r in range(0, height, 2):
        part = data[r : r + 2]
        if predictor == 2:
            part = np.diff(part.astype(kind), axis=1, prepend=np.zeros((len(part), 1, bands), kind)).astype(data.dtype)
        strips.append(zlib.compress(part.tobytes()) if predictor > 1 else part.tobytes())
    out = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8)
    code = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [np.dtype(kind).itemsize * 8] * bands), (259, 3, [8 if predictor > 1 else 1]), (273, 4, None), (277, 3, [bands]), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (339, 3, [code] * bands)]
    behind = 8 + 2 + 12 * len(fields) + 4
    extra, body = b"", b""
    at = behind + 400
    offsets = [at + sum(len(s) for s in strips[:k]) for k in range(len(strips))]
    for tag, t, v in fields:
        v = offsets if v is None else v
        raw = struct.pack(f"{order}{len(v)}{'H' if t == 3 else 'I'}", *v)
        if len(raw) > 4:
            place, extra = struct.pack(f"{order}I", behind + len(extra)), extra + raw
        else:
            place = raw.ljust(4, b"\0")
        body += struct.pack(f"{order}HHI", tag, t, len(v)) + place
    return out + struct.pack(f"{order}H", len(fields)) + body + b"\0" * 4 + extra.ljust(400, b"\0") + b"".join(strips)


@pytest.mark.parametrize(("order", "kind", "predictor"), [("<", "u1", 1), (">", "i2", 2), ("<", "f4", 1), (">", "u2", 1), ("<", "u4", 2), (">", "f8", 1)])
def test_geotiff_of_other_programs(spark, tmp_path, order, kind, predictor):
    values = (np.arange(5 * 4 * 3).reshape(5, 4, 3) * 3) % 101
    path = tmp_path / "b.tif"
    path.write_bytes(stripped(order, kind, values, predictor))
    got, about = geotiff.read(spark, str(path))
    assert not about.separate and by_place(got) == {(b, r, c): float(values[r, c, b]) for r in range(5) for c in range(4) for b in range(3)}
    (tmp_path / "c.tif").write_bytes(b"no tiff at all")
    with pytest.raises(geotiff.TiffError):
        geotiff.described(str(tmp_path / "c.tif"))


def small(spark, grid=Grid(4, 3, 100.0, 10.0, 0.0, 200.0, 0.0, -10.0)):
    head = dataset.placed(dataset.head_of(HEADER), grid, 1, "IEEE4ByteReal", -9999.0)
    return dataset.Dataset(head, banded(spark, filled(spark, 4, 3, lambda x, y: None if (x, y) == (1, 1) else 10 * y + x + 0.5)), grid)


def test_datasets_are_saved_and_loaded(spark, tmp_path):
    data = small(spark)
    data.head.put("Remark", "kept as it is")
    path = str(tmp_path / "x.ers")
    saved = dataset.save(data, path, cell_type="Signed16BitInteger", big_endian=True)
    text = (tmp_path / "x.ers").read_text()
    assert 'Name = "x.ers"' in text and "LastUpdated" in text and "kept as it is" in text and (tmp_path / "x").stat().st_size == 24
    back = dataset.load(spark, path)
    assert by_place(back.cells) == {(0, r, c): None if (r, c) == (1, 1) else float(10 * r + c + 1) for r in range(3) for c in range(4)}
    assert back.grid == data.grid and back.bands == 1 and header.RasterHeader.of(text).big_endian
    assert dataset.load(spark, path, rows="1:1").cells.count() == 4
    again = dataset.save(saved, str(tmp_path / "y.ers"), name=False, time=False, data_name="y.dat")
    assert again.head.get("Name") == "x.ers" and (tmp_path / "y.dat").exists()
    with pytest.raises(header.HeaderError):
        dataset.save(data, path, cell_type="Other")


def test_derived_headers(spark):
    data = small(spark)
    made = dataset.derived(data, filled(spark, 4, 3, lambda x, y: x), "Slope", "°")
    info = made.head.child("RasterInfo")
    assert info.get("CellType") == "IEEE4ByteReal" and info.get("NullCellValue") is None and info.child("BandId").get("Value") == "Slope"
    assert made.head.get("DataFile") is None and made.cells.count() == 12
    grid = data.grid.window(1, 1, 2, 2)
    cut = dataset.part(data, data.cells, grid).head.child("RasterInfo")
    assert (cut.number("NrOfLines"), cut.number("NrOfCellsPerLine"), cut.child("RegistrationCoord").number("Eastings"), cut.child("RegistrationCoord").number("Northings")) == (2, 2, 110, 190)
    image = spark.createDataFrame([(0, 0, 1, 2, 3, 255), (0, 1, 4, 5, 6, 0)], "row int, col int, r int, g int, b int, alpha int")
    rgb = dataset.coloured(data, image)
    assert rgb.bands == 3 and by_place(rgb.cells) == {(0, 0, 0): 1, (1, 0, 0): 2, (2, 0, 0): 3, (0, 0, 1): None, (1, 0, 1): None, (2, 0, 1): None}
    two = dataset.with_bands(data, [(filled(spark, 2, 2, lambda x, y: k), Grid(2, 2)) for k in (5, 6)])
    assert two.bands == 2 and two.grid.width == 2 and two.head.child("RasterInfo").number("NrOfLines") == 2
    assert {r.v for r in dataset.replaced(two, 1, filled(spark, 2, 2, lambda x, y: 9), Grid(2, 2)).cells.where("band = 1").collect()} == {9}
    for call in (lambda: dataset.replaced(two, 2, None, Grid(2, 2)), lambda: dataset.replaced(two, 0, None, Grid(3, 2)), lambda: dataset.with_bands(data, []), lambda: dataset.same_size({"b1": Grid(2, 2), "b2": Grid(2, 3)})):
        with pytest.raises(ValueError):
            call()
    merged = dataset.mosaic([data, small(spark, Grid(4, 3, 120.0, 10.0, 0.0, 200.0, 0.0, -10.0))])
    assert (merged.grid.width, merged.grid.height, merged.bands) == (6, 3, 1) and merged.cells.count() == 18


def test_csv_exports(spark, tmp_path):
    line = sampling.line_points(spark.range(1), (0.5, 0.5), (3.5, 0.5), 4)
    ramp = filled(spark, 4, 1, lambda x, y: x)
    profile = line.join(sampling.bilinear(line.select("id", "x", "y"), ramp, Grid(4, 1)), "id")
    dataset.profile_csv([("height", profile), ("twice", profile.withColumn("value", F.col("value") * 2))], str(tmp_path / "p"))
    text = "".join(p.read_text() for p in (tmp_path / "p").glob("*.csv"))
    assert text.startswith("distance_m,x,y,height,twice\n0.0,0.5,0.5,0.0,0.0\n1.0,1.5,0.5,1.0,2.0\n")
    found = zones.zonal(ramp, zones.polygons(ramp, [("a", [(0, 0), (2, 0), (2, 1), (0, 1)]), ("b", [(9, 9), (10, 9), (10, 10)])]), Grid(4, 1))
    zones.zonal_csv(found, str(tmp_path / "z"))
    text = "".join(p.read_text() for p in (tmp_path / "z").glob("*.csv"))
    assert "zone,attribute,cells,nodata,min,max,mean,std,sum,area" in text and "a,,2,0,0,1,0.5,0.5,1,2" in text.replace('""', "")


def test_palettes():
    grey = render.BUILT_IN["Grayscale"]
    assert [tuple(c) for c in grey.colours[[0, 128, 255]]] == [(0, 0, 0, 255), (128, 128, 128, 255), (255, 255, 255, 255)]
    assert tuple(grey.sample(np.array([0.5]))[0]) == (128, 128, 128, 255) and tuple(grey.sample(np.array([np.nan]))[0]) == render.CLEAR
    assert tuple(grey.reversed().colours[0]) == (255, 255, 255, 255) and len(grey.stops(3)) == 3 and grey.stops(1)[1][1] == (255, 255, 255, 255)
    sea = render.BUILT_IN["Land & Sea"]
    assert tuple(sea.colours[0]) == (0x08, 0x30, 0x6B, 255) and tuple(sea.colours[255]) == (255, 255, 255, 255)
    assert tuple(render.Palette.from_rows("r", [(1, 2, 300), (4, -5, 6)]).colours[9]) == (4, 0, 6, 255)
    image = np.zeros((2, 256, 4), dtype=np.uint8)
    image[1, :, 0] = np.arange(256)
    assert render.Palette.from_image("i", image).colours[77, 0] == 77
    assert tuple(render.Palette.from_colours("c", ["#f00", "#00ff0080"]).colours[255]) == (0, 255, 0, 128)
    assert len({tuple(c) for c in render.Palette.uniform("u", "#123456").colours}) == 1
    library = render.Library()
    assert library.get("VIRIDIS").name == "Viridis" and library.get("land &amp; sea").name == "Land & Sea" and library.get("x") is None
    assert library.get_or_default(None).name == "Grayscale" and len(library.names) == 10
    library.add(render.Palette.uniform("viridis", "#000"))
    assert len(library.names) == 10 and library.get("Viridis").colours[9, 0] == 0
    with pytest.raises(ValueError):
        render.hex_colour("#12")


def test_colourings_agree(spark):
    df = filled(spark, 40, 5, lambda x, y: None if (x, y) == (3, 3) else x * 7 - y)
    values = read(df)
    for how in (
        render.Colouring(render.BUILT_IN["Viridis"], 10, 200), render.Colouring(render.BUILT_IN["Spectrum"], 0, 270, 0.5, True, opacity=77),
        render.Colouring(render.BUILT_IN["Elevation"], 0, 100, mode="discrete", classes=5), render.Colouring(render.BUILT_IN["Temperature"], 0, 300, 2.0, mode="nearest", no_data=(1, 2, 3, 4)),
        render.Colouring(render.BUILT_IN["Viridis"], 5, 5),
    ):
        got = {(r.row, r.col): r.argb for r in render.coloured(df, "v", how).collect()}
        keys = list(values)
        want = render.packed(how.colours(np.array([np.nan if values[k] is None else values[k] for k in keys])))
        assert [got[k] for k in keys] == want.tolist()
        table = {(r.row, r.col): r.argb for r in render.rendered(df, "v", how).collect()}
        near = np.array([[table[k], got[k]] for k in keys], dtype=np.int32).view(np.uint32).astype(np.int64)
        if how.mode == "continuous":
            assert (np.abs((near[:, :1] >> [0, 8, 16, 24] & 255) - (near[:, 1:] >> [0, 8, 16, 24] & 255)) <= 2).all()
    bands = render.bands(spark.createDataFrame([(0, 0, render.packed(np.array([(1, 2, 3, 255)]))[0].item()), (0, 1, 0)], "row int, col int, argb int")).collect()
    assert [tuple(r)[2:] for r in bands] == [(1, 2, 3), (None, None, None)]
    flat = filled(spark, 4, 4, lambda x, y: 5)
    assert render.value_range(flat, "v") == (5, 5) and render.stretch_range(flat, "v") == (5, 6) and tuple(stats.percentile_range(flat, "v").first()) == (5, 5)
    assert render.value_range(df, "v", "minmax") == (-4, 273) and render.value_range(df, "v", "sigma")[0] == -4
    styles = {k: render.style(k, df) for k in ("hillshade", "slope", "aspect", "curvature", "flowacc", "bandmath")}
    assert styles["hillshade"].high == 255 and styles["aspect"].high == 360 and styles["curvature"].low == -styles["curvature"].high and styles["flowacc"].gamma == 0.35 and styles["bandmath"] is None
    assert render.style("filter", df, kind="sobel").low == 0 and render.style("filter", df, kind="gaussian") is None


def test_views_of_all_sizes(spark):
    flat = filled(spark, 30, 30, lambda x, y: 3)
    assert set(read(visibility.viewshed(flat, Grid(30, 30), 0, 0, side=8)).values()) == {1}
    hills = [[(x * 37 + y * 53) % 17 + (8 if (x - 15) ** 2 + (y - 9) ** 2 < 9 else 0) for x in range(33)] for y in range(21)]
    data, grid = cells(spark, hills), Grid(33, 21)
    for at in ((0, 0), (32, 20), (16, 3)):
        whole = read(visibility.viewshed(data, grid, *at, side=64))
        assert whole == read(visibility.viewshed(data, grid, *at, side=4)) and 0 in whole.values() and 1 in whole.values()
    for at in ((-1, 0), (0, 21)):
        with pytest.raises(ValueError):
            visibility.viewshed(data, grid, *at)


def test_samplers_and_measures(spark):
    plane = filled(spark, 8, 6, lambda x, y: 3 + 2 * (x + 0.5) - 1.5 * (y + 0.5))
    grid = Grid(8, 6, 100.0, 2.0, 0.0, 50.0, 0.0, -2.0)
    points = spark.createDataFrame([(1, 2.2, 3.3), (2, 0.1, 5.9), (3, 7.0, 0.0), (4, -1.0, 2.0)], "id long, x double, y double")
    got = {r.id: r.value for r in sampling.SAMPLERS["bezier"](points, plane, grid, rows=2).collect()}
    assert got[4] is None and all(got[i] == pytest.approx(3 + 2 * x - 1.5 * y, abs=1e-5) for i, x, y in ((1, 2.2, 3.3),))
    fine, _ = sampling.subdivide(plane, grid, 2, "bezier")
    assert read(fine)[5, 5] == pytest.approx(3 + 2 * 2.75 - 1.5 * 2.75, abs=1e-5)
    world = spark.createDataFrame([(1, 105.0, 45.0), (2, 0.0, 0.0)], "id long, x double, y double")
    seen = {(r.id, r.layer): (r.cell, r.bilinear, r.bezier) for r in sampling.identify(world, [("a", plane, grid), ("b", plane, grid)]).collect()}
    assert len(seen) == 4 and seen[1, "a"] == pytest.approx((4.25, 4.25, 4.25), abs=1e-5) and seen[2, "b"] == (None, None, None)
    line = sampling.world_line(plane, grid, (101.0, 49.0), (111.0, 49.0), 6)
    values = line.join(sampling.bilinear(line.select("id", "x", "y"), plane, grid), "id").orderBy("id").collect()
    assert [r.distance for r in values] == [0, 2, 4, 6, 8, 10] and [r.value for r in values] == pytest.approx([3.25, 5.25, 7.25, 9.25, 11.25, 13.25])
    a, b = (spark.createDataFrame([(0, v), (1, None)], "id long, value double") for v in (5.0, 3.0))
    assert [r.value for r in sampling.difference(a, b).orderBy("id").collect()] == [2, None]
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    crossing = spark.range(1).select(zones.crosses(p(0, 0), p(4, 4), p(0, 4), p(4, 0)), zones.crosses(p(0, 0), p(1, 1), p(2, 2), p(3, 0)), zones.crosses(p(0, 0), p(4, 0), p(2, 0), p(2, 5))).first()
    assert tuple(crossing) == (True, False, True)
    pair = plane.select("row", "col", F.lit(1.0).alias("a"), F.col("col").cast("double").alias("b"))
    spans = zones.row_spans(zones.polygons(plane, [("z", [(0, 0), (2, 0), (2, 6), (0, 6)])]), Grid(8, 6))
    summary, raster = stats.change_within(pair, "a", "b", spans, 2.0)
    assert (summary.first().n, summary.first().cut, summary.first().fill) == (12, 12, 0) and sum(v is not None for v in read(raster).values()) == 12
    assert {(r.bin, r.n) for r in stats.display_histogram(filled(spark, 4, 1, lambda x, y: x), "v", 4).collect()} == {(0, 1), (1, 1), (2, 1), (3, 1)}
    layers = zones.zonal_layers([("a", plane, Grid(8, 6)), ("b", plane, Grid(8, 6))], zones.boxes(spark.createDataFrame([("q", 0.0, 0.0, 2.0, 2.0)], "zone string, min_x double, min_y double, max_x double, max_y double")))
    assert {(r.layer, r.n) for r in layers.collect()} == {("a", 4), ("b", 4)}
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 2.0), (2, 2, 2.0, 2.0)], "line long, seq long, x double, y double")
    steps = sampling.polylines_points(lines, 1.0).collect()
    assert sorted((r.line, r.id) for r in steps) == [(1, k) for k in range(6)] + [(2, k) for k in range(3)]
    assert max(r.distance for r in steps if r.line == 1) == 5 and zones.nearest(points, spark.createDataFrame([(5, "f", [(2.0, 3.0)])], "seq long, attribute string, points array<struct<x:double,y:double>>")).count() == 4


def test_tiles(spark):
    data = cells(spark, [[y * 20 + x if (x + y) % 7 else None for x in range(20)] for y in range(11)])
    ground = Ground([(r.tile_row, r.tile_col, bytes(r.data)) for r in packed(data, 8).collect()], 8)
    want = read(data)
    rows, cols = (x.reshape(-1) for x in np.mgrid[0:11, 0:20])
    assert [None if np.isnan(v) else v for v in ground.at(rows, cols).tolist()] == [want[k] for k in zip(rows.tolist(), cols.tolist(), strict=True)]
    assert np.isnan(ground.at(np.array([50, -1]), np.array([2, 2]))).all() and grade.apart(0.1, 2 * np.pi) == pytest.approx(0.1)
