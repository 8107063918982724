import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.operators.grid import Grid
from cellforge.sources import bil, header, vectors

from .test_rasters import cells, filled, read

HEADER = """DatasetHeader Begin
	Version = "5.0"  # a comment
	DataFile = "sub/data file.dat"
	ByteOrder = LSBFirst
	CoordinateSpace Begin
		Datum = "D"
		Projection = "BMG:EOV"
		Rotation = 0:0:0.0
	CoordinateSpace End
	RasterInfo Begin
		CellType = IEEE4ByteReal
		NullCellValue = -9999
		CellInfo Begin
			Xdimension = 1000
			Ydimension = 1000
		CellInfo End
		NrOfLines = 450
		NrOfCellsPerLine = 640
		RegistrationCoord Begin
			Eastings = 360000
			Northings = 430000
		RegistrationCoord End
		Levels = { 1 2
			"a # b" 3 }
	RasterInfo End
DatasetHeader End
"""


def test_header():
    h = header.RasterHeader.of(HEADER)
    assert (h.grid.width, h.grid.height, h.bands, h.big_endian, h.null_value, h.epsg) == (640, 450, 1, False, -9999, 23700)
    assert h.grid.world(0.0, 0.0) == (360000, 430000)
    block = header.parse(HEADER)
    assert block.child("datasetheader").child("RasterInfo").items("levels") == ["1", "2", "a # b", "3"]
    assert header.parse(header.written(block)) == block
    with pytest.raises(header.HeaderError):
        header.RasterHeader.of("Other Begin\nOther End")
    assert header.data_file("a/b.ers", "sub\\c.dat.", {"a/sub/c.dat", "a/b"}) == "a/sub/c.dat"
    assert header.data_file("a/b.ers", None, {"a/b.dat"}) == "a/b.dat"


@pytest.mark.parametrize(
    ("projection", "datum", "want"),
    [("BMG:EOV", None, 23700), ("NUTM33", None, 32633), ("SUTM56", None, 32756), ("TMAMG55", None, 20255), ("MGA55", None, 28355), ("EPSG:32633", None, 32633), ("GEODETIC", None, 4326), ("RAW", "NAD27", 4267), ("RAW", "RAW", None), (None, None, None), ("LL", None, 4326), ("webmercator", None, 3857), ("HD72/EOV", None, 23700), ("UTM33N", None, 32633), ("utm 7 s", None, 32707), ("RAW", "GDA94", 4283), ("NUTM99", None, None), ("NUTM60", None, 32660), ("TMAMG47", None, None), ("GEODETIC", "NAD27", 4326), ('"EOV"', None, 23700), ("LOCAL", "EPSG:4258", 4258), ("Vendor", "WGS84", None)],
)
def test_coordinate_systems(projection, datum, want):
    assert header.epsg(projection, datum) == want


def test_angles():
    assert header.degrees("-0:30:0") == -0.5 and header.degrees("12:30") == 12.5 and header.degrees(None) == 0


def test_bil_windows(spark, tmp_path):
    path = str(tmp_path / "r.bil")
    with open(path, "wb") as f:
        f.write(b"head")
        for r in range(3):
            for b in range(2):
                f.write(struct.pack("<4f", *(10 * r + c + 0.5 + 100 * b if (r, c, b) != (1, 1, 0) else -9999 for c in range(4))))
    df = bil.read(spark, path, Grid(4, 3), 2, big_endian=False, offset=4, null_value=-9999)
    first = read(df.where("band = 0"))
    assert first[2, 1] == 21.5 and first[1, 1] is None and min(v for v in first.values() if v is not None) == 0.5 and df.count() == 24
    part = bil.read(spark, path, Grid(4, 3), 2, big_endian=False, offset=4, null_value=-9999, rows="1:", cols=":1", bands_read="1:1")
    assert read(part) == {(1, 0): 110.5, (1, 1): 111.5, (2, 0): 120.5, (2, 1): 121.5}
    assert set(read(bil.read(spark, path, Grid(4, 3), 2, big_endian=False, offset=4, step_x=2, step_y=2).where("band = 0"))) == {(0, 0), (0, 2), (2, 0), (2, 2)}
    with pytest.raises(Exception, match="ends within"):
        bil.read(spark, path, Grid(4, 9), 2, big_endian=False).count()


@pytest.mark.parametrize("kind", list(header.CELL_TYPES))
@pytest.mark.parametrize("big", [True, False])
def test_bil_round_trip(spark, tmp_path, kind, big):
    df = filled(spark, 5, 3, lambda x, y: None if (x, y) == (2, 1) else x + 10 * y).withColumn("band", F.lit(0))
    path = str(tmp_path / "w.bil")
    bil.write(df, path, Grid(5, 3), 1, kind, big, 99.0)
    assert read(bil.read(spark, path, Grid(5, 3), 1, cell_type=kind, big_endian=big, null_value=99.0)) == read(df)


def test_whole_numbers_are_clamped():
    assert bil.encoded(np.array([-5, 2.5, 999, np.nan]), "Unsigned8BitInteger", False, None) == bytes([0, 3, 255, 0])


def test_geojson():
    text = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "id": 7, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[5, 6], [7, 8]]}]}},
    ]})
    got = vectors.parse_geojson(text)
    assert [(k, a, len(p)) for _, k, a, p in got] == [("point", "p", 1), ("polygon", "a=1", 3), ("polygon", "a=1 (hole)", 3), ("point", "7", 1), ("point", "7", 1)]
    again = vectors.parse_geojson(vectors.geojson(got))
    assert [(k, a, p) for _, k, a, p in again] == [(k, a, p) for _, k, a, p in got]
    assert len(vectors.parse_geojson(vectors.geojson([(0, "oval", None, [(0.0, 0.0), (2.0, 2.0)])]))[0][3]) == 36


def test_csv_points():
    got = vectors.parse_csv_points("name,EOV_Y,EOV_X,depth\nwell,701234.25,198765,31.5\n")
    assert got == [(0, "point", "name=well; depth=31.5", [(701234.25, 198765.0)])]
    got = vectors.parse_csv_points('# measured in May\n3,125;-8,5;"oak; two stems"\n')
    assert got == [(0, "point", "oak; two stems", [(3.125, -8.5)])]
    assert vectors.parse_csv_points(vectors.csv_points(got))[0][3] == [(3.125, -8.5)]


def test_objects():
    text = 'box(,10.25,20.5,30.75,41.125,1,2,3,4,5,6,0).\npolygon(,7,[11,12,\n13.5,14,15,16.25],1,2,3,4,5,6,7,0).\npoint("the \\"old\\" mill",8.5,-9.25,1,2,3,4,5).\ntext("sign",21,22,Serif,2,9,0,0,0,1,0,0,64,1,["north, uphill"]).\n'
    got = vectors.parse_objects(text)
    assert [(k, a, p) for _, k, a, p in got] == [("box", None, [(10.25, 20.5), (30.75, 41.125)]), ("polygon", None, [(11, 12), (13.5, 14), (15, 16.25)]), ("point", 'the "old" mill', [(8.5, -9.25)]), ("text", "sign", [(21, 22)])]
    again = vectors.parse_objects(vectors.objects(got[:3]))
    assert [(k, a, p) for _, k, a, p in again] == [(k, a, p) for _, k, a, p in got[:3]]


def test_palette_and_extent(spark):
    colours = vectors.parse_palette("// p\n1\t2\t3\n4,5,6 # x\n")
    assert vectors.parse_palette(vectors.palette_text(colours)) == colours
    assert len(colours) == 256 and colours[0] == (1, 2, 3) and colours[255] == (4, 5, 6)
    df = vectors.frame(spark, [(0, "poly", None, [(1.0, 5.0), (3.0, 2.0)])])
    assert tuple(vectors.extent(df).first()) == (1, 2, 3, 5)


def test_cells_helper(spark):
    assert read(cells(spark, [[1, None]])) == {(0, 0): 1, (0, 1): None}
