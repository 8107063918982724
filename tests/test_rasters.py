import math

import pytest
from pyspark.sql import functions as F

from cellforge.operators import contour, focal, grid, hydro, render, sampling, stats, zones
from cellforge.operators.grid import Grid


def cells(spark, rows, parts=1):
    data = [(r, c, None if v is None else float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)]
    return spark.createDataFrame(data, "row int, col int, v float").repartition(parts)


def filled(spark, width, height, f):
    return cells(spark, [[f(x, y) for x in range(width)] for y in range(height)])


def read(df, value="v"):
    return {(r["row"], r["col"]): r[value] for r in df.collect()}


def test_georeference():
    g = Grid.of_header(640, 450, 1000, 1000, 360000, 430000)
    assert g.world(0, 0) == (360000, 430000) and g.world(1, 0)[0] == 361000 and g.world(0, 1)[1] == 429000
    assert g.pixel(*g.world(123.0, 77.0)) == pytest.approx((123, 77))
    assert Grid(2, 2, f=-3.0, b=2.0).cell_area == 6
    assert g.mismatch(g) is None and g.mismatch(Grid(1, 1)) == "size"
    assert Grid(10, 10, 0, 1, 0, 10, 0, -1).bounds() == (0, 0, 10, 10)
    assert grid.clip_window(Grid(10, 10, 0, 1, 0, 10, 0, -1), (2.5, 3.5, 4.2, 8.0)) == (2, 2, 3, 5)
    assert grid.overview_step(Grid(4000, 2000), 1000, 1000) == 4


def test_no_data_and_crop(spark):
    df = grid.normalised(cells(spark, [[1, -9999], [float("nan"), 4]]), "v", -9999.0)
    assert read(df) == {(0, 0): 1, (0, 1): None, (1, 0): None, (1, 1): 4}
    out, cut = grid.crop(cells(spark, [[5, 5], [5, 5]]), Grid(2, 2), 1, 1, 3, 3, "v")
    assert sum(v is not None for v in read(out).values()) == 1 and (cut.width, cut.height, cut.a, cut.d) == (3, 3, 1, 1)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1e8), (2.0, 1e8)], "a double, b double")
    got = stats.change(df, "a", "b", 1.0).first()
    assert (got["mean"], got["std"]) == (99999998.5, 0.5)
    assert tuple(stats.statistics(df.where("a > 9"), "a").first()) == (0, 0, 0, 0, 0)


def test_change_of_two_by_two(spark):
    df = spark.createDataFrame([(10.0, 8.0), (10.0, 11.0), (10.0, 10.0), (10.0, 13.0)], "a double, b double")
    got = stats.change(df, "a", "b", Grid(2, 2, 100, 2, 0, 200, 0, -3).cell_area, 1.5).first()
    assert (got["n"], got["mean"], got["n_beyond"], got["area_beyond"], got["cut"], got["fill"], got["net"]) == (4, 0.5, 2, 12, 12, 24, 12)


def test_zones(spark):
    df = filled(spark, 10, 10, lambda x, y: None if (x, y) == (2, 2) else x + 10 * y)
    got = zones.zonal(df, zones.polygons(df, [("a", [(1, 1), (4, 1), (4, 4), (1, 4)])]), Grid(10, 10)).first()
    assert (got["n"], got["n_missing"], got["min"], got["max"], got["area"]) == (8, 1, 11, 33, 9)
    small = filled(spark, 3, 3, lambda x, y: 1 + x + 3 * y)
    rings = [("huge", [(-1e20, -1e20), (1e20, -1e20), (1e20, 1e20), (-1e20, 1e20)]), ("bow", [(0, 0), (3, 3), (0, 3), (3, 0)])]
    got = {r["zone"]: (r["n"], r["sum"]) for r in zones.zonal(small, zones.polygons(small, rings), Grid(3, 3)).collect()}
    assert got["huge"] == (9, 45) and got["bow"][0] == 4


def test_measures_and_smoothing(spark):
    df = zones.polygons(spark.range(0), [("sq", [(0, 0), (2, 0), (2, 2), (0, 2)]), ("one", [(1, 1)])])
    got = {r["zone"]: (r["p"], r["a"], r["l"]) for r in df.select("zone", zones.perimeter(F.col("points")).alias("p"), zones.area(F.col("points")).alias("a"), zones.length(F.col("points")).alias("l")).collect()}
    assert got == {"sq": (8, 4, 6), "one": (0, 0, 0)}
    line = zones.polygons(spark.range(0), [("l", [(0, 0), (4, 0), (4, 4)])]).select(zones.smoothed(F.col("points")).alias("p")).first()["p"]
    assert [(q["x"], q["y"]) for q in line] == [(0, 0), (3, 0), (4, 1), (4, 4)]


def test_terrain(spark):
    flat = focal.neighbours(filled(spark, 6, 6, lambda x, y: 100), 6, 6)
    assert set(read(focal.slope(flat)).values()) == {0} and set(read(focal.aspect(flat)).values()) == {-1}
    assert read(focal.hillshade(flat))[2, 2] == pytest.approx(math.sin(math.radians(45)) * 255, rel=1e-6)
    ramp = focal.neighbours(filled(spark, 6, 6, lambda x, y: 2 * x), 6, 6)
    assert read(focal.slope(ramp))[3, 3] == pytest.approx(math.degrees(math.atan(2)), rel=1e-6)
    assert read(focal.aspect(ramp))[3, 3] == pytest.approx(270)
    half = focal.neighbours(filled(spark, 6, 6, lambda x, y: 0.5 * x), 6, 6)
    assert read(focal.slope(half, percent=True))[3, 3] == pytest.approx(50)
    dome = focal.neighbours(filled(spark, 9, 9, lambda x, y: 100 - 0.5 * ((x - 4) ** 2 + (y - 4) ** 2)), 9, 9)
    assert read(focal.curvature(dome))[2, 3] == pytest.approx(2.0)
    assert read(focal.curvature(dome, "profile"))[2, 3] == pytest.approx(1.0) and read(focal.curvature(dome, "plan"))[4, 4] == pytest.approx(1.0)


def test_convolution(spark):
    ramp = focal.neighbours(filled(spark, 8, 8, lambda x, y: 2 * x), 8, 8)
    for azimuth, want in ((270, 2), (90, -2), (0, 0)):
        kernel, divisor = focal.emboss_kernel(azimuth)
        assert read(focal.convolve3(ramp, kernel, divisor))[4, 4] == pytest.approx(want)
    plane = focal.neighbours(filled(spark, 6, 6, lambda x, y: 3 * x + 4 * y), 6, 6)
    assert read(focal.sobel(plane))[3, 3] == pytest.approx(5)
    gap = focal.neighbours(filled(spark, 7, 7, lambda x, y: None if (x, y) in ((3, 3), (3, 4)) else 5), 7, 7)
    assert read(focal.convolve3(gap, focal.MEAN3, 9.0))[2, 3] == 5 and read(focal.convolve3(gap, focal.MEAN3, 9.0))[3, 3] is None
    assert read(focal.convolve3(gap, focal.MEAN3, 9.0, fill=False))[2, 3] is None


def test_gaussian_of_gaps(spark):
    f = lambda x, y: None if (x, y) in ((3, 4), (4, 3)) else x * x + y
    got = read(focal.gaussian(filled(spark, 9, 9, f), 1.0, Grid(9, 9)))[4, 4]
    weights = {(i, j): math.exp(-0.5 * i * i) * math.exp(-0.5 * j * j) for i in range(-3, 4) for j in range(-3, 4) if f(4 + i, 4 + j) is not None}
    assert got == pytest.approx(sum(w * f(4 + i, 4 + j) for (i, j), w in weights.items()) / sum(weights.values()), rel=1e-6)


def test_hydrology(spark):
    ramp = hydro.flow_direction(filled(spark, 5, 5, lambda x, y: 10 * (5 - x)), 5, 5)
    assert all(read(ramp)[r, c] == 1 for r in range(5) for c in range(4))
    acc = read(hydro.flow_accumulation(ramp))
    assert [acc[2, c] for c in range(5)] == [0, 1, 2, 3, 4]
    bowl = hydro.flow_direction(filled(spark, 5, 5, lambda x, y: (x - 2) ** 2 + (y - 2) ** 2), 5, 5)
    assert read(bowl)[2, 2] == 0
    valley = hydro.flow_accumulation(hydro.flow_direction(cells(spark, [[30, 20, 10], [25, 15, 5], [30, 20, 10]]), 3, 3))
    assert read(valley)[1, 1] == 3 and read(valley)[1, 2] == 8
    loop = spark.createDataFrame([(0, 0, 1), (0, 1, 16)], "row int, col int, v int")
    with pytest.raises(hydro.CycleError):
        hydro.flow_accumulation(loop)


def test_sampling(spark):
    ramp = filled(spark, 10, 10, lambda x, y: x)
    points = spark.createDataFrame([(1, 5.5, 5.5), (2, 5.0, 5.5), (3, -1.0, 5.0)], "id long, x double, y double")
    assert {r["id"]: r["value"] for r in sampling.bilinear(points, ramp, Grid(10, 10)).collect()} == {1: 5, 2: 4.5, 3: None}
    impulse = filled(spark, 9, 9, lambda x, y: 90 if (x, y) == (4, 4) else 0)
    at = spark.createDataFrame([(1, 4.5, 4.5)], "id long, x double, y double")
    assert sampling.bspline(at, impulse, Grid(9, 9)).first()["value"] == pytest.approx(40)
    vertices = spark.createDataFrame([(0, 2.5, 2.5), (1, 12.5, 2.5), (2, 12.5, 7.5)], "seq long, x double, y double")
    line = sampling.polyline_points(vertices, 1.0)
    assert line.count() == 16 and line.agg(F.max("distance")).first()[0] == 15
    straight = sampling.line_points(ramp, (0.5, 5.5), (9.5, 5.5), 10)
    profile = straight.join(sampling.bilinear(straight.select("id", "x", "y"), ramp, Grid(10, 10)), "id")
    assert sampling.surface_length(profile).first()["length"] == pytest.approx(9 * math.sqrt(2))


def test_mosaic(spark):
    a, b = filled(spark, 10, 5, lambda x, y: 1), filled(spark, 10, 5, lambda x, y: 3)
    first, second = Grid(10, 5, 0, 1, 0, 5, 0, -1), Grid(10, 5, 5, 1, 0, 5, 0, -1)
    for rule, want in (("first", 1), ("last", 3), ("average", 2)):
        out, size = sampling.mosaic([(a, first), (b, second)], rule)
        got = read(out)
        assert (size.width, size.height) == (15, 5) and got[2, 7] == want and got[2, 2] == 1 and got[2, 12] == 3


def test_contours(spark):
    assert contour.levels(0, 10, 2.5) == [0, 2.5, 5, 7.5, 10]
    got = [r for r in contour.segments(filled(spark, 5, 4, lambda x, y: x), 2.5).collect() if r["level"] == 2.5]
    assert len(got) == 3 and all(r["x1"] == 3.0 and r["x2"] == 3.0 for r in got)
    saddle = contour.segments(cells(spark, [[0, 10], [10, 0]]), 5.0)
    assert saddle.where("level = 5").count() == 2


def test_colours(spark):
    df = spark.createDataFrame([(0, 0, 10.0, 128.0, 250.0)], "row int, col int, a double, b double, c double")
    assert tuple(render.composite(df, "a", "b", "c", [(0, 255)] * 3).first()) == (0, 0, 10, 128, 250, 255)
    grey = render.ramp([(0, 0, 0), (255, 255, 255)])
    got = [r["argb"] & 255 for r in render.argb(filled(spark, 3, 1, lambda x, y: x), "v", grey, 0, 2).orderBy("col").collect()]
    assert got == [0, 128, 255]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rows = [[(x * 7 + y * 13) % 11 for x in range(12)] for y in range(9)]
    got = read(focal.gaussian(cells(spark, rows, parts), 1.0, Grid(12, 9)))
    weights = [math.exp(-0.5 * i * i) for i in range(-3, 4)]
    assert got == read(focal.weighted(cells(spark, rows), weights, Grid(12, 9), rows=2))
    near = focal.neighbours(cells(spark, rows, parts), 12, 9)
    assert read(focal.slope(near)) == read(focal.slope(focal.neighbours(cells(spark, rows), 12, 9, rows=2)))


def test_rasters_larger_than_their_files_are_not_broadcast(spark, tmp_path):
    side = 512
    at = str(tmp_path / "few")
    spark.range(side * side // 64).coalesce(1).write.parquet(at)  # small on disk, 64 cells a row
    key = F.col("id") * 64 + F.col("k")
    found = spark.read.parquet(at).select("id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(F.floor(key / side).cast("int").alias("row"), (key % side).cast("int").alias("col"), key.cast("float").alias("v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    dense = grid.dense(found, Grid(side, side), "v")
    assert "Broadcast" not in plan(dense) and dense.where("v IS NOT NULL").count() == side * side
    assert "Broadcast" in plan(grid.dense(found.where("row < 8"), Grid(side, 8), "v"))
    flows = hydro.flow_accumulation(found.select("row", "col", F.when(F.col("col") < side - 1, 1).otherwise(0).alias("v")))
    assert "Broadcast" not in plan(flows) and flows.where("col = v").count() == side * side
