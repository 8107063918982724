import pytest

from cellforge.operators.grid import Grid
from cellforge.plans import recipes

from .test_rasters import filled, read


def test_kernels_as_text():
    assert recipes.parse_kernel("-1 0 1") == [[-1, 0, 1]] and recipes.parse_kernel("1/4;0,5;1") == [[0.25], [0.5], [1]]
    assert recipes.parse_kernel(recipes.kernel_text([[1, 2.5, 3]])) == [[1, 2.5, 3]]
    for bad in ("", "1 2", "1 2 3;1"):
        with pytest.raises(ValueError):
            recipes.parse_kernel(bad)


def test_filters(spark):
    impulse = (filled(spark, 9, 9, lambda x, y: 121 if (x, y) == (4, 4) else 0), Grid(9, 9))
    got = read(recipes.Recipe("filter", "a", {"kind": "DigiTerraGaussian"}).apply(impulse)[0])
    assert (got[4, 4], got[3, 4], got[3, 3], got[2, 2]) == (17, 11, 7, 1)
    ramp = (filled(spark, 9, 9, lambda x, y: 2 * x), Grid(9, 9))
    want = {"emboss": 0.0, "mean": 8.0, "sharpen": 8.0, "sobel": 2.0, "laplace": 0.0, "gaussian": 8.0, "localrelief": 0.0}
    for kind, value in want.items():
        got = read(recipes.Recipe("filter", "a", {"kind": kind, "azimuth": "0", "radius": "3"}).apply(ramp)[0])
        assert got[4, 4] == pytest.approx(value, abs=1e-6), kind
    with pytest.raises(ValueError):
        recipes.Recipe("filter", "a", {"kind": "other"}).apply(ramp)
    with pytest.raises(ValueError):
        recipes.Recipe("other", "a").apply(ramp)


def test_project_round_trip_and_resolution(spark, tmp_path):
    layers = [
        recipes.Layer("a", path=str(tmp_path / "data" / "a.ers")),
        recipes.Layer("b", recipe=recipes.Recipe("bandmath", "a", {"expr": "b1 * 2"})),
        recipes.Layer("c", recipe=recipes.Recipe("slope", "b", {"units": "percent"})),
        recipes.Layer("d", recipe=recipes.Recipe("clip", "c", {"minX": "1", "minY": "1", "maxX": "3", "maxY": "3"})),
        recipes.Layer("e", recipe=recipes.Recipe("slope", "e")),
    ]
    at = str(tmp_path / "p.rfproj")
    recipes.Project(layers).save(at)
    assert '"data/a.ers"' in (tmp_path / "p.rfproj").read_text()
    project = recipes.Project.load(at)
    assert project.layers == layers
    cells, grid = project.resolve("d", lambda layer: (filled(spark, 6, 6, lambda x, y: x), Grid(6, 6)))
    assert (grid.width, grid.height) == (2, 2) and set(read(cells).values()) == {200}
    with pytest.raises(ValueError):
        project.resolve("e", lambda layer: None)
    (tmp_path / "n.rfproj").write_text('{"version": 3}')
    with pytest.raises(ValueError):
        recipes.Project.load(str(tmp_path / "n.rfproj"))


def test_recipes_take_the_keys_of_saved_projects(spark):
    ramp = (filled(spark, 12, 12, lambda x, y: x * x), Grid(12, 12, 100.0, 2.0, 0.0, 50.0, 0.0, -2.0))
    run = lambda name, **p: recipes.Recipe(name, "a", p).apply(ramp)
    lines = run("contours", interval="10", min="20", max="60", index="2", minlen="1").collect()
    assert {r.level for r in lines} == {20.0, 30.0, 40.0, 50.0, 60.0} and {r.level for r in lines if r.is_index} == {20.0, 40.0, 60.0}
    assert all(100 <= q.x <= 124 and 26 <= q.y <= 50 for r in lines for q in r.points)
    assert {r.level for r in run("contours", interval="50", factor="2").collect()} == {0.0, 50.0, 100.0}
    fine, grid = run("bezier", factor="2", x="2", y="3", w="4", h="5")
    assert (grid.width, grid.height, grid.a, grid.d) == (8, 10, 104.0, 44.0) and fine.count() == 80
    whole = read(run("bezier", factor="2")[0])
    assert all(v == whole[r + 6, c + 4] for (r, c), v in read(fine).items())
    profile, plan = (read(run("curvature", type=t)[0]) for t in ("Profile", "Plan"))
    assert profile[5, 5] != plan[5, 5]
    image = run("swissrelief")[0].collect()
    assert len(image) == 144 and {r.alpha for r in image} == {255}
    high, low = (next(r for r in image if (r.row, r.col) == (5, c)) for c in (10, 1))
    assert high.b > high.r and low.r == low.b
    assert run("bandmath", expr="b1 + 1")[0].count() == 144
    plane = (filled(spark, 100, 100, lambda x, y: 0.125 * (x + 0.5)), Grid(100, 100, 0.0, 1.0, 0.0, 100.0, 0.0, -1.0))
    line = recipes.Recipe("neutral-line", "a", {"x": "40", "y": "50", "grade": "5", "length": "10", "branch": "1"}).apply(plane).collect()
    assert [r.stop for r in line] == ["MaximumLength"] and line[0].samples[-1].x == pytest.approx(44) and abs(line[0].samples[-1].y - 50) == pytest.approx(10 * 0.84**0.5)
    way = recipes.Recipe("neutral-route", "a", {"x": "40", "y": "50", "endX": "44", "endY": "50"}).apply(plane).first()
    assert way.status == "Success" and way.length == pytest.approx(10)
    stored = '{"Version": 1, "SurfaceMethod": "bilinear", "GradePercent": 5, "TerrainDeviationThreshold": 0.5, "Vertices": [[0, 0, 1, 0], [3, 4, 1.25, 5]], "Warnings": [0], "MaximumDeviations": [0.1]}'
    assert recipes.Recipe("neutral-design", "a", {"design": stored}).apply(plane).first().length == 5
