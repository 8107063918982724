import math

import numpy as np
import pytest

from cellforge.operators import contour, fill, focal, hydro, kernels, visibility
from cellforge.operators.grid import Grid

from .test_rasters import cells, filled, read


@pytest.mark.parametrize("rows", [None, 1, 4])
def test_convolve_and_strips(spark, rows):
    f = lambda x, y: None if (x, y) in ((3, 3), (5, 0)) else (x * 7 + y * 5) % 13
    df, g = filled(spark, 9, 8, f), Grid(9, 8)
    three = read(focal.convolve3(focal.neighbours(df, 9, 8), focal.SOBEL_X, 8.0))
    got = read(kernels.convolve(df, g, focal.SOBEL_X, 8.0, rows=rows))
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in three.items()}
    assert all(v is None or v == pytest.approx(three[k], abs=1e-6) for k, v in got.items())
    wide = read(kernels.convolve(filled(spark, 9, 9, lambda x, y: 10 * y + x), Grid(9, 9), [[-1, 0, 1]], 2, 7, rows=rows))
    tall = read(kernels.convolve(filled(spark, 9, 9, lambda x, y: 10 * y + x), Grid(9, 9), [[-1], [0], [1]], 2, 7, rows=rows))
    assert wide[4, 4] == 8 and tall[4, 4] == 17


@pytest.mark.parametrize("rows", [None, 2])
def test_laplace_of_a_quadratic_is_constant(spark, rows):
    df, g = filled(spark, 12, 11, lambda x, y: 100 + 2 * x * x + 3 * y * y + x * y), Grid(12, 11)
    assert set(read(kernels.laplace(df, g, False, rows=rows)).values()) == {-10}
    assert set(read(kernels.laplace(df, g, True, rows=rows)).values()) == {-30}


@pytest.mark.parametrize(("w", "h"), [(1, 1), (2, 2), (1, 5), (13, 9)])
def test_planes_have_no_relief(spark, w, h):
    df, g = filled(spark, w, h, lambda x, y: 500 + 3 * x - 2 * y), Grid(w, h)
    assert all(abs(v) < 1e-8 for v in read(kernels.laplace(df, g)).values())
    assert all(abs(v) < 1e-8 for v in read(kernels.local_relief(df, g, 9, rows=3)).values())


def test_local_relief_of_a_ditch(spark):
    got = read(kernels.local_relief(filled(spark, 41, 41, lambda x, y: 0.05 * x - (0.5 if x == 20 else 0)), Grid(41, 41), 9, rows=7))
    assert got[20, 20] < -0.35 and abs(got[20, 5]) < 0.08


@pytest.mark.parametrize("tension", [1.0, 0.5, 0.0])
def test_bezier_reproduces_a_plane(spark, tension):
    f = lambda x, y: 3 + 2 * (x + 0.5) - 1.5 * (y + 0.5)
    fine, g = kernels.bezier_subdivide(filled(spark, 6, 5, f), Grid(6, 5), 4, tension, rows=2)
    assert (g.width, g.height, g.b) == (24, 20, 0.25)
    for (r, c), v in read(fine).items():
        assert v == pytest.approx(3 + 2 * (c + 0.5) / 4 - 1.5 * (r + 0.5) / 4, abs=1e-5)


def test_bezier_gaps_and_limits(spark):
    step = filled(spark, 10, 3, lambda x, y: 0 if x < 5 else 100)
    assert all(0 <= v <= 100 for v in read(kernels.bezier_subdivide(step, Grid(10, 3), 4, monotone=True)[0]).values())
    gap = read(kernels.bezier_subdivide(filled(spark, 6, 6, lambda x, y: None if (x, y) == (2, 2) else 7), Grid(6, 6), 2)[0])
    assert sum(v is None for v in gap.values()) == 4 and {v for v in gap.values() if v is not None} == {7}


def test_hull():
    assert fill.convex_hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)]) == [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert fill.convex_hull([(1, 1), (0, 0), (1, 1)]) == [(0, 0), (1, 1)]


def test_fills(spark):
    hole = lambda x, y: None if (x - 10) ** 2 + (y - 10) ** 2 <= 9 else x
    df, g = filled(spark, 20, 20, hole), Grid(20, 20)
    near, idw = read(fill.fill_nearest(df, g)), read(fill.fill_idw(df, g, rows=6))
    assert all(v is not None for v in near.values()) and 7 <= near[10, 10] <= 13
    assert 9 <= idw[10, 10] <= 11 and idw == read(fill.fill_idw(df, g))
    triangle = filled(spark, 20, 20, lambda x, y: x + y if x >= y and (x, y) not in ((12, 5), (13, 5), (12, 6), (13, 6)) else None)
    assert fill.gaps_in_hull(triangle).first()["n"] == 4
    got = read(fill.fill_idw(triangle, g, smoothing=1, rows=4))
    assert got[15, 2] is None and got[5, 12] is not None and got == read(fill.fill_idw(triangle, g, smoothing=1))


def test_a_wall_hides(spark):
    got = read(visibility.viewshed(filled(spark, 20, 5, lambda x, y: 100 if x == 5 else 0), Grid(20, 5), 1, 2))
    assert got[2, 10] == 0 and got[2, 4] == 1
    near = read(visibility.viewshed(filled(spark, 20, 5, lambda x, y: 0), Grid(20, 5), 1, 2, most=3))
    assert near[2, 4] == 1 and near[2, 5] is None


def test_streams(spark):
    data = cells(spark, [[9, 8, 7, 8, 9], [8, 7, 6, 7, 8], [7, 6, 5, 6, 7], [8, 7, 4, 7, 8], [9, 8, 3, 8, 9]])
    direction = hydro.flow_direction(data, 5, 5)
    got = hydro.stream_segments(direction, hydro.flow_accumulation(direction), 3).collect()
    assert got and max(r["strahler"] for r in got) >= 1 and all(len(r["points"]) > 1 for r in got)
    fork = spark.createDataFrame([(0, 0, 2), (0, 2, 8), (1, 1, 4), (2, 1, 0)], "row int, col int, v int")
    flow = spark.createDataFrame([(0, 0, 5.0), (0, 2, 5.0), (1, 1, 11.0), (2, 1, 12.0)], "row int, col int, v float")
    got = hydro.stream_segments(fork, flow, 5).collect()
    assert sorted(r["strahler"] for r in got) == [1, 1, 2] and max(r["accumulation"] for r in got) == 12


def test_contour_lines(spark):
    cone = filled(spark, 21, 21, lambda x, y: 50.3 - math.hypot(x - 10, y - 10))
    got = contour.lines(contour.segments(cone, 5.0), 5.0, index_every=2).collect()
    inner = [r for r in got if r["level"] == 45]
    assert len(inner) == 1 and inner[0]["is_closed"] and not inner[0]["is_index"]
    assert inner[0]["length"] == pytest.approx(2 * math.pi * 5.3, rel=0.05)
    ramp = contour.lines(contour.segments(filled(spark, 5, 4, lambda x, y: x), 2.5), 2.5).where("level = 2.5").collect()
    assert len(ramp) == 1 and len(ramp[0]["points"]) == 4 and not ramp[0]["is_closed"]
    assert np.allclose([p["x"] for p in ramp[0]["points"]], 3.0)
