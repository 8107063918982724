import math

import numpy as np
import pytest

from cellforge.operators import grade
from cellforge.operators.grid import Grid
from cellforge.operators.tiles import Ground
from cellforge.plans import design

from .test_rasters import filled

NORTH_UP = Grid(100, 100, 0.0, 1.0, 0.0, 100.0, 0.0, -1.0)
TURNED = Grid(100, 100, 0.0, 1.6, 0.6, 0.0, 1.2, -0.8)


def surface(f, grid=NORTH_UP):
    side = 256
    data = np.full((side, side), np.nan)
    for r in range(grid.height):
        for c in range(grid.width):
            data[r, c] = f(*grid.world(c + 0.5, r + 0.5))
    return grade.Surface(grid, Ground([(0, 0, data.tobytes())], side))


def plane(x, y):
    return 0.125 * x


@pytest.mark.parametrize(("grid", "x", "y"), [(NORTH_UP, 50, 50), (TURNED, 110, 25)])
@pytest.mark.parametrize("percent", [5.0, -5.0, 0.0, 12.0])
def test_traces_on_a_plane_are_straight(grid, x, y, percent):
    made = surface(plane, grid)
    for side in (0, 1):
        got = grade.followed(made, x, y, side, grade.Limits(percent, 10.0))
        end = got.samples[-1]
        assert got.stop == "MaximumLength" and end[0] == pytest.approx(10)
        assert end[1] - x == pytest.approx(10 * percent / 12.5, abs=1e-6)
        assert abs(end[2] - y) == pytest.approx(10 * math.sqrt(1 - (percent / 12.5) ** 2), abs=1e-6)
        assert all(h == pytest.approx(plane(x, y) + percent / 100 * s, abs=1e-6) for s, _, _, h in got.samples)
    assert (grade.followed(made, x, y, 0, grade.Limits(5.0, 10.0)).samples[-1][2] - y) * (grade.followed(made, x, y, 1, grade.Limits(5.0, 10.0)).samples[-1][2] - y) < 0


def test_why_traces_stop():
    assert grade.followed(surface(lambda x, y: 0.01 * x), 50, 50, 0, grade.Limits(5.0, 10.0)).stop == "InsufficientSlope"
    assert grade.followed(surface(lambda x, y: 7.0), 50, 50, 0, grade.Limits(0.0, 10.0)).stop == "FlatSurface"
    outside = grade.followed(surface(plane), -50, 50, 0, grade.Limits(5.0, 10.0))
    assert outside.stop == "BoundaryOrNoData" and not outside.samples
    edge = grade.followed(surface(plane), 50, 96, 0, grade.Limits(5.0, 1000.0))
    assert edge.stop == "BoundaryOrNoData" and 1 < edge.samples[-1][0] < 10
    hole = grade.followed(surface(lambda x, y: math.nan if 60 < y < 64 else 0.125 * x), 50, 50, 0, grade.Limits(0.0, 50.0))
    assert hole.stop == "BoundaryOrNoData" and hole.samples[-1][2] < 60
    assert grade.followed(surface(plane), 50, 50, 0, grade.Limits(5.0, 50.0, steps=3)).stop == "StepLimit"
    for bad in ({"length": 0.0}, {"grade": math.inf}, {"height_tolerance": -1.0}, {"steps": 0}):
        with pytest.raises(ValueError):
            grade.Limits(**bad)


def test_traces_keep_their_grade_on_curved_ground():
    made = surface(lambda x, y: 20 + 3 * math.sin(x / 9) + 2 * math.cos(y / 7) + 0.1 * x)
    for percent in (2.0, -4.0, 0.0):
        for side in (0, 1):
            got = grade.followed(made, 50, 50, side, grade.Limits(percent, 40.0))
            start = got.samples[0][3]
            assert got.height_error <= 0.02 and got.grade_error <= 0.1
            assert all(abs(h - start - percent / 100 * s) <= 0.02 + 1e-9 for s, _, _, h in got.samples)
            steps = list(zip(got.samples[:-1], got.samples[1:], strict=True))
            assert all(math.hypot(b[1] - a[1], b[2] - a[2]) == pytest.approx(b[0] - a[0], abs=1e-6) for a, b in steps)
            assert got.samples[-1][0] > 5


def test_routes():
    made = surface(plane)
    limits = grade.Limits(5.0, 100.0)
    found = grade.routed(made, 40, 50, 44, 50, limits)
    assert found.status == "Success" and found.samples[-1][0] == pytest.approx(10, abs=0.41) and found.samples[-1][1:3] == (44, 50)
    assert found.required == pytest.approx(10) and found.height_error <= 0.02
    straight = grade.routed(made, 40, 50, 50, 50 + 10 * math.sqrt(5.25), limits)
    assert straight.status == "Success" and straight.samples[-1][0] == pytest.approx(25)
    assert grade.routed(made, 40, 50, 40, 50, limits).status == "CoincidentEndpoints"
    assert grade.routed(made, 40, 50, 400, 50, limits).status == "EndpointNoData"
    assert grade.routed(made, 40, 50, 30, 50, limits).status == "IncompatibleGrade"
    assert grade.routed(made, 10, 50, 90, 50, limits).status == "LengthLimit"
    assert grade.routed(made, 40, 50, 46, 50, grade.Limits(0.0, 100.0)).status == "IncompatibleGrade"
    curved = surface(lambda x, y: 0.1 * x + 0.001 * x * y)
    a = (30.0, 40.0)
    path = grade.followed(curved, *a, 0, grade.Limits(6.0, 12.0)).samples[-1]
    way = grade.routed(curved, *a, path[1], path[2], grade.Limits(6.0, 60.0))
    assert way.status == "Success" and way.samples[-1][1:3] == (path[1], path[2]) and way.height_error <= 0.02
    assert grade.routed(curved, *a, 80.0, 70.0, grade.Limits(9.0, 1000.0, states=1)).status in ("SearchLimit", "Success", "IncompatibleGrade")


def test_candidates():
    made = surface(plane)
    found, level, missing = grade.candidates_at(made, 50, 50, 10, 6.25 + 0.5)
    assert not level and not missing and [round(p[1], 4) for p in found] == [54, 54]
    touching, _, _ = grade.candidates_at(made, 50, 50, 10, 6.25 + 1.25)
    assert len(touching) == 1 and touching[0][1] == pytest.approx(60, abs=1e-4)
    assert grade.candidates_at(surface(lambda x, y: 7.0), 50, 50, 10, 7.0) == ([], True, False)
    assert grade.candidates_at(made, 97, 50, 10, 97 * 0.125)[2]


def test_requests_over_tiles(spark):
    cells = filled(spark, 100, 100, lambda c, r: 0.125 * (c + 0.5))
    starts = spark.createDataFrame([(1, 50.0, 50.0), (2, 20.0, 30.0), (3, -500.0, 50.0)], "id long, x double, y double")
    got = {(r.id, r.branch): r for r in grade.trace(starts, cells, NORTH_UP, grade.Limits(5.0, 10.0), side=16).collect()}
    assert len(got) == 6 and got[3, 0].stop == "BoundaryOrNoData" and not got[3, 1].samples
    assert all(got[i, k].samples[-1].x == pytest.approx(x + 4) for i, x in ((1, 50), (2, 20)) for k in (0, 1))
    slopes = {r.id: r.slope for r in grade.slope_percent(starts, cells, NORTH_UP).collect()}
    assert slopes[1] == pytest.approx(12.5) and slopes[3] is None
    asked = spark.createDataFrame([(7, 50.0, 50.0, 10.0, 6.75)], "id long, x double, y double, step double, z double")
    assert [p.x for p in grade.candidates(asked, cells, NORTH_UP, side=32).first().points] == pytest.approx([54, 54])
    lines = spark.createDataFrame([(1, [(50.0, 50.0), (54.0, 50.0), (58.0, 53.0)]), (2, [(1.0, 1.0)])], "id long, points array<struct<x:double,y:double>>")
    found = design.reviewed(lines, cells, NORTH_UP, side=16).collect()
    assert [(r.id, r.segment, r.valid) for r in sorted(found, key=lambda r: r.segment)] == [(1, 0, True), (1, 1, True)]


def test_design_sessions(spark):
    made = surface(plane)
    session = design.Session(made, 50, 50, 5.0, step=10)
    two = session.candidates()
    assert len(two) == 2 and session.next_height == pytest.approx(6.75)
    left = max(two, key=lambda p: p[2])
    first = session.assess(left[1], left[2])
    assert first.valid and first.warnings == design.Warnings.NONE and session.accept(first) and not session.accept(first)
    back = min(session.candidates(), key=lambda p: p[2])
    turn = session.assess(back[1], back[2])
    assert turn.warnings == design.Warnings.REVERSE_TURN and not session.accept(turn) and session.accept(turn, True)
    again = max(session.candidates(), key=lambda p: p[2])
    assert design.Warnings.ZIGZAG in session.assess(again[1], again[2]).warnings
    assert len(session.profile()) == len(first.profile) + len(turn.profile) - 1
    assert session.undo() and len(session.vertices) == 2 and session.redo() and not session.redo()
    record = design.Record.from_json(session.record().to_json())
    assert record == session.record()
    session.undo()
    draft = session.draft(name="a", target=design.Target(60.0, 60.0))
    same = design.Draft.from_json(draft.to_json()).restored(made)
    assert same.vertices == session.vertices and same.redo() and same.vertices[-1][:2] == pytest.approx((back[1], back[2]))
    assert draft.target.reached(55, 60) and not draft.target.passed(session)
    with pytest.raises(ValueError):
        session.assess(0.0, 0.0)
    with pytest.raises(ValueError):
        design.Draft.from_json(draft.to_json()).restored(surface(lambda x, y: 0.2 * x))
    record.vertices[1] = (*record.vertices[1][:3], 99.0)
    with pytest.raises(ValueError):
        record.check()


def test_review_warns_of_crossings_and_grades():
    made = surface(plane)
    found = design.review(made, [(50, 50), (60, 50), (60, 60), (55, 45)])
    assert design.Warnings.SELF_INTERSECTION in found[2].warnings and design.Warnings.GRADE_DEVIATION in found[0].warnings
    assert design.Warnings.TERRAIN_DEVIATION in found[0].warnings and found[1].turn == pytest.approx(90)
    with pytest.raises(ValueError):
        design.review(made, [(50, 50)])
