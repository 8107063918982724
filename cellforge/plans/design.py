"""Designing a line of constant grade step by step: assessment of segments, undo, drafts, and review of finished lines.

A session is a driver-side object over a surface at hand; many finished lines are reviewed in parallel by ``reviewed``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from enum import IntFlag

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grade import CANDIDATE_TOLERANCE, SAMPLES, Surface, candidates_at, listed, requests
from ..operators.grid import Grid
from ..operators.tiles import SIDE

#: Samples along a segment, at most; a longer segment counts as unchecked.
MOST_SAMPLES = 8192
#: Degrees from which a turn is sharp, beyond which it goes back, and from which two opposite ones are a zigzag.
SHARP, BACK, ZIGZAG = 45.0, 90.0, 30.0
#: Per cent by which a reviewed segment's mean grade may differ.
GRADE_PLAY = 0.25
METHOD = "bilinear"


class Warnings(IntFlag):
    """The bits of a segment's warnings."""

    NONE = 0
    SHARP_TURN = 1
    REVERSE_TURN = 2
    ZIGZAG = 4
    SELF_INTERSECTION = 8
    TERRAIN_DEVIATION = 16
    GRADE_DEVIATION = 32


Vertex = tuple[float, float, float, float]  # x, y, height, distance along the line


@dataclass(frozen=True)
class Segment:
    """An assessed segment; ``revision`` tells the state of the session that it was assessed in."""

    end: Vertex
    profile: list[tuple[float, float, float, float]]
    valid: bool
    deviation: float
    turn: float
    warnings: Warnings
    revision: int = -1


def touches(a: Vertex, b: Vertex, c: Sequence[float], d: Sequence[float], play: float = 1e-8) -> bool:
    """Whether two segments cross or touch."""
    for k in (0, 1):
        if min(a[k], b[k]) > max(c[k], d[k]) + play or max(a[k], b[k]) < min(c[k], d[k]) - play:
            return False
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) <= play and side(c, d, a) * side(c, d, b) <= play


class Session:
    """A line that grows by accepted segments of the current step."""

    def __init__(self, surface: Surface, x: float, y: float, grade: float, step: float = 20.0, deviation: float = 0.5) -> None:
        if not (math.isfinite(grade) and math.isfinite(deviation) and deviation >= 0):
            raise ValueError("the grade is finite, the deviation allowed not negative")
        start = surface.at(x, y)
        if start is None:
            raise ValueError("a line starts on known terrain")
        self.surface, self.grade, self.deviation = surface, grade, deviation
        self.vertices: list[Vertex] = [(x, y, start[0], 0.0)]
        self.segments: list[Segment] = []
        self.undone: list[Segment] = []
        self.revision = 0
        self.step = 0.0
        self.set_step(step)

    def set_step(self, step: float) -> None:
        if not (math.isfinite(step) and step > 0):
            raise ValueError("a step is positive")
        if step != self.step:
            self.step = step
            self.revision += 1

    def height_at(self, distance: float) -> float:
        """The height that the grade demands."""
        return self.vertices[0][2] + distance * self.grade / 100

    @property
    def next_height(self) -> float:
        return self.height_at(self.vertices[-1][3] + self.step)

    def candidates(self) -> list[tuple[float, float, float, float]]:
        """Where the next step can end: heading, x, y, height."""
        x, y, _, _ = self.vertices[-1]
        return candidates_at(self.surface, x, y, self.step, self.next_height)[0]

    def assess(self, x: float, y: float, on_grade: bool = True) -> Segment:
        """What a segment to (x, y) would be; ``on_grade``: it is valid only if its end has the height demanded."""
        sx, sy, sz, run = self.vertices[-1]
        dx, dy = x - sx, y - sy
        length = math.hypot(dx, dy)
        if not math.isfinite(length) or length <= 0 or abs(length - self.step) > max(1e-5, self.step * 1e-8):
            raise ValueError("a segment is as long as the step")
        spacing = min(1.0, min(self.surface.grid.cell_width, self.surface.grid.cell_height) / 2)
        wanted = max(2, math.ceil(length / spacing))
        t = np.arange(min(MOST_SAMPLES, wanted) + 1) / min(MOST_SAMPLES, wanted)
        z = self.surface.many(sx + dx * t, sy + dy * t)[0]
        off = np.abs(z - (self.vertices[0][2] + (run + length * t) * self.grade / 100))
        known = ~np.isnan(z)
        worst = float(off[known].max()) if known.any() else 0.0
        valid = bool(known.all()) and wanted <= MOST_SAMPLES
        end_z = float(z[-1]) if known[-1] else math.nan
        if on_grade and known[-1]:
            valid = valid and off[-1] <= 2 * CANDIDATE_TOLERANCE
        warnings = Warnings.TERRAIN_DEVIATION if worst > self.deviation else Warnings.NONE
        if not on_grade and known[0] and known[-1] and abs((end_z - sz) / length * 100 - self.grade) > GRADE_PLAY:
            warnings |= Warnings.GRADE_DEVIATION
        turn = 0.0
        if len(self.vertices) > 1:
            px, py = self.vertices[-2][:2]
            turn = math.degrees(math.remainder(math.atan2(dy, dx) - math.atan2(sy - py, sx - px), 2 * math.pi))
            if abs(turn) > BACK + 1e-7:
                warnings |= Warnings.REVERSE_TURN
            elif abs(turn) >= SHARP - 1e-7:
                warnings |= Warnings.SHARP_TURN
            before = self.segments[-1].turn if self.segments else 0.0
            if abs(turn) >= ZIGZAG and abs(before) >= ZIGZAG and turn * before < 0:
                warnings |= Warnings.ZIGZAG
        if any(touches(a, b, (sx, sy), (x, y)) for a, b in zip(self.vertices[:-2], self.vertices[1:-1], strict=True)):
            warnings |= Warnings.SELF_INTERSECTION
        profile = [(run + length * float(k), sx + dx * float(k), sy + dy * float(k), float(h)) for k, h in zip(t, z, strict=True)]
        return Segment((x, y, end_z, run + length), profile, valid, worst, turn, warnings, self.revision)

    def accept(self, segment: Segment, despite_warnings: bool = False) -> bool:
        """Add a segment that is valid and was assessed in the present state; what was undone is forgotten."""
        if segment.revision != self.revision or not segment.valid or (segment.warnings and not despite_warnings):
            return False
        self._add(segment)
        self.undone.clear()
        return True

    def _add(self, segment: Segment) -> None:
        self.segments.append(segment)
        self.vertices.append(segment.end)
        self.revision += 1

    def undo(self) -> bool:
        if not self.segments:
            return False
        self.undone.append(self.segments.pop())
        self.vertices.pop()
        self.revision += 1
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        self._add(self.undone.pop())
        return True

    def profile(self) -> list[tuple[float, float, float, float]]:
        """Samples along the whole line; the end of a segment isn't repeated."""
        if not self.segments:
            x, y, z, run = self.vertices[0]
            return [(run, x, y, z)]
        return [s for k, segment in enumerate(self.segments) for s in segment.profile[k > 0 :]]

    def draft(self, **about: object) -> Draft:
        """The session with what was undone; ``about``: the draft's other fields."""
        every = [*self.segments, *reversed(self.undone)]
        record = Record(METHOD, self.grade, self.deviation, [self.vertices[0], *(s.end for s in every)], [int(s.warnings) for s in every], [s.deviation for s in every])
        return Draft(record, len(self.segments), self.step, [s.profile for s in every], [s.turn for s in every], **about)

    def record(self) -> Record:
        return Record(METHOD, self.grade, self.deviation, list(self.vertices), [int(s.warnings) for s in self.segments], [s.deviation for s in self.segments])


def finite(*values: float) -> bool:
    return all(isinstance(v, (int, float)) and math.isfinite(v) for v in values)


@dataclass
class Record:
    """A finished line as stored. The keys of its JSON are fixed values."""

    method: str
    grade: float
    deviation: float
    vertices: list[Vertex]
    warnings: list[int] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)
    version: int = 1

    KEYS = {"Version": "version", "SurfaceMethod": "method", "GradePercent": "grade", "TerrainDeviationThreshold": "deviation", "Vertices": "vertices", "Warnings": "warnings", "MaximumDeviations": "deviations"}

    def check(self) -> None:
        """ValueError where an invariant doesn't hold."""
        if self.version != 1 or not self.method.strip() or not finite(self.grade, self.deviation) or self.deviation < 0 or not self.vertices:
            raise ValueError("no valid record of a line")
        if len(self.warnings) != len(self.vertices) - 1 or len(self.deviations) != len(self.warnings):
            raise ValueError("a record has a warning and a deviation for each segment")
        if any(len(v) != 4 or not finite(*v) for v in self.vertices) or self.vertices[0][3] != 0:
            raise ValueError("no valid vertices")
        for a, b, bits, off in zip(self.vertices[:-1], self.vertices[1:], self.warnings, self.deviations, strict=True):
            length = math.hypot(b[0] - a[0], b[1] - a[1])
            if b[3] <= a[3] or abs(b[3] - a[3] - length) > max(1e-5, length * 1e-8) or not finite(off) or off < 0 or bits & ~63:
                raise ValueError("no valid segment")

    def to_json(self) -> str:
        self.check()
        return json.dumps({key: getattr(self, name) for key, name in self.KEYS.items()})

    @classmethod
    def from_json(cls, text: str) -> Record:
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError("no record of a line")
        record = cls(**{name: found[key] for key, name in cls.KEYS.items() if key in found})
        record = replace(record, vertices=[tuple(v) for v in record.vertices])
        record.check()
        return record


@dataclass
class Target:
    """Where a line is to arrive: within a radius, at a height if one is given."""

    x: float
    y: float
    radius: float = 10.0
    height: float | None = None

    def reached(self, x: float, y: float) -> bool:
        return math.hypot(x - self.x, y - self.y) <= self.radius

    def passed(self, session: Session) -> bool:
        """The line has gone beyond the height without having arrived."""
        x, y, z, _ = session.vertices[-1]
        return self.height is not None and not self.reached(x, y) and (session.grade > 0 and z > self.height or session.grade < 0 and z < self.height)


@dataclass
class Draft:
    """An unfinished line: its record with the undone segments last, their profiles, and what it is of."""

    record: Record
    accepted: int
    step: float
    profiles: list[list[tuple[float, float, float, float]]]
    turns: list[float]
    name: str = ""
    band: int = 0
    source: str | None = None
    target: Target | None = None
    version: int = 1

    def check(self) -> None:
        self.record.check()
        if self.version != 1 or self.band < 0 or not finite(self.step) or self.step <= 0 or not 0 <= self.accepted <= len(self.record.warnings):
            raise ValueError("no valid draft")
        if len(self.profiles) != len(self.record.warnings) or len(self.turns) != len(self.profiles) or not finite(*self.turns):
            raise ValueError("a draft has a profile and a turn for each segment")
        if self.target and (not finite(self.target.x, self.target.y, self.target.radius) or self.target.radius <= 0):
            raise ValueError("no valid target")
        for start, end, profile in zip(self.record.vertices[:-1], self.record.vertices[1:], self.profiles, strict=True):
            if not 2 <= len(profile) <= MOST_SAMPLES + 1 or any(len(p) != 4 or not finite(*p) for p in profile):
                raise ValueError("no valid profile")
            runs = [p[0] for p in profile]
            if abs(runs[0] - start[3]) > 1e-8 or abs(runs[-1] - end[3]) > 1e-8 or any(b < a for a, b in zip(runs[:-1], runs[1:], strict=True)):
                raise ValueError("a profile goes from end to end")
            for run, x, y, _ in profile:
                t = (run - start[3]) / (end[3] - start[3])
                if abs(x - start[0] - t * (end[0] - start[0])) > 1e-5 or abs(y - start[1] - t * (end[1] - start[1])) > 1e-5:
                    raise ValueError("a profile lies on its segment")

    def to_json(self) -> str:
        self.check()
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Draft:
        found = json.loads(text)
        record = Record(**found.pop("record"))
        record.vertices = [tuple(v) for v in record.vertices]
        target = found.pop("target", None)
        profiles = [[tuple(p) for p in profile] for profile in found.pop("profiles")]
        draft = cls(record=record, target=Target(**target) if target else None, profiles=profiles, **found)
        draft.check()
        return draft

    def restored(self, surface: Surface) -> Session:
        """A session in the draft's state; ValueError where the terrain at its start has changed."""
        self.check()
        if self.record.method != METHOD:
            raise ValueError("the draft was made on another kind of surface")
        x, y, z, _ = self.record.vertices[0]
        session = Session(surface, x, y, self.record.grade, self.step, self.record.deviation)
        if abs(session.vertices[0][2] - z) > 2 * CANDIDATE_TOLERANCE:
            raise ValueError("the terrain at the start has changed")
        session.vertices[0] = self.record.vertices[0]
        parts = zip(self.record.vertices[1:], self.profiles, self.record.deviations, self.turns, self.record.warnings, strict=True)
        every = [Segment(v, p, True, off, turn, Warnings(bits)) for v, p, off, turn, bits in parts]
        for segment in every[: self.accepted]:
            session._add(segment)
        session.undone = every[self.accepted :][::-1]
        return session


def review(surface: Surface, points: Sequence[tuple[float, float]], grade: float | None = None) -> list[Segment]:
    """Every segment of a finished line, assessed against a grade: that from end to end if none is given."""
    if len(points) < 2:
        raise ValueError("a line has two points at least")
    steps = [math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(points[:-1], points[1:], strict=True)]
    first, last = surface.at(*points[0]), surface.at(*points[-1])
    if first is None or sum(steps) <= 0 or (grade is None and last is None):
        raise ValueError("the grade of the line isn't known")
    session = Session(surface, *points[0], (last[0] - first[0]) / sum(steps) * 100 if grade is None else grade, steps[0])
    for point, step in zip(points[1:], steps, strict=True):
        session.set_step(step)
        session._add(session.assess(*point, on_grade=False))
    return session.segments


def reviewed(lines: DataFrame, cells: DataFrame, grid: Grid, grade: float | None = None, side: int = SIDE) -> DataFrame:
    """Review of each of ``lines(id, points)``: ``id, segment, valid, deviation, turn, warnings, samples``.

    Lines of fewer than two points, of no length, or whose ends are off the terrain have no segments.
    """
    far = F.array_max(F.transform("points", lambda p: F.hypot(p["x"] - F.col("points")[0]["x"], p["y"] - F.col("points")[0]["y"])))
    asked = lines.where(F.size("points") > 1).select("id", F.col("points")[0]["x"].cast("double").alias("x"), F.col("points")[0]["y"].cast("double").alias("y"), "points", far.alias("far"))

    def solve(surface: Surface, row: dict) -> Iterator[dict]:
        try:
            found = review(surface, [(p["x"], p["y"]) for p in row["points"]], grade)
        except ValueError:
            return
        for k, s in enumerate(found):
            samples = [{**p, "z": None if math.isnan(p["z"]) else p["z"]} for p in listed(s.profile)]
            yield {"id": row["id"], "segment": k, "valid": s.valid, "deviation": s.deviation, "turn": s.turn, "warnings": int(s.warnings), "samples": samples}

    return requests(asked, cells, grid, F.col("far"), solve, f"id long, segment int, valid boolean, deviation double, turn double, warnings int, samples {SAMPLES}", side)
