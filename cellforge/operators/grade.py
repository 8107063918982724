"""Lines of constant grade over a terrain: traces from a point, routes between two, candidates for the next vertex.

The terrain is the bilinear surface through cell centres, valid where all four corners are known. Along a straight piece
inside one patch heights are a quadratic, so errors of height and of grade are known exactly and not sampled. A trace
goes from patch to patch: it turns the chord of the current length until its end has the height that the grade demands,
shortens it to where it leaves the patch, and halves it where a tolerance is exceeded.

Every start or pair of ends is solved by itself from the tiles of terrain within its reach, so requests run in parallel
over any raster; a request holds the tiles that its greatest length can touch.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid
from .tiles import SIDE, Ground, packed

TURN = 2 * math.pi
#: Share of a cell within which a point counts as on an edge of patches.
EDGE = 1e-6


@dataclass(frozen=True)
class Limits:
    """Grade in per cent (negative: downhill), the greatest length, tolerances, and how much may be tried."""

    grade: float = 5.0
    length: float = 1000.0
    height_tolerance: float = 0.02
    grade_tolerance: float = 0.1
    steps: int = 50_000
    states: int = 25_000
    stored: int = 100_000

    def __post_init__(self) -> None:
        positive = (self.length, self.height_tolerance, self.grade_tolerance)
        if not (math.isfinite(self.grade) and all(math.isfinite(x) and x > 0 for x in positive) and min(self.steps, self.states, self.stored) >= 1):
            raise ValueError("the grade is finite, lengths, tolerances and limits are positive")


def apart(a: float, b: float) -> float:
    """The angle between two headings, 0 to pi."""
    return abs(math.remainder(a - b, TURN))


class Surface:
    """Heights and gradients in world coordinates."""

    def __init__(self, grid: Grid, ground: Ground) -> None:
        if not grid.invertible:
            raise ValueError("the georeference can't be inverted")
        self.grid, self.ground = grid, ground
        self.det = grid.determinant
        #: A length that is less than a cell's in every direction.
        self.cell = abs(self.det) / math.sqrt(grid.b**2 + grid.c**2 + grid.e**2 + grid.f**2)

    def place(self, x, y):
        """Column and row where a cell's centre lies at whole numbers."""
        px, py = self.grid.pixel(x, y)
        return px - 0.5, py - 0.5

    def many(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Height, gradient by x and y, and the corners' mixed difference; NaN where the surface isn't valid."""
        u, v = self.place(x, y)
        inside = (u >= 0) & (v >= 0) & (u <= self.grid.width - 1) & (v <= self.grid.height - 1) & (min(self.grid.width, self.grid.height) > 1)
        col = np.clip(np.floor(np.where(inside, u, 0)), 0, max(0, self.grid.width - 2)).astype(np.int64)
        row = np.clip(np.floor(np.where(inside, v, 0)), 0, max(0, self.grid.height - 2)).astype(np.int64)
        a, b, c, d = (self.ground.at(row + i, col + j) for i in (0, 1) for j in (0, 1))
        u, v = u - col, v - row
        z = np.where(inside, a * (1 - u) * (1 - v) + b * u * (1 - v) + c * (1 - u) * v + d * u * v, np.nan)
        du, dv = (b - a) * (1 - v) + (d - c) * v, (c - a) * (1 - u) + (d - b) * u
        g = self.grid
        return z, (du * g.f - dv * g.e) / self.det, (dv * g.b - du * g.c) / self.det, a - b - c + d

    def at(self, x: float, y: float) -> tuple[float, float, float, float] | None:
        z, gx, gy, mixed = self.many(np.array([x]), np.array([y]))
        return None if math.isnan(z[0]) else (float(z[0]), float(gx[0]), float(gy[0]), float(mixed[0]))

    def ahead(self, x: float, y: float, heading: float | None) -> tuple[float, float, float, float] | None:
        """As ``at``, of the patch that the heading leads into where a point lies on an edge of patches."""
        u, v = self.place(x, y)
        shift = 4 * EDGE * self.cell if heading is not None and (abs(u - round(u)) < EDGE or abs(v - round(v)) < EDGE) else 0.0
        return self.at(x + shift * math.cos(heading), y + shift * math.sin(heading)) if shift else self.at(x, y)

    def cuts(self, x: float, y: float, end_x: float, end_y: float) -> list[float]:
        """Where a straight piece crosses edges of patches, as shares of it, with 0 and 1."""
        found = {0.0, 1.0}
        for a, b in zip(self.place(x, y), self.place(end_x, end_y), strict=True):
            if abs(b - a) > 1e-14:
                found |= {(k - a) / (b - a) for k in range(math.floor(min(a, b)) + 1, math.ceil(max(a, b)))}
        return sorted(found)


@dataclass
class Piece:
    """A straight piece: its end, the samples along it and its greatest errors."""

    x: float
    y: float
    length: float
    samples: list[tuple[float, float, float, float]]
    height_error: float
    grade_error: float


def measured(surface: Surface, x: float, y: float, end_x: float, end_y: float, run: float, z0: float, grade: float) -> Piece | None:
    """The piece to (end_x, end_y) after a run from height z0; None where it leaves the valid surface."""
    dx, dy = end_x - x, end_y - y
    length = math.hypot(dx, dy)
    shares = np.array(surface.cuts(x, y, end_x, end_y))
    shares = shares[np.concatenate(([True], np.diff(shares) >= min(0.5, 2 * EDGE * surface.cell / length)))]  # ends lie on edges but for rounding
    shares[-1] = 1.0
    middle = (shares[1:] + shares[:-1]) / 2
    every = np.concatenate((shares, middle))
    z, gx, gy, mixed = surface.many(x + dx * every, y + dy * every)
    if np.isnan(z).any():
        return None
    n = len(shares)
    part = np.diff(shares) * length
    g = surface.grid
    bend = mixed[n:] * ((g.f * dx - g.c * dy) / (surface.det * length)) * ((g.b * dy - g.e * dx) / (surface.det * length))
    slope = (gx[n:] * dx + gy[n:] * dy) / length  # in the middle of each part; it changes by 2 * bend a unit of length
    off = np.maximum(np.abs(slope - bend * part - grade), np.abs(slope + bend * part - grade))
    error = z[:n] - (z0 + grade * (run + length * shares))
    worst = float(np.abs(error).max())
    first = slope - bend * part - grade
    curved = np.flatnonzero(np.abs(bend * part * part) > 1e-24)
    top = -first[curved] / (2 * bend[curved])  # where within a part the error is extreme
    inside = (top > 0) & (top < part[curved])
    k, top = curved[inside], top[inside]
    if len(k):
        worst = max(worst, float(np.abs(error[k] + first[k] * top + bend[k] * top * top).max()))
    samples = []
    for k in range(n - 1):
        for t, h in ((middle[k], z[n + k]), (shares[k + 1], z[k + 1])):
            samples.append((run + length * float(t), x + dx * float(t), y + dy * float(t), float(h)))
    return Piece(end_x, end_y, length, samples, worst, float(off.max()))


def turned(surface: Surface, x: float, y: float, length: float, target: float, heading: float, tolerance: float) -> float | None:
    """The heading near the given one at which a chord ends at the target height."""
    angle = heading
    for _ in range(16):
        found = surface.at(x + length * math.cos(angle), y + length * math.sin(angle))
        if found is None:
            return None
        z, gx, gy, _ = found
        if abs(z - target) <= tolerance:
            return angle
        rate = length * (gy * math.cos(angle) - gx * math.sin(angle))
        if abs(rate) < 1e-14:
            return None
        angle -= max(-0.3, min(0.3, (z - target) / rate))
        if math.cos(angle - heading) < 0.7:
            return None
    return None


def zeros(value: Callable[[np.ndarray], np.ndarray], count: int, tolerance: float) -> list[float]:
    """Angles at which a function of the angle vanishes: sign changes between ``count`` samples, and touching extremes.

    NaN stands for what isn't known; nothing is found across it.
    """
    angle = np.arange(count) * (TURN / count)
    f = value(angle)
    after, before = np.roll(f, -1), np.roll(f, 1)
    with np.errstate(invalid="ignore"):
        found = list(angle[np.abs(f) <= tolerance])
        low = np.flatnonzero(f * after < 0)
        touch = np.flatnonzero((np.abs(f) < np.abs(before)) & (np.abs(f) <= np.abs(after)) & (f * before > 0) & (f * after > 0))
    if len(touch):  # the least distance from zero between the neighbours: a contact, or two crossings on its sides
        a, b = angle[touch] - TURN / count, angle[touch] + TURN / count
        for _ in range(60):
            third = (b - a) / 3
            left, right = np.abs(value(a + third)), np.abs(value(b - third))
            with np.errstate(invalid="ignore"):
                nearer = left < right
            a, b = np.where(nearer, a, a + third), np.where(nearer, b - third, b)
        middle = (a + b) / 2
        best = value(middle)
        with np.errstate(invalid="ignore"):
            found += list(middle[np.abs(best) <= tolerance])
            crossed = f[touch] * best < 0
        for left, right in ((angle[touch] - TURN / count, middle), (middle, angle[touch] + TURN / count)):
            found += bisected(value, left[crossed], right[crossed], tolerance)
    found += bisected(value, angle[low], angle[low] + TURN / count, tolerance)
    out: list[float] = []
    for x in sorted(float(x) % TURN for x in found):
        if not any(apart(x, y) < 1e-8 for y in (out[-1:] + out[:1])):
            out.append(x)
    return out


def bisected(value: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tolerance: float) -> list[float]:
    if not len(low):
        return []
    first = value(low)
    for _ in range(64):
        middle = (low + high) / 2
        f = value(middle)
        with np.errstate(invalid="ignore"):
            same = f * first > 0
        low, first, high = np.where(same, middle, low), np.where(same, f, first), np.where(same, high, middle)
    middle = (low + high) / 2
    f = value(middle)
    with np.errstate(invalid="ignore"):
        return list(middle[np.abs(f) <= tolerance])


def around(surface: Surface, x: float, y: float, length: float, target: float, tolerance: float, count: int = 256) -> list[float]:
    """All headings at which a chord of this length ends at the target height."""
    return zeros(lambda t: surface.many(x + length * np.cos(t), y + length * np.sin(t))[0] - target, count, tolerance)


def precision(target: float, length: float, limits: Limits) -> float:
    return max(32 * 2.0**-52 * max(1.0, abs(target)), min(limits.height_tolerance * 1e-3, length * 1e-8))


def headings(gx: float, gy: float, grade: float) -> tuple[float, float] | None:
    """The two headings of a grade on a plane, the gradient turned to the left first; None where it is too gentle."""
    q = math.hypot(gx, gy)
    if q < abs(grade) - 1e-12 or q < 1e-12:
        return None
    up, off = math.atan2(gy, gx), math.acos(max(-1.0, min(1.0, grade / q)))
    return up + off, up - off


def leaving(surface: Surface, x: float, y: float, heading: float) -> float:
    """The length at which a ray leaves the patch it goes into."""
    u, v = surface.place(x, y)
    ahead = 2 * EDGE * surface.cell
    while True:
        nu, nv = surface.place(x + ahead * math.cos(heading), y + ahead * math.sin(heading))
        out = math.inf
        for a, b in ((u, nu), (v, nv)):
            rate = (b - a) / ahead
            if abs(rate) > 1e-12:
                out = min(out, ((math.floor(b) + (rate > 0)) - a) / rate)
        if out >= EDGE * surface.cell or ahead > surface.cell / 4:
            return max(out, 0.0)
        ahead *= 4  # an edge just ahead that the ray meets at a small angle


def stepped(surface: Surface, x: float, y: float, run: float, z0: float, heading: float, length: float, limits: Limits) -> tuple[Piece, float] | None:
    """The piece of at most this length that goes on in this heading: to the edge of the patch if that is nearer."""
    grade = limits.grade / 100
    angle = heading
    for attempt in range(40):
        target = z0 + grade * (run + length)
        found = turned(surface, x, y, length, target, angle, precision(target, length, limits))
        if found is None:
            near = [t for t in around(surface, x, y, length, target, precision(target, length, limits)) if math.cos(t - heading) > 0]
            if not near:
                return None
            found = min(near, key=lambda t: apart(t, heading))
        angle = found
        edge = leaving(surface, x, y, angle)
        if edge >= length - surface.cell * 1e-12 or edge < surface.cell * 1e-6:
            break
        if attempt < 39:
            length = edge
    if math.cos(angle - heading) <= 0:
        return None
    piece = measured(surface, x, y, x + length * math.cos(angle), y + length * math.sin(angle), run, z0, grade)
    if piece is None or piece.height_error > limits.height_tolerance or 100 * piece.grade_error > limits.grade_tolerance:
        return None
    return piece, angle


@dataclass
class Branch:
    """A trace to one side: samples (distance, x, y, z), why it stopped, and its greatest errors."""

    samples: list[tuple[float, float, float, float]]
    stop: str
    height_error: float = 0.0
    grade_error: float = 0.0


def followed(surface: Surface, x: float, y: float, side: int, limits: Limits) -> Branch:
    """The trace from a point whose first heading is the gradient turned to the left (side 0) or right (side 1)."""
    start = surface.at(x, y)
    if start is None:
        return Branch([], "BoundaryOrNoData")
    grade, z0 = limits.grade / 100, start[0]
    out = Branch([(0.0, x, y, z0)], "StepLimit")
    run, heading, size = 0.0, None, surface.cell / 4
    end = 1e-9 * max(1.0, limits.length)
    for _ in range(limits.steps):
        if limits.length - run <= end:
            break
        here = surface.ahead(x, y, heading)
        if here is None:
            out.stop = "BoundaryOrNoData"
            return out
        two = headings(here[1], here[2], grade)
        if two is None:
            out.stop = "FlatSurface" if math.hypot(here[1], here[2]) >= abs(grade) - 1e-12 else "InsufficientSlope"
            return out
        wanted = two[side] if heading is None else min(two, key=lambda t: apart(t, heading))
        length, made = min(size, limits.length - run), None
        while made is None and length >= surface.cell * 1e-7:
            made = stepped(surface, x, y, run, z0, wanted, length, limits)
            if made is None:
                length /= 2
        if made is None:
            beyond = surface.at(x + surface.cell * 1e-3 * math.cos(wanted), y + surface.cell * 1e-3 * math.sin(wanted)) is None
            out.stop = "BoundaryOrNoData" if beyond else "ToleranceLimit"
            return out
        piece, heading = made
        out.samples += piece.samples
        out.height_error, out.grade_error = max(out.height_error, piece.height_error), max(out.grade_error, 100 * piece.grade_error)
        x, y, run = piece.x, piece.y, run + piece.length
        size = min(surface.cell, max(piece.length * 1.5, surface.cell / 16))
    if limits.length - run <= end:
        out.stop = "MaximumLength"
    return out


@dataclass
class Route:
    """A route between two points, or why there is none."""

    status: str
    samples: list[tuple[float, float, float, float]]
    required: float | None = None
    expanded: int = 0
    height_error: float = 0.0
    grade_error: float = 0.0


@dataclass
class Node:
    x: float
    y: float
    run: float
    heading: float | None
    cost: float
    before: Node | None
    piece: Piece | None


def routed(surface: Surface, x: float, y: float, end_x: float, end_y: float, limits: Limits) -> Route:
    """The first route found of constant grade to the very end point: best first by length, turns and what is left."""
    start, goal = surface.at(x, y), surface.at(end_x, end_y)
    if start is None or goal is None:
        return Route("EndpointNoData", [])
    distance = math.hypot(end_x - x, end_y - y)
    if distance <= surface.cell * 1e-9:
        return Route("CoincidentEndpoints", [])
    grade, z0, most, required = limits.grade / 100, start[0], limits.length, None
    if grade == 0:
        if abs(goal[0] - z0) > limits.height_tolerance:
            return Route("IncompatibleGrade", [])
    else:
        required, play = (goal[0] - z0) / grade, limits.height_tolerance / abs(grade)
        if required + play < distance:
            return Route("IncompatibleGrade", [], required)
        if required - play > limits.length:
            return Route("LengthLimit", [], required)
        most = min(most, required + play)
    if distance > most:
        return Route("LengthLimit", [], required)
    slack = 1e-9 * max(1.0, most)
    step = surface.cell

    def reached(node: Node, px: float, py: float) -> Node | None:
        length = math.hypot(px - node.x, py - node.y)
        if length < step * 1e-7 or node.run + length > most + slack:
            return None
        piece = measured(surface, node.x, node.y, px, py, node.run, z0, grade)
        if piece is None or piece.height_error > limits.height_tolerance or 100 * piece.grade_error > limits.grade_tolerance:
            return None
        heading = math.atan2(py - node.y, px - node.x)
        bend = 0.0 if node.heading is None else 0.1 * step * (1 - math.cos(heading - node.heading))
        return Node(px, py, node.run + length, heading, node.cost + length + bend, node, piece)

    def two_legs(node: Node, left: float) -> Node | None:
        """Over one bend: with a given length left it lies on an ellipse about both ends."""
        lengths = [required - node.run] if required is not None else [left * 1.25, left * 1.5, left * 2]
        for total in lengths:
            if total <= left + slack or node.run + total > most + slack:
                continue
            a, focal = total / 2, left / 2
            b = math.sqrt(max(0.0, a * a - focal * focal))
            ux, uy = (end_x - node.x) / left, (end_y - node.y) / left

            def bend(t, a=a, b=b, ux=ux, uy=uy):
                p, q = a * np.cos(t), b * np.sin(t)
                return (node.x + end_x) / 2 + p * ux - q * uy, (node.y + end_y) / 2 + p * uy + q * ux

            def off(t):
                bx, by = bend(t)
                return surface.many(bx, by)[0] - z0 - grade * (node.run + np.hypot(bx - node.x, by - node.y))

            for t in zeros(off, 128, limits.height_tolerance * 1e-3):
                first = reached(node, *(float(v) for v in bend(np.float64(t))))
                last = reached(first, end_x, end_y) if first else None
                if last:
                    return last
        return None

    def finished(node: Node, expanded: int) -> Route:
        pieces = []
        while node.before is not None:
            pieces.append(node.piece)
            node = node.before
        out = Route("Success", [(0.0, x, y, z0)], required, expanded)
        for piece in reversed(pieces):
            out.samples += piece.samples
            out.height_error, out.grade_error = max(out.height_error, piece.height_error), max(out.grade_error, 100 * piece.grade_error)
        return out

    frontier: list[tuple[float, int, Node]] = [(distance, 0, Node(x, y, 0.0, None, 0.0, None, None))]
    known: dict[tuple[int, int, int, int], float] = {}
    pushed, expanded = 1, 0
    while frontier:
        if expanded >= limits.states:
            return Route("SearchLimit", [], required, expanded)
        _, _, node = heapq.heappop(frontier)
        left = math.hypot(end_x - node.x, end_y - node.y)
        if node.run + left > most + slack:
            continue
        expanded += 1
        fits = required is not None and abs(required - node.run - left) <= limits.height_tolerance / max(abs(grade), 1e-15)
        if node.before is None or left <= 2 * step or fits:
            last = reached(node, end_x, end_y)
            if last:
                return finished(last, expanded)
        if node.before is None or left <= 3 * step:
            last = two_legs(node, left)
            if last:
                return finished(last, expanded)
        h = min(step, most - node.run)
        if h < step * 1e-7:
            continue
        ends: list[tuple[float, float]] = []
        for length in (h, h / 2):
            target = z0 + grade * (node.run + length)
            ends += [(node.x + length * math.cos(t), node.y + length * math.sin(t)) for t in around(surface, node.x, node.y, length, target, precision(target, length, limits), 128)]
        for t in [k * math.pi / 4 for k in range(8)]:  # and to the edges of the patches that meet here
            here = surface.ahead(node.x, node.y, t)
            for heading in (here and headings(here[1], here[2], grade)) or ():
                edge = leaving(surface, node.x, node.y, heading)
                if surface.cell * 1e-7 < edge < h:
                    target = z0 + grade * (node.run + edge)
                    angle = turned(surface, node.x, node.y, edge, target, heading, precision(target, edge, limits))
                    if angle is not None:
                        ends.append((node.x + edge * math.cos(angle), node.y + edge * math.sin(angle)))
        for px, py in ends:
            new = reached(node, px, py)
            if new is None or new.run + math.hypot(end_x - px, end_y - py) > most + slack:
                continue
            u, v = surface.place(px, py)
            key = (round(8 * u), round(8 * v), 0 if grade == 0 else round(8 * new.run / step), math.floor(new.heading % TURN * 16 / math.pi))
            if known.get(key, math.inf) <= new.cost:
                continue
            if pushed >= limits.stored:
                return Route("SearchLimit", [], required, expanded)
            known[key] = new.cost
            pushed += 1
            heapq.heappush(frontier, (new.cost + math.hypot(end_x - px, end_y - py), pushed, new))
    return Route("NoRouteFound", [], required, expanded)


#: Heights of candidates agree with the one required to this.
CANDIDATE_TOLERANCE = 1e-6


def candidates_at(surface: Surface, x: float, y: float, step: float, z: float) -> tuple[list[tuple[float, float, float, float]], bool, bool]:
    """Points (heading, x, y, z) at a distance with a height, in order of their headings; whether the whole circle has it;
    whether terrain is missing on it."""
    cell = min(surface.grid.cell_width, surface.grid.cell_height)
    count = int(min(8192, max(720, math.ceil(TURN * step / max(cell / 4, 1e-6)))))
    value = lambda t: surface.many(x + step * np.cos(t), y + step * np.sin(t))[0] - z
    f = value(np.arange(count) * (TURN / count))
    missing = bool(np.isnan(f).any())
    if not missing and (np.abs(f) <= CANDIDATE_TOLERANCE).all():
        return [], True, False
    out: list[tuple[float, float, float, float]] = []
    for t in zeros(value, count, CANDIDATE_TOLERANCE):
        if not any(apart(t, p[0]) * step < 1e-5 for p in out):
            px, py = x + step * math.cos(t), y + step * math.sin(t)
            out.append((t, px, py, surface.at(px, py)[0]))
    return out, False, missing


def requests(asked: DataFrame, cells: DataFrame, grid: Grid, reach: Column, solve: Callable[[Surface, dict], dict], schema: str, side: int) -> DataFrame:
    """Solve each row of ``asked(id, x, y, ...)`` on the tiles within its reach in world units."""
    if not grid.invertible:
        raise ValueError("the georeference can't be inverted")
    u, v = grid.pixel(F.col("x"), F.col("y"))
    wide, tall = reach * (math.hypot(grid.f, grid.c) / abs(grid.determinant)) + 2, reach * (math.hypot(grid.b, grid.e) / abs(grid.determinant)) + 2

    def tiles(low: Column, high: Column, size: int) -> Column:
        last = (size - 1) // side
        clip = lambda c: F.least(F.greatest(F.floor(c / side), F.lit(0)), F.lit(last)).cast("int")
        return F.explode(F.sequence(clip(low), clip(high)))

    needs = asked.select("*", u.alias("_u"), v.alias("_v"), wide.alias("_w"), tall.alias("_t"))
    needs = needs.withColumn("tile_col", tiles(F.col("_u") - F.col("_w"), F.col("_u") + F.col("_w"), grid.width))
    needs = needs.withColumn("tile_row", tiles(F.col("_v") - F.col("_t"), F.col("_v") + F.col("_t"), grid.height)).drop("_u", "_v", "_w", "_t")
    joined = needs.join(packed(cells, side), ["tile_row", "tile_col"], "left")
    names, kinds = asked.columns, arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        held = [(r, c, d) for r, c, d in zip(*(table.column(k).to_pylist() for k in ("tile_row", "tile_col", "data")), strict=True) if d is not None]
        row = table.select(names).slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist(list(solve(Surface(grid, Ground(held, side)), row)), schema=kinds)

    return joined.groupBy("id").applyInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


SAMPLES = "array<struct<distance:double,x:double,y:double,z:double>>"


def listed(samples: list[tuple[float, float, float, float]]) -> list[dict[str, float]]:
    return [dict(zip(("distance", "x", "y", "z"), s, strict=True)) for s in samples]


def trace(starts: DataFrame, cells: DataFrame, grid: Grid, limits: Limits, side: int = SIDE) -> DataFrame:
    """Both traces from each of ``starts(id, x, y)``: ``id, branch, stop, length, height_error, grade_error, samples``.

    Errors are the greatest along the line, in units of height and per cent. A start off the surface has empty traces.
    """

    def solve(surface: Surface, row: dict) -> Iterator[dict]:
        for side_ in (0, 1):
            b = followed(surface, row["x"], row["y"], side_, limits)
            yield {"id": row["id"], "branch": side_, "stop": b.stop, "length": b.samples[-1][0] if b.samples else 0.0, "height_error": b.height_error, "grade_error": b.grade_error, "samples": listed(b.samples)}

    asked = starts.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return requests(asked, cells, grid, F.lit(limits.length), solve, f"id long, branch int, stop string, length double, height_error double, grade_error double, samples {SAMPLES}", side)


def route(pairs: DataFrame, cells: DataFrame, grid: Grid, limits: Limits, side: int = SIDE) -> DataFrame:
    """A route for each of ``pairs(id, x, y, end_x, end_y)``: ``id, status, length, required, expanded, height_error, grade_error, samples``."""

    def solve(surface: Surface, row: dict) -> Iterator[dict]:
        r = routed(surface, row["x"], row["y"], row["end_x"], row["end_y"], limits)
        yield {"id": row["id"], "status": r.status, "length": r.samples[-1][0] if r.samples else 0.0, "required": r.required, "expanded": r.expanded, "height_error": r.height_error, "grade_error": r.grade_error, "samples": listed(r.samples)}

    asked = pairs.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "end_x", "end_y")))
    return requests(asked, cells, grid, F.lit(limits.length), solve, f"id long, status string, length double, required double, expanded int, height_error double, grade_error double, samples {SAMPLES}", side)


def candidates(asked: DataFrame, cells: DataFrame, grid: Grid, side: int = SIDE) -> DataFrame:
    """Where a step from each of ``asked(id, x, y, step, z)`` can end at height z: ``id, level, missing, points``.

    ``level``: the whole circle has that height, and no points are listed; ``missing``: part of it is unknown.
    """

    def solve(surface: Surface, row: dict) -> Iterator[dict]:
        found, level, missing = candidates_at(surface, row["x"], row["y"], row["step"], row["z"])
        yield {"id": row["id"], "level": level, "missing": missing, "points": [dict(zip(("heading", "x", "y", "z"), p, strict=True)) for p in found]}

    rows = asked.select("id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "step", "z")))
    return requests(rows, cells, grid, F.col("step"), solve, "id long, level boolean, missing boolean, points array<struct<heading:double,x:double,y:double,z:double>>", side)


def slope_percent(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """``id, slope``: the surface's slope in per cent at ``points(id, x, y)``; null where one of the four corners is missing.

    A join on the corner cells: no Python.
    """
    px, py = grid.pixel(F.col("x").cast("double"), F.col("y").cast("double"))
    placed = points.select("id", (px - 0.5).alias("u"), (py - 0.5).alias("v"))
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") <= grid.width - 1) & (F.col("v") <= grid.height - 1)
    corner = placed.where(inside).select("id", "u", "v", F.least(F.floor("u"), F.lit(grid.width - 2)).alias("c"), F.least(F.floor("v"), F.lit(grid.height - 2)).alias("r"))
    four = corner.select("*", F.explode(F.array(*(F.struct((F.col("r") + i).cast("int").alias("row"), (F.col("c") + j).cast("int").alias("col"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)))).alias("at")).select("id", "u", "v", "c", "r", "at.*")
    known = four.join(cells.select("row", "col", F.col("v").cast("double").alias("z")), ["row", "col"])
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}")
    one = known.groupBy("id", "u", "v", "c", "r").agg(*(pick(k) for k in range(4)))
    fu, fv = F.col("u") - F.col("c"), F.col("v") - F.col("r")
    du = (F.col("z1") - F.col("z0")) * (1 - fv) + (F.col("z3") - F.col("z2")) * fv
    dv = (F.col("z2") - F.col("z0")) * (1 - fu) + (F.col("z3") - F.col("z1")) * fu
    gx, gy = (du * grid.f - dv * grid.e) / grid.determinant, (dv * grid.b - du * grid.c) / grid.determinant
    found = one.select(F.col("id").alias("of"), (100 * F.sqrt(gx * gx + gy * gy)).alias("slope"))
    return points.join(found, F.col("id") == F.col("of"), "left").select("id", "slope")
