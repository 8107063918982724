"""Recipes: named raster operations with text parameters, and projects of layers that are made by them."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import compile_expression
from ..operators import contour, fill, focal, grade, hydro, kernels, render, stats, visibility
from ..operators.grid import Grid, clip_window, crop
from .design import Record

Raster = tuple[DataFrame, Grid]
Parameters = dict[str, str]

#: The 5 x 5 smoothing matrix with divisor 121.
GAUSS5 = ((1, 2, 3, 2, 1), (2, 7, 11, 7, 2), (3, 11, 17, 11, 3), (2, 7, 11, 7, 2), (1, 2, 3, 2, 1))


def parse_kernel(text: str) -> list[list[float]]:
    """Rows by line or semicolon, weights by space; a comma is a decimal point and 1/9 a fraction. Odd sides up to 15."""

    def weight(word: str) -> float:
        over, _, under = word.replace(",", ".").partition("/")
        return float(over) / float(under) if under else float(over)

    rows = [[weight(w) for w in line.split()] for line in re.split(r"[\n;]", text) if line.strip()]
    if not rows or len({len(r) for r in rows}) != 1 or not all(n % 2 and n <= 15 for n in (len(rows), len(rows[0]))):
        raise ValueError("a kernel has rows of one length, and odd sides up to 15")
    return rows


def kernel_text(rows: list[list[float]]) -> str:
    return "\n".join(" ".join(f"{w:g}" for w in row) for row in rows)


def yes(p: Parameters, key: str, default: str = "false") -> bool:
    return p.get(key, default).strip().lower() == "true"


def filtered(source: Raster, p: Parameters) -> Raster:
    """The filters by kind: emboss, gaussian, mean, sharpen, sobel, laplace, localrelief, custom, digiterragaussian.

    ``strict``: a missing neighbour makes the result missing; else it counts as the centre's value.
    """
    cells, grid = source
    kind, size, radius, keep = p.get("kind", "emboss").lower(), int(p.get("size", "3")), float(p.get("radius", "10")), not yes(p, "strict")
    if kind == "gaussian":
        return focal.gaussian(cells, radius / 3, grid), grid
    if kind == "laplace":
        return kernels.laplace(cells, grid, True, keep), grid
    if kind == "localrelief":
        return kernels.local_relief(cells, grid, radius), grid
    if kind == "sobel":
        return focal.sobel(focal.neighbours(cells, grid.width, grid.height)), grid
    if kind == "emboss":
        weights, divisor = focal.emboss_kernel(float(p.get("azimuth", "315")), size)
        return kernels.convolve(cells, grid, weights, divisor, fill=keep), grid
    made = {
        "mean": lambda: ([[1.0] * size] * size, float(size * size), 0.0),
        "sharpen": lambda: (focal.sharpen_kernel(float(p.get("amount", "1")), size), 1.0, 0.0),
        "digiterragaussian": lambda: (GAUSS5, 121.0, 0.0),
        "custom": lambda: (parse_kernel(p["kernel"]), float(p.get("divisor", "1")), float(p.get("offset", "0"))),
    }
    if kind not in made:
        raise ValueError(f"unknown filter {kind}")
    weights, divisor, offset = made[kind]()
    return kernels.convolve(cells, grid, weights, divisor, offset, keep), grid


def near(source: Raster) -> DataFrame:
    return focal.neighbours(source[0], source[1].width, source[1].height)


def directions(source: Raster) -> DataFrame:
    cells, grid = source
    return hydro.flow_direction(cells, grid.width, grid.height, grid.cell_width, grid.cell_height)


def banded(source: Raster, p: Parameters) -> Raster:
    cells, grid = source
    bands = {c: F.col(c) for c in cells.columns if c not in ("row", "col")} | ({"b1": F.col("v")} if "v" in cells.columns else {})
    return cells.select("row", "col", compile_expression(p.get("expr", "b1"), bands).alias("v")), grid


def clipped(source: Raster, p: Parameters) -> Raster:
    cells, grid = source
    window = clip_window(grid, tuple(float(p[k]) for k in ("minX", "minY", "maxX", "maxY")))
    return crop(cells, grid, *window, "v")


def lined(source: Raster, p: Parameters) -> DataFrame:
    """Contours between ``min`` and ``max`` (equal: of the whole raster), of a Bézier surface where ``factor`` is above 1."""
    cells, grid = source
    interval, factor = float(p.get("interval", "10")), int(p.get("factor", "1"))
    least, most = float(p.get("min", "0")), float(p.get("max", "0"))
    if least == most:
        r = stats.statistics(cells, "v").first()
        least, most = r["min"], r["max"]
    if factor > 1:
        cells, grid = kernels.bezier_subdivide(cells, grid, factor)
    pieces = contour.segments(cells, interval, least, most)
    px, py = (F.transform("points", lambda q: grid.world(q["x"], q["y"])[k]) for k in (0, 1))
    drawn = contour.lines(pieces, interval, int(p.get("smooth", "0")), int(p.get("index", "5")))
    # points and lengths in world units: lines are chained in pixels, where ends that meet are equal
    placed = drawn.withColumn("points", F.arrays_zip(px.alias("x"), py.alias("y"))).withColumn("points", F.transform("points", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    placed = placed.withColumn("length", contour.length(F.col("points")))
    return placed.where(F.col("length") >= float(p.get("minlen", "0")))


def reaches(source: Raster, p: Parameters) -> DataFrame:
    found = directions(source)
    return hydro.stream_segments(found, hydro.flow_accumulation(found), float(p.get("threshold", "100")))


def curved(source: Raster, p: Parameters) -> Raster:
    window = tuple(int(p.get(k, "0")) for k in ("x", "y", "w", "h")) if "w" in p else None
    return kernels.bezier_subdivide(*source, int(p.get("factor", "4")), float(p.get("tension", "1")), yes(p, "monotone"), strict=yes(p, "strict"), window=window)


def band_of(source: Raster, p: Parameters) -> DataFrame:
    """Band number ``band`` (from 0) as ``v``."""
    cells = source[0]
    names = [c for c in cells.columns if c not in ("row", "col")]
    k = int(p.get("band", "0"))
    if not 0 <= k < len(names):
        raise ValueError(f"there is no band {k}")
    return cells.select("row", "col", F.col(names[k]).alias("v"))


def graded(source: Raster, p: Parameters) -> DataFrame:
    """One branch (0 or 1) of the line of constant grade from (x, y)."""
    branch = int(p.get("branch", "0"))
    if branch not in (0, 1):
        raise ValueError("a line has branches 0 and 1")
    start = source[0].sparkSession.createDataFrame([(0, float(p.get("x", "0")), float(p.get("y", "0")))], "id long, x double, y double")
    return grade.trace(start, band_of(source, p), source[1], grade_limits(p)).where(F.col("branch") == branch)


def routed(source: Raster, p: Parameters) -> DataFrame:
    """A route of constant grade from (x, y) to (endX, endY)."""
    ends = [float(p.get(k, "0")) for k in ("x", "y", "endX", "endY")]
    pair = source[0].sparkSession.createDataFrame([(0, *ends)], "id long, x double, y double, end_x double, end_y double")
    return grade.route(pair, band_of(source, p), source[1], grade_limits(p))


def designed(source: Raster, p: Parameters) -> DataFrame:
    """The line of a stored design."""
    record = Record.from_json(p["design"])
    points = [{"x": float(v[0]), "y": float(v[1])} for v in record.vertices]
    return source[0].sparkSession.createDataFrame([(float(record.grade), float(record.vertices[-1][3]), points)], "grade double, length double, points array<struct<x:double,y:double>>")


def grade_limits(p: Parameters) -> grade.Limits:
    return grade.Limits(float(p.get("grade", "5")), float(p.get("length", "1000")), float(p.get("heightTolerance", "0.02")), float(p.get("gradeTolerance", "0.1")))


def like(source: Raster, cells: DataFrame) -> Raster:
    return cells, source[1]


#: Operation by name: a raster and parameters to a raster, or to a table of features.
OPERATIONS: dict[str, Callable[[Raster, Parameters], Raster | DataFrame]] = {
    "bandmath": banded,
    "slope": lambda s, p: like(s, focal.slope(near(s), s[1].cell_width, s[1].cell_height, p.get("units", "degrees").lower() == "percent", float(p.get("zFactor", "1")))),
    "aspect": lambda s, p: like(s, focal.aspect(near(s), s[1].cell_width, s[1].cell_height)),
    "hillshade": lambda s, p: like(s, focal.hillshade(near(s), float(p.get("azimuth", "315")), float(p.get("altitude", "45")), s[1].cell_width, s[1].cell_height, float(p.get("zFactor", "1")))),
    "multihillshade": lambda s, p: like(s, focal.multi_hillshade(near(s), float(p.get("altitude", "45")), s[1].cell_width, s[1].cell_height, float(p.get("zFactor", "1")))),
    "curvature": lambda s, p: like(s, focal.curvature(near(s), p.get("type", "General").lower(), s[1].cell_width, s[1].cell_height)),
    "flowdir": lambda s, p: like(s, directions(s)),
    "flowacc": lambda s, p: like(s, hydro.flow_accumulation(directions(s))),
    "filter": filtered,
    "bezier": curved,
    "swissrelief": lambda s, p: like(s, render.swiss_relief(*s)),
    "neutral-line": graded,
    "neutral-route": routed,
    "neutral-design": designed,
    "clip": clipped,
    "fill": lambda s, p: like(s, fill.fill_nearest(*s) if p.get("method", "idw").lower() == "nearest" else fill.fill_idw(*s, int(p.get("maxDistance", "100")), int(p.get("smoothing", "1")))),
    "viewshed": lambda s, p: like(s, visibility.viewshed(*s, int(p["col"]), int(p["row"]), float(p.get("observerHeight", "1.8")), float(p.get("targetHeight", "0")), int(p["maxDistance"]) if "maxDistance" in p else None)),
    "contours": lined,
    "streams": reaches,
}


@dataclass(frozen=True)
class Recipe:
    """An operation, the layer it applies to, and its parameters."""

    operation: str
    source: str
    parameters: Parameters = field(default_factory=dict)

    def apply(self, source: Raster) -> Raster | DataFrame:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation}")
        return OPERATIONS[self.operation](source, self.parameters)


@dataclass(frozen=True)
class Layer:
    id: str
    kind: str = "raster"
    name: str = ""
    path: str | None = None
    recipe: Recipe | None = None


#: The newest project version that is read, and the one written.
VERSION = 2


@dataclass
class Project:
    """A stack of layers; a layer is read from a file or made by a recipe from another one, lazily either way."""

    layers: list[Layer] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Project:
        """Read a project; layer paths in the file are relative to it."""
        with open(path, encoding="utf-8") as f:
            root = json.load(f)
        if root.get("version", 1) > VERSION:
            raise ValueError(f"project version {root['version']} is newer than {VERSION}")
        base = os.path.dirname(os.path.abspath(path))
        layers = []
        for x in root.get("layers", []):
            recipe = Recipe(**x["recipe"]) if x.get("recipe") else None
            at = os.path.normpath(os.path.join(base, x["path"])) if x.get("path") else None
            layers.append(Layer(x["id"], x.get("kind", "raster"), x.get("name", ""), at, recipe))
        return cls(layers)

    def save(self, path: str) -> None:
        base = os.path.dirname(os.path.abspath(path))
        layers = []
        for layer in self.layers:
            x = {k: v for k, v in asdict(layer).items() if v is not None}
            if layer.path:
                x["path"] = os.path.relpath(layer.path, base).replace(os.sep, "/")
            layers.append(x)
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "layers": layers}, f, indent=2, ensure_ascii=False)

    def resolve(self, layer_id: str, read: Callable[[Layer], Raster]) -> Raster | DataFrame:
        """The layer's data: ``read`` opens files; recipes are applied to what their source resolves to."""
        by_id = {x.id: x for x in self.layers}

        def made(wanted: str, above: tuple[str, ...]) -> Raster | DataFrame:
            if wanted in above:
                raise ValueError(f"layer {wanted} is made from itself")
            layer = by_id[wanted]
            if layer.recipe is None:
                return read(layer)
            return layer.recipe.apply(made(layer.recipe.source, (*above, wanted)))

        return made(layer_id, ())


def profile_spacing(length: float, cell: float) -> float:
    """Spacing of an interactive profile: fine enough for the screen and the cells, at most 8,000 samples."""
    return max(min(length / 600, cell / 4), length / 8000, 1e-9) if math.isfinite(length) else cell
