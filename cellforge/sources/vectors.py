"""Vector features: GeoJSON, CSV points, the object-list format, palettes; all make or take rows of features.

Files of this kind are small and parsed whole; many files are parsed in parallel by ``spark.read.text(wholetext=True)``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

Point = tuple[float, float]
Feature = tuple[int, str, str | None, list[Point]]

SCHEMA = "seq long, kind string, attribute string, points array<struct<x:double,y:double>>"
#: The properties that name a feature, in order of precedence.
NAMING = ("attribute", "name", "label", "level", "id")


def frame(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    return spark.createDataFrame([(i, k, a, [{"x": x, "y": y} for x, y in p]) for i, k, a, p in features], SCHEMA)


def number(value: float) -> str:
    return repr(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _named(feature: dict) -> str | None:
    properties = feature.get("properties") or {}
    for key in NAMING:
        if properties.get(key) not in (None, ""):
            return str(properties[key])
    if properties:
        return "; ".join(f"{k}={v}" for k, v in properties.items() if v is not None)
    return None if feature.get("id") is None else str(feature["id"])


def _shapes(geometry: dict | None) -> Iterator[tuple[str, list[Point], bool]]:
    """(kind, points, is a hole)."""
    if not geometry:
        return
    kind, at = geometry.get("type"), geometry.get("coordinates")
    if kind == "GeometryCollection":
        for inner in geometry.get("geometries", []):
            yield from _shapes(inner)
    elif kind == "Point":
        yield "point", [(float(at[0]), float(at[1]))], False
    elif kind == "LineString":
        yield "poly", [(float(p[0]), float(p[1])) for p in at], False
    elif kind == "Polygon":
        for k, ring in enumerate(at):
            points = [(float(p[0]), float(p[1])) for p in ring]
            if len(points) > 1 and points[0] == points[-1]:
                points.pop()
            yield "polygon", points, k > 0
    elif kind in ("MultiPoint", "MultiLineString", "MultiPolygon"):
        for part in at:
            yield from _shapes({"type": kind[5:], "coordinates": part})


def parse_geojson(text: str) -> list[Feature]:
    """Features of a collection, a feature or a bare geometry; holes are polygons of their own."""
    root = json.loads(text)
    features = root["features"] if root.get("type") == "FeatureCollection" else [root if root.get("type") == "Feature" else {"geometry": root}]
    out: list[Feature] = []
    for feature in features:
        name = _named(feature)
        for kind, points, hole in _shapes(feature.get("geometry")):
            out.append((len(out), kind, f"{name or ''} (hole)" if hole else name, points))
    return out


def geojson(features: Sequence[Feature]) -> str:
    """A feature collection; rings are closed, boxes are rings, ovals have 36 corners."""
    done = []
    for _, kind, attribute, points in features:
        if kind in ("box", "map_box", "oval") and len(points) == 2:
            (x0, y0), (x1, y1) = points
            if kind == "oval":
                points = [((x0 + x1) / 2 + (x1 - x0) / 2 * math.cos(math.tau * k / 36), (y0 + y1) / 2 + (y1 - y0) / 2 * math.sin(math.tau * k / 36)) for k in range(36)]
            else:
                points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
            kind = "polygon"
        flat = [list(p) for p in points]
        if kind in ("polygon", "map_polygon"):
            geometry = {"type": "Polygon", "coordinates": [[*flat, flat[0]]]}
        elif kind in ("point", "text", "vtext"):
            geometry = {"type": "Point", "coordinates": flat[0]}
        else:
            geometry = {"type": "LineString", "coordinates": flat}
        done.append({"type": "Feature", "geometry": geometry, "properties": {} if attribute is None else {"attribute": attribute}})
    return json.dumps({"type": "FeatureCollection", "features": done}, ensure_ascii=False)


X_NAMES = ("x", "easting", "eastings", "lon", "longitude", "eov_y")
Y_NAMES = ("y", "northing", "northings", "lat", "latitude", "eov_x")


def _fields(line: str, separator: str) -> list[str]:
    out, field, quoted = [], "", False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == separator and not quoted:
            out.append(field.strip())
            field = ""
        else:
            field += c
    return [*out, field.strip()]


def parse_csv_points(text: str) -> list[Feature]:
    """Points of a table: the separator is a tab, semicolon or comma, whichever the first line has first in this order; a
    header is there if its first two fields are no numbers. Other columns become the attribute."""
    lines = [x for x in text.lstrip("\ufeff").splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not lines:
        return []
    separator = next((s for s in "\t;," if s in lines[0]), ",")

    def value(field: str) -> float | None:
        try:
            return float(field.replace(",", ".") if separator != "," else field)
        except ValueError:
            return None

    head = _fields(lines[0], separator)
    titled = all(value(f) is None for f in head[:2])
    names = [f.lower() for f in head] if titled else []
    at_x = next((i for i, n in enumerate(names) if n in X_NAMES), 0)
    at_y = next((i for i, n in enumerate(names) if n in Y_NAMES), 1)
    out: list[Feature] = []
    for line in lines[titled:]:
        fields = _fields(line, separator)
        if max(at_x, at_y) >= len(fields):
            continue
        x, y = value(fields[at_x]), value(fields[at_y])
        if x is None or y is None:
            continue
        rest = [(i, f) for i, f in enumerate(fields) if i not in (at_x, at_y) and f]
        texts = [f"{head[i]}={f}" if titled and len(head) > 3 and i < len(head) else f for i, f in rest]
        out.append((len(out), "point", "; ".join(texts) or None, [(x, y)]))
    return out


def csv_points(features: Sequence[Feature]) -> str:
    rows = ["x,y,attribute"]
    for _, _, attribute, points in features:
        for x, y in points:
            text = attribute or ""
            rows.append(f"{number(x)},{number(y)}," + ('"' + text + '"' if "," in text else text))
    return "\n".join(rows) + "\n"


#: Fields of each kind of object, and where its coordinates lie (a list, or first and last plain field).
OBJECTS: dict[str, tuple[int, str | tuple[int, int]]] = {
    "point": (8, (1, 3)), "box": (12, (1, 5)), "oval": (12, (1, 5)), "map_box": (13, (1, 5)), "poly": (13, "list"), "polygon": (11, "list"),
    "map_polygon": (12, "list"), "text": (15, (1, 3)), "vtext": (19, (1, 7)),
}
TOKEN = re.compile(r'"((?:\\.|[^"\\])*)"|\[([^\]]*)\]|([^,()\[\]"]+)', re.S)


def _objects(text: str) -> Iterator[tuple[str, list[str | list[str]]]]:
    """(name, fields) of each ``name(...).``; quotes and brackets may span lines."""
    at = 0
    while m := re.compile(r"\s*([a-z_]+)\(").match(text, at):
        at, fields, field = m.end(), [], ""
        got: str | list[str] | None = None
        while at < len(text):
            c = text[at]
            if c in '"[':
                token = TOKEN.match(text, at)
                if token is None:
                    raise ValueError(f"unfinished object {m[1]}")
                got = token[1].replace('\\"', '"').replace("\\n", "\n") if c == '"' else [x.strip() for x in token[2].split(",")]
                at = token.end()
                continue
            if c in ",)":
                fields.append(got if got is not None else field.strip())
                field, got = "", None
                at += 1
                if c == ")":
                    break
                continue
            field += c
            at += 1
        at += text[at : at + 1] == "."
        yield m[1], fields


def parse_objects(text: str) -> list[Feature]:
    """Objects of the list format; the number of points that an object states is not relied on."""
    out: list[Feature] = []
    for name, fields in _objects(text):
        if name not in OBJECTS:
            raise ValueError(f"unknown object {name}")
        _, where = OBJECTS[name]
        if where == "list":
            numbers = [float(x) for x in next(f for f in fields if isinstance(f, list)) if x]
        else:
            numbers = [float(str(f)) for f in fields[where[0] : where[1]]]
        attribute = fields[0] if isinstance(fields[0], str) and fields[0] else None
        out.append((len(out), name, attribute, list(zip(numbers[::2], numbers[1::2], strict=True))))
    return out


def objects(features: Sequence[Feature]) -> str:
    """Points, polylines, polygons and boxes in the list format, plain style; numbers never have exponents."""

    def shown(x: float) -> str:
        return f"{x:.7f}".rstrip("0").rstrip(".") or "0"

    out = []
    for _, kind, attribute, points in features:
        name = "" if attribute is None else '"' + attribute.replace('"', '\\"').replace("\n", "\\n") + '"'
        flat = ",".join(f"{shown(x)},{shown(y)}" for x, y in points)
        if kind == "point":
            out.append(f"point({name},{flat},0,0,0,0,0).")
        elif kind in ("box", "oval"):
            out.append(f"{kind}({name},{flat},0,1,0,0,0,0,0).")
        elif kind == "polygon":
            out.append(f"polygon({name},{len(points)},[{flat}],0,1,0,0,0,0,0,0).")
        else:
            out.append(f"poly({name},{len(points)},[{flat}],0,1,0,0,0,0,0,0,0,0).")
    return "\n".join(out) + "\n"


def extent(features: DataFrame) -> DataFrame:
    """``min_x, min_y, max_x, max_y`` of all points."""
    from pyspark.sql import functions as F

    p = features.select(F.explode("points").alias("p"))
    return p.agg(F.min("p.x").alias("min_x"), F.min("p.y").alias("min_y"), F.max("p.x").alias("max_x"), F.max("p.y").alias("max_y"))


def parse_palette(text: str) -> list[tuple[int, int, int]]:
    """256 colours from lines of three numbers; comments are passed over and a short palette repeats its last colour."""
    rows = []
    for line in text.splitlines():
        line = re.split(r"//|#", line)[0]
        parts = [p for p in re.split(r"[\s,;]+", line) if p]
        if len(parts) >= 3:
            rows.append(tuple(max(0, min(255, int(float(p)))) for p in parts[:3]))
    if not rows:
        raise ValueError("no colours")
    return (rows + [rows[-1]] * 256)[:256]


def palette_text(rows: list[tuple[int, int, int]]) -> str:
    """Text that ``parse_palette`` reads back: a line of three numbers for each of up to 256 colours."""
    return "".join(f"{r}\t{g}\t{b}\n" for r, g, b in rows[:256])
