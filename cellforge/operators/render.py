"""Colours as expressions: palettes, stretches, look-up tables, composites, relief images.

A palette has 256 entries and lives on the driver. What depends on a cell is a Catalyst expression: colour tables go into
the plan as one literal, and an image is cells with ``argb``, one integer a cell (alpha in the highest byte).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import focal, stats
from .grid import Grid

Rgb = tuple[int, int, int]
Rgba = tuple[int, int, int, int]

#: Entries of a palette, and of a table that images are rendered with.
ENTRIES, TABLE = 256, 4096
#: No colour at all.
CLEAR: Rgba = (0, 0, 0, 0)
#: Fixed value: what heights fade into.
HAZE: Rgb = (225, 235, 240)


def hex_colour(text: str) -> Rgba:
    """``#rgb``, ``#rrggbb`` or ``#rrggbbaa``."""
    digits = text.strip().lstrip("#")
    if len(digits) == 3:
        digits = "".join(c + c for c in digits)
    if len(digits) not in (6, 8):
        raise ValueError(f"{text!r} is no colour")
    parts = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
    return (parts[0], parts[1], parts[2], parts[3] if len(parts) == 4 else 255)


def packed(colours: np.ndarray) -> np.ndarray:
    """Signed 32-bit integers of rows red, green, blue, alpha."""
    c = colours.astype(np.uint32)
    return (c[:, 3] << 24 | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]).astype(np.uint32).view(np.int32)


def between(first: np.ndarray, second: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Colours a share of the way from one to another, rounded half up."""
    t = np.clip(t, 0.0, 1.0)[:, None]
    return np.floor((1.0 - t) * first + t * second + 0.5).astype(np.uint8)


@dataclass(frozen=True)
class Palette:
    """A name and 256 colours, rows of red, green, blue and alpha."""

    name: str
    colours: np.ndarray = field(repr=False)

    def __post_init__(self) -> None:
        if self.colours.shape != (ENTRIES, 4):
            raise ValueError(f"a palette has {ENTRIES} entries")

    @classmethod
    def from_stops(cls, name: str, stops: Iterable[tuple[float, Rgba | Rgb | str]]) -> Palette:
        """Colours between stops at places from 0 to 1; beyond the outer ones their colours."""
        ordered = sorted(((float(p), hex_colour(c) if isinstance(c, str) else (*c, 255)[:4]) for p, c in stops), key=lambda s: s[0])
        if not ordered:
            raise ValueError("a palette needs a stop")
        places, colours = np.array([p for p, _ in ordered]), np.array([c for _, c in ordered], dtype=float)
        t = np.arange(ENTRIES) / (ENTRIES - 1)
        after = np.clip(np.searchsorted(places, t, side="left"), 0, len(places) - 1)
        before = np.maximum(after - 1, 0)
        gap = places[after] - places[before]
        share = np.where(gap > 0, (t - places[before]) / np.where(gap > 0, gap, 1.0), 0.0)
        share = np.where(t >= places[-1], 1.0, share)
        return cls(name, between(colours[before], colours[after], share))

    @classmethod
    def from_colours(cls, name: str, colours: Sequence[Rgba | Rgb | str]) -> Palette:
        """Evenly spaced stops."""
        return cls.from_stops(name, [(i / max(1, len(colours) - 1), c) for i, c in enumerate(colours)])

    @classmethod
    def from_rows(cls, name: str, rows: Sequence[Sequence[int]]) -> Palette:
        """Entries as given; the last one goes on, further ones are ignored."""
        if not rows:
            raise ValueError("a palette needs a row")
        at = np.minimum(np.arange(ENTRIES), len(rows) - 1)
        rgb = np.clip(np.array([r[:3] for r in rows])[at], 0, 255)
        return cls(name, np.column_stack((rgb, np.full(ENTRIES, 255))).astype(np.uint8))

    @classmethod
    def from_image(cls, name: str, pixels: np.ndarray) -> Palette:
        """The colours along the middle of an image's longer side (rows, columns, red to alpha)."""
        height, width = pixels.shape[:2]
        line = pixels[:, width // 2] if height >= width else pixels[height // 2]
        return cls(name, line[np.rint(np.arange(ENTRIES) / (ENTRIES - 1) * (len(line) - 1)).astype(int)].astype(np.uint8))

    @classmethod
    def uniform(cls, name: str, colour: Rgba | Rgb | str) -> Palette:
        return cls.from_stops(name, [(0.0, colour)])

    def reversed(self) -> Palette:
        return Palette(f"{self.name} (reversed)", self.colours[::-1].copy())

    def sample(self, t: np.ndarray) -> np.ndarray:
        """Colours at shares 0 to 1, between entries; clear where a share is no number."""
        t = np.asarray(t, dtype=float)
        known = ~np.isnan(t)
        place = np.clip(np.where(known, t, 0.0), 0.0, 1.0) * (ENTRIES - 1)
        low = np.floor(place).astype(int)
        out = between(self.colours[low].astype(float), self.colours[np.minimum(low + 1, ENTRIES - 1)].astype(float), place - low)
        out[~known] = CLEAR
        return out

    def stops(self, count: int = 8) -> list[tuple[float, Rgba]]:
        """Evenly spaced stops, two at least."""
        t = np.arange(max(2, count)) / (max(2, count) - 1)
        return [(float(p), tuple(int(x) for x in c)) for p, c in zip(t, self.sample(t), strict=True)]

    def argb(self) -> np.ndarray:
        return packed(self.colours)


def ramp(stops: Sequence[Rgb], size: int = ENTRIES) -> list[Rgb]:
    """Colours between evenly spaced stops, rounded half up."""
    out = []
    for i in range(size):
        t = i / (size - 1) * (len(stops) - 1)
        k = min(int(t), len(stops) - 2)
        out.append(tuple(int(a + (b - a) * (t - k) + 0.5) for a, b in zip(stops[k], stops[k + 1], strict=True)))
    return out


#: The palettes that every library has, by their stops.
BUILT_IN: dict[str, Palette] = {
    name: Palette.from_stops(name, stops)
    for name, stops in (
        ("Grayscale", [(0.0, "#000000"), (1.0, "#FFFFFF")]),
        ("Grayscale (inverted)", [(0.0, "#FFFFFF"), (1.0, "#000000")]),
        ("Spectrum", [(0.0, "#000080"), (0.25, "#0080FF"), (0.5, "#00C000"), (0.75, "#FFD000"), (1.0, "#C00000")]),
        ("Viridis", [(0.0, "#440154"), (0.25, "#3B528B"), (0.5, "#21908C"), (0.75, "#5DC863"), (1.0, "#FDE725")]),
        ("Elevation", [(0.0, "#1A6837"), (0.3, "#7BB661"), (0.55, "#E8D9A0"), (0.78, "#A9772F"), (0.92, "#7A5230"), (1.0, "#FFFFFF")]),
        ("Land & Sea", [(0.0, "#08306B"), (0.35, "#4292C6"), (0.49, "#C6DBEF"), (0.5, "#1A6837"), (0.72, "#E8D9A0"), (0.9, "#8C6D31"), (1.0, "#FFFFFF")]),
        ("Blue-White-Red", [(0.0, "#2166AC"), (0.5, "#F7F7F7"), (1.0, "#B2182B")]),
        ("Temperature", [(0.0, "#313695"), (0.25, "#74ADD1"), (0.45, "#E0F3F8"), (0.55, "#FEE090"), (0.75, "#F46D43"), (1.0, "#A50026")]),
        ("Precipitation", [(0.0, "#FFFFD9"), (0.3, "#C7E9B4"), (0.55, "#41B6C4"), (0.78, "#225EA8"), (1.0, "#0C2C84")]),
        ("Green-Brown", [(0.0, "#1A9641"), (0.5, "#FFFFBF"), (1.0, "#8C510A")]),
    )
}
DEFAULT = BUILT_IN["Spectrum"]


class Library:
    """Palettes by name, whatever its case and Unicode form, in the order they came; and other names for them."""

    def __init__(self, built_in: bool = True) -> None:
        self._found: dict[str, Palette] = {}
        self._aliases: dict[str, str] = {}
        if built_in:
            for palette in BUILT_IN.values():
                self.add(palette)
            self.alias("Land &amp; Sea", "Land & Sea")

    @staticmethod
    def _key(name: str) -> str:
        return unicodedata.normalize("NFC", name).casefold()

    def add(self, palette: Palette) -> None:
        """A palette of a known name takes that one's place."""
        self._found[self._key(palette.name)] = palette

    def alias(self, other: str, name: str) -> None:
        self._aliases[self._key(other)] = name

    def add_files(self, folder: str, read: Callable[[str], Sequence[Sequence[int]]], failed: Callable[[str, Exception], None] | None = None) -> None:
        """Every ``.pal`` file of a folder by its stem; one that can't be read is reported and left out."""
        for path in sorted(Path(folder).glob("*.pal"), key=lambda p: p.name.casefold()):
            try:
                self.add(Palette.from_rows(path.stem, read(str(path))))
            except (OSError, ValueError) as e:
                if failed:
                    failed(str(path), e)

    @property
    def names(self) -> list[str]:
        return [p.name for p in self._found.values()]

    def get(self, name: str | None) -> Palette | None:
        if name is None:
            return None
        key = self._key(name)
        return self._found.get(key) or self._found.get(self._key(self._aliases.get(key, "")))

    def get_or_default(self, name: str | None) -> Palette:
        return self.get(name) or next(iter(self._found.values()), DEFAULT)


@dataclass(frozen=True)
class Colouring:
    """How values become colours: a range, a curve, a palette, and how its entries are applied.

    ``mode``: continuous (between entries), discrete (``classes`` of one colour) or nearest (entry).
    """

    palette: Palette
    low: float
    high: float
    gamma: float = 1.0
    invert: bool = False
    mode: str = "continuous"
    classes: int = 8
    opacity: int = 255
    no_data: Rgba = CLEAR

    def __post_init__(self) -> None:
        if self.mode not in ("continuous", "discrete", "nearest"):
            raise ValueError(f"unknown mode {self.mode}")

    def colours(self, values: np.ndarray) -> np.ndarray:
        """Rows red, green, blue, alpha; NaN has the colour of no data."""
        v = np.asarray(values, dtype=float)
        span = self.high - self.low
        t = np.clip((v - self.low) / span, 0.0, 1.0) if span > 0 else np.where(np.isnan(v), np.nan, 0.0)
        t = t**self.gamma if self.gamma > 0 and self.gamma != 1.0 else t
        t = 1.0 - t if self.invert else t
        if self.mode == "nearest":
            out = self.palette.colours[np.floor(np.where(np.isnan(t), 0.0, t) * (ENTRIES - 1) + 0.5).astype(int)].copy()
        elif self.mode == "discrete":
            n = max(1, self.classes)
            out = self.palette.sample(np.minimum(n - 1, np.floor(t * n)) / max(1, n - 1))
        else:
            out = self.palette.sample(t)
        if self.opacity != 255:
            out[:, 3] = out[:, 3].astype(int) * self.opacity // 255
        out[np.isnan(v)] = self.no_data
        return out

    def table(self, size: int = ENTRIES) -> np.ndarray:
        """Packed colours of evenly spaced values of the range."""
        size = max(2, size)
        return packed(self.colours(self.low + (self.high - self.low) * (np.arange(size) / (size - 1))))


def integers(values: np.ndarray) -> Column:
    """An array literal that the optimiser folds from one short text."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>")


def share(v: Column, low: float, high: float, gamma: float = 1.0, invert: bool = False) -> Column:
    """Where a value lies in a range, 0 to 1."""
    span = high - low
    t = F.least(F.greatest((v.cast("double") - low) / (span if span else 1.0), F.lit(0.0)), F.lit(1.0)) if span > 0 else F.when(v.isNotNull(), F.lit(0.0))
    t = F.pow(t, F.lit(gamma)) if gamma > 0 and gamma != 1.0 else t
    return 1 - t if invert else t


def coloured(cells: DataFrame, value: str, how: Colouring) -> DataFrame:
    """``row, col, argb``: the exact colour of every value, computed cell by cell."""
    v = F.col(value)
    t = share(v, how.low, how.high, how.gamma, how.invert)
    entries = how.palette.colours.astype(int)
    if how.mode == "nearest":
        at, part = F.floor(t * (ENTRIES - 1) + 0.5).cast("int"), F.lit(0.0)
    else:
        n = max(1, how.classes)
        t = F.least(F.lit(n - 1), F.floor(t * n)) / F.lit(float(max(1, n - 1))) if how.mode == "discrete" else t
        at = F.floor(t * (ENTRIES - 1)).cast("int")
        part = t * (ENTRIES - 1) - at
    placed = cells.select("row", "col", v.isNotNull().alias("known"), at.alias("at"), part.alias("part"))

    def channel(k: int) -> Column:
        table = integers(np.append(entries[:, k], entries[-1, k]))
        first, second = F.get(table, F.col("at")), F.get(table, F.col("at") + 1)
        return F.floor((1 - F.col("part")) * first + F.col("part") * second + 0.5).cast("int")

    red, green, blue, alpha = (channel(k) for k in range(4))
    alpha = alpha if how.opacity == 255 else F.floor(alpha * how.opacity / 255).cast("int")
    colour = F.shiftleft(alpha, 24).bitwiseOR(F.shiftleft(red, 16)).bitwiseOR(F.shiftleft(green, 8)).bitwiseOR(blue)
    nothing = F.lit(int(packed(np.array([how.no_data]))[0]))
    return placed.select("row", "col", F.when(F.col("known"), colour).otherwise(nothing).alias("argb"))


def rendered(cells: DataFrame, value: str, how: Colouring, size: int = TABLE) -> DataFrame:
    """``row, col, argb`` by a table of evenly spaced values: one array lookup a cell, whatever the colouring."""
    v = F.col(value).cast("double")
    span = how.high - how.low
    place = (v - how.low) * ((size - 1) / span if span > 0 else 0.0)
    at = F.when(place <= 0, 0).when(place >= size - 1, size - 1).otherwise(F.floor(place + 0.5)).cast("int")
    nothing = F.lit(int(packed(np.array([how.no_data]))[0]))
    return cells.select("row", "col", F.when(v.isNotNull() & ~F.isnan(v), F.get(integers(how.table(size)), at)).otherwise(nothing).alias("argb"))


def argb(cells: DataFrame, value: str, palette: Sequence[Rgb], low: float, high: float, gamma: float = 1.0, invert: bool = False, classes: int | None = None, opacity: int = 255) -> DataFrame:
    """``row, col, argb``: the nearest entry of any sequence of colours; null where no data."""
    table = integers(np.array([(opacity << 24 | r << 16 | g << 8 | b) - (1 << 32 if opacity >= 128 else 0) for r, g, b in palette]))
    t = share(F.col(value), low, high, gamma, invert)
    t = F.least(F.lit(classes - 1), F.floor(t * classes)) / F.lit(float(max(1, classes - 1))) if classes else t
    at = F.floor(t * (len(palette) - 1) + 0.5).cast("int")
    return cells.select("row", "col", F.when(F.col(value).isNotNull(), F.get(table, at)).alias("argb"))


def value_range(cells: DataFrame, value: str, by: str = "percentile", sigmas: float = 2.0, low: float = 2.0, high: float = 98.0) -> tuple[float, float]:
    """The range that a display stretches: all values (``minmax``), mean -+ deviations (``sigma``) or between percentiles.

    One row goes to the driver; (0, 0) where there are no values.
    """
    found = stats.statistics(cells, value)
    if by == "minmax":
        r = found.first()
        return r["min"], r["max"]
    if by == "sigma":
        r = stats.sigma_range(found, sigmas).first()
        return r["low"], r["high"]
    if by != "percentile":
        raise ValueError(f"unknown range {by}")
    r = stats.percentile_range(cells, value, low, high).first()
    return r["low"], r["high"]


def percentile(cells: DataFrame, value: str, percent: float) -> float:
    """One percentile; the least value where all are alike."""
    r = stats.percentiles(stats.histogram(cells, value), [percent]).first()
    return r["value"] if r else stats.statistics(cells, value).first()["min"]


def stretch_range(cells: DataFrame, value: str, low: float = 2.0, high: float = 98.0) -> tuple[float, float]:
    """A percentile range that isn't empty."""
    a, b = value_range(cells, value, "percentile", low=low, high=high)
    if b - a < 1e-9:
        a, b = value_range(cells, value, "minmax")
    return (a, b) if b - a >= 1e-9 else (a, a + 1)


def composite(cells: DataFrame, red: str, green: str, blue: str, ranges: Sequence[tuple[float, float]] | None = None, stretched: bool = True) -> DataFrame:
    """``row, col, r, g, b, alpha``: three stretched bands, rounded half to even; transparent where all three are missing.

    Without ranges each band is stretched from its 2nd to its 98th percentile, or if not ``stretched`` taken as 0 to 255.
    """
    if ranges is None:
        ranges = [stretch_range(cells, c) if stretched else (0.0, 255.0) for c in (red, green, blue)]
    level = lambda name, span: F.coalesce(F.rint(share(F.col(name), *span) * 255).cast("int"), F.lit(0))
    seen = F.col(red).isNotNull() | F.col(green).isNotNull() | F.col(blue).isNotNull()
    parts = [level(name, span).alias(k) for k, name, span in zip("rgb", (red, green, blue), ranges, strict=True)]
    return cells.select("row", "col", *parts, F.when(seen, 255).otherwise(0).alias("alpha"))


def swiss_relief(cells: DataFrame, grid: Grid, altitude: float = 45.0, z_factor: float = 1.0, strength: float = 0.35, haze: Rgb = HAZE) -> DataFrame:
    """``row, col, r, g, b, alpha``: the shading of several suns, fading into haze with height; transparent at gaps."""
    if not 0 <= strength <= 1:
        raise ValueError("the strength lies between 0 and 1")
    extent = stats.statistics(cells, "v").first()
    span = extent["max"] - extent["min"]
    near = focal.neighbours(cells, grid.width, grid.height)
    grey = F.least(F.greatest(focal.multi_shade(altitude, grid.cell_width, grid.cell_height, z_factor).cast("double"), F.lit(0.0)), F.lit(255.0))
    faded = share(focal.z(4), extent["min"], extent["max"]) * strength if span > 1e-9 else F.lit(0.0)
    lit = near.select("row", "col", F.when(focal.complete(), grey).alias("grey"), faded.alias("faded"))
    known = F.col("grey").isNotNull() & ~F.isnan("grey")
    parts = [F.when(known, F.floor(F.least(F.greatest(F.col("grey") + (c - F.col("grey")) * F.col("faded"), F.lit(0.0)), F.lit(255.0)))).otherwise(0).cast("int").alias(k) for k, c in zip("rgb", haze, strict=True)]
    return lit.select("row", "col", *parts, F.when(known, 255).otherwise(0).alias("alpha"))


def bands(image: DataFrame) -> DataFrame:
    """``row, col, r, g, b`` of an image with ``argb``, in single precision; transparent cells have no data."""
    c = F.col("argb")
    seen = F.shiftrightunsigned(c, 24) != 0
    part = lambda shift: F.when(seen, F.shiftright(c, shift).bitwiseAND(255).cast("float"))
    return image.select("row", "col", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def style(operation: str, cells: DataFrame, library: Library | None = None, kind: str = "") -> Colouring | None:
    """The usual colouring of a derived raster ``row, col, v``; None where it keeps its source's.

    ``operation`` is a recipe's name, ``kind`` that of a filter.
    """
    library = library or Library()

    def even(palette: str) -> Colouring:
        low, high = value_range(cells, "v")
        most = max(abs(low), abs(high)) or 1.0
        return Colouring(BUILT_IN[palette], -most, most)

    if operation == "hillshade":
        return Colouring(BUILT_IN["Grayscale"], 0.0, 255.0)
    if operation == "slope":
        return Colouring(BUILT_IN["Viridis"], 0.0, max(percentile(cells, "v", 99.0), 0.1))
    if operation == "aspect":
        return Colouring(library.get("Hue wheel (cyclic)") or BUILT_IN["Spectrum"], 0.0, 360.0)
    if operation == "curvature":
        return even("Blue-White-Red")
    if operation == "flowacc":
        return Colouring(BUILT_IN["Precipitation"], *value_range(cells, "v", "minmax"), gamma=0.35)
    if operation == "filter" and kind == "sobel":
        return Colouring(BUILT_IN["Grayscale"], 0.0, max(percentile(cells, "v", 99.0), 1e-6))
    if operation == "filter" and kind in ("emboss", "laplace", "localrelief", "custom"):
        return even("Grayscale")
    return None


def with_opacity(how: Colouring, opacity: int) -> Colouring:
    return replace(how, opacity=opacity)
