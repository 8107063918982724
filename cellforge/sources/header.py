"""The text header of a dataset: nested ``Name Begin`` ... ``Name End`` blocks of ``key = value``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from ..operators.grid import Grid

Value = str | list[str]


class HeaderError(ValueError):
    """A header lacks what is needed."""


@dataclass
class Block:
    """A block in order of its entries and inner blocks; names are looked up without regard to case."""

    name: str
    entries: list[tuple[str, Value]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def get(self, key: str, default: str | None = None) -> str | None:
        found = next((v for k, v in self.entries if k.lower() == key.lower()), default)
        return " ".join(found) if isinstance(found, list) else found

    def items(self, key: str) -> list[str]:
        found = next((v for k, v in self.entries if k.lower() == key.lower()), [])
        return found if isinstance(found, list) else [found]

    def number(self, key: str, default: float | None = None) -> float | None:
        found = self.get(key)
        return default if found is None else float(found)

    def put(self, key: str, value: Value | float | None) -> None:
        """Set an entry where it stands, or at the end; None takes it away. Numbers are written so that they read back equal."""
        if isinstance(value, float):
            value = str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
        elif isinstance(value, int):
            value = str(value)
        at = next((i for i, (k, _) in enumerate(self.entries) if k.lower() == key.lower()), None)
        if value is None:
            self.entries = [e for e in self.entries if e[0].lower() != key.lower()]
        elif at is None:
            self.entries.append((key, value))
        else:
            self.entries[at] = (self.entries[at][0], value)

    def inner(self, name: str) -> Block:
        """The inner block of this name, made if there is none."""
        found = next((b for b in self.blocks if b.name.lower() == name.lower()), None)
        if found is None:
            found = Block(name)
            self.blocks.append(found)
        return found

    def child(self, name: str) -> Block:
        return next((b for b in self.blocks if b.name.lower() == name.lower()), Block(name))

    def children(self, name: str) -> list[Block]:
        return [b for b in self.blocks if b.name.lower() == name.lower()]


def _uncommented(line: str) -> str:
    quoted = False
    for i, c in enumerate(line):
        if c == '"' and (i == 0 or line[i - 1] != "\\"):
            quoted = not quoted
        elif c == "#" and not quoted:
            return line[:i]
    return line


def _plain(token: str) -> str:
    token = token.strip()
    if len(token) > 1 and token[0] == token[-1] == '"':
        return token[1:-1].replace('\\"', '"')
    return token


ITEM = re.compile(r'"(?:\\.|[^"\\])*"|[^\s,{}]+')


def parse(text: str) -> Block:
    """The blocks of a header under a root without a name; stray words and ends without a beginning are passed over."""
    root = Block("")
    open_ = [root]
    lines = iter(text.splitlines())
    for raw in lines:
        line = _uncommented(raw).strip()
        words = line.split()
        if len(words) == 2 and words[1].lower() == "begin":
            block = Block(words[0])
            open_[-1].blocks.append(block)
            open_.append(block)
        elif len(words) == 2 and words[1].lower() == "end":
            if len(open_) > 1:
                open_.pop()
        elif "=" in line.split('"')[0]:
            key, _, value = (p.strip() for p in line.partition("="))
            if value.startswith("{"):
                while "}" not in value:
                    more = next(lines, None)
                    if more is None:
                        break
                    value += "\n" + _uncommented(more)
                open_[-1].entries.append((key, [_plain(x) for x in ITEM.findall(value)]))
            else:
                open_[-1].entries.append((key, _plain(value)))
    return root


def written(block: Block, depth: int = 0) -> str:
    """Text that parses to the same blocks."""
    tab = "\t" * depth
    out = []
    for key, value in block.entries:
        if isinstance(value, list):
            out.append(f"{tab}{key} = {{ {' '.join(map(_shown, value))} }}")
        else:
            out.append(f"{tab}{key} = {_shown(value)}")
    for inner in block.blocks:
        out += [f"{tab}{inner.name} Begin", written(inner, depth + 1), f"{tab}{inner.name} End"]
    return "\n".join(x for x in out if x)


def _shown(value: str) -> str:
    bare = re.fullmatch(r"[A-Za-z][A-Za-z0-9]*|[-+0-9.:eE]+", value)
    return value if bare else '"' + value.replace('"', '\\"') + '"'


def degrees(text: str | None) -> float:
    """An angle written as degrees, or degrees:minutes:seconds; the sign counts even before a zero."""
    if not text:
        return 0.0
    sign = -1.0 if text.strip().startswith("-") else 1.0
    parts = [abs(float(p)) for p in text.strip().lstrip("+-").split(":")]
    return sign * sum(p / 60**k for k, p in enumerate(parts))


#: Bytes and NumPy kind of each cell type.
CELL_TYPES = {
    "Unsigned8BitInteger": "u1", "Signed8BitInteger": "i1", "Unsigned16BitInteger": "u2", "Signed16BitInteger": "i2",
    "Unsigned32BitInteger": "u4", "Signed32BitInteger": "i4", "IEEE4ByteReal": "f4", "IEEE8ByteReal": "f8",
}


@dataclass(frozen=True)
class RasterHeader:
    """What reading a raster needs."""

    grid: Grid
    bands: int
    cell_type: str
    big_endian: bool
    offset: int
    null_value: float | None
    data_file: str | None
    epsg: int | None
    units: str

    @classmethod
    def of(cls, text: str) -> RasterHeader:
        head = next(iter(parse(text).children("DatasetHeader")), None)
        if head is None:
            raise HeaderError("no DatasetHeader block")
        raster, space = head.child("RasterInfo"), head.child("CoordinateSpace")
        cell_type = next((t for t in CELL_TYPES if t.lower() == (raster.get("CellType") or "").lower()), None)
        width, height = raster.number("NrOfCellsPerLine"), raster.number("NrOfLines")
        if cell_type is None or not width or not height or width < 1 or height < 1:
            raise HeaderError("no known cell type, or no size")
        cell, place = raster.child("CellInfo"), raster.child("RegistrationCoord")
        x = place.number("Eastings", place.number("MetersX"))
        y = place.number("Northings", place.number("MetersY"))
        if x is None or y is None:
            x, y = degrees(place.get("Longitude")), degrees(place.get("Latitude"))
        grid = Grid.of_header(
            int(width), int(height), cell.number("Xdimension", 1.0), cell.number("Ydimension", 1.0), x, y,
            raster.number("RegistrationCellX", 0.0), raster.number("RegistrationCellY", 0.0), degrees(space.get("Rotation")),
        )
        units = space.get("Units") or ("degrees" if (space.get("CoordinateType") or "").upper() == "LATLONG" else "metres")
        return cls(
            grid, int(raster.number("NrOfBands", 1.0)), cell_type, (head.get("ByteOrder") or "").lower() != "lsbfirst", int(head.number("HeaderOffset", 0.0)),
            raster.number("NullCellValue"), head.get("DataFile"), epsg(space.get("Projection"), space.get("Datum")), units,
        )


def data_file(header_path: str, named: str | None, exists: set[str]) -> str | None:
    """Which of the existing files holds a header's data: the named one, then the header's stem, bare or with .dat."""
    path = PurePosixPath(header_path)
    stem = path.with_suffix("")
    tries = [path.parent / named.replace("\\", "/").rstrip(".")] if named else []
    return next((str(p) for p in [*tries, stem, PurePosixPath(f"{stem}.dat")] if str(p) in exists), None)


#: Names of coordinate systems, and of datums whose geographic system stands for an unprojected raster.
NAMED = {
    "EOV": 23700, "BMG:EOV": 23700, "HD72/EOV": 23700, "HD72 / EOV": 23700, "GEODETIC": 4326, "LL": 4326, "LATLONG": 4326, "LONGLAT": 4326,
    "WGS84": 4326, "WGS84LL": 4326, "WEBMERCATOR": 3857, "WEB MERCATOR": 3857, "GOOGLE": 3857,
}
DATUMS = {
    "WGS84": 4326, "WGS 84": 4326, "NAD83": 4269, "NAD27": 4267, "GDA94": 4283, "AGD66": 4202, "AGD84": 4203, "ETRS89": 4258,
    "HD72": 4237, "OSGB36": 4277,
}
#: Grids by zone, their first and last zones, and the number that the zone is added to.
ZONED = (
    (r"NUTM(\d+)", 1, 60, 32600), (r"SUTM(\d+)", 1, 60, 32700), (r"UTM(\d+)N", 1, 60, 32600), (r"UTM(\d+)S", 1, 60, 32700),
    (r"TMAMG(\d+)", 48, 58, 20200), (r"AMG(\d+)", 48, 58, 20200), (r"MGA(\d+)", 46, 59, 28300),
)


def epsg(projection: str | None, datum: str | None) -> int | None:
    """The EPSG number that names suggest: one written out, a known name, a zone of a grid; a datum only if unprojected."""

    def name(text: str | None) -> str:
        return (text or "").strip().strip('"').strip().upper()

    def numbered(text: str) -> int | None:
        m = re.fullmatch(r"(?:EPSG\s*:\s*)?\+?(\d+)", text)
        return int(m[1]) if m and int(m[1]) > 0 else None

    system = name(projection)
    if (number := numbered(system)) is not None:
        return number
    if system in NAMED:
        return NAMED[system]
    for pattern, first, last, base in ZONED:
        m = re.fullmatch(pattern, system.replace(" ", ""))
        if m and first <= int(m[1]) <= last:
            return base + int(m[1])
    if system not in ("", "RAW", "LOCAL"):
        return None
    spheroid = name(datum)
    return numbered(spheroid) or DATUMS.get(spheroid) or NAMED.get(spheroid)
