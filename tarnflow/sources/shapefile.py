"""Basin polygons from ESRI shapefiles (.shp with .dbf), small enough for the driver."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import BASINS
from . import files

REQUIRED = ("BASIN_ID", "BCU_name", "NAME", "REGION", "area_km2")
_POLYGONS = (5, 15, 25)  # with or without heights and measures


def read_shapes(path: str | Path) -> list[list[list[tuple[float, float]]] | None]:
    """Rings of each record; None for records without a shape."""
    raw = files.text_of(str(path))
    at, out = 100, []
    while at + 8 <= len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        at += 8
        (kind,) = struct.unpack_from("<i", raw, at)
        if kind in _POLYGONS:
            parts, points = struct.unpack_from("<ii", raw, at + 36)
            starts = [*struct.unpack_from(f"<{parts}i", raw, at + 44), points]
            flat = struct.unpack_from(f"<{2 * points}d", raw, at + 44 + 4 * parts)
            pairs = list(zip(flat[::2], flat[1::2]))
            out.append([pairs[a:b] for a, b in zip(starts, starts[1:])])
        elif kind == 0:
            out.append(None)
        else:
            raise ValueError(f"{path} has shapes of type {kind}, not polygons")
        at += 2 * words
    return out


def read_attributes(path: str | Path, encoding: str = "utf-8") -> list[dict]:
    """Records of a dBASE table; empty numbers are None."""
    raw = files.text_of(str(path))
    count, first, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    out = []
    for k in range(count):
        at, row = first + k * width + 1, {}
        for name, kind, size, decimals in fields:
            text = raw[at : at + size].decode(encoding, "replace").strip(" \0")
            if kind in "NF":
                text = (float(text) if decimals or kind == "F" else int(text)) if text and text[0] != "*" else None
            row[name] = text
            at += size
        out.append(row)
    return out


def read_basins(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """BASINS with `position`, the record's number; the first n only if given.

    A missing required column is an error.
    """
    attributes = read_attributes(str(path).removesuffix(".shp") + ".dbf")
    shapes = read_shapes(path)
    missing = [c for c in REQUIRED if attributes and c not in attributes[0]]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    rows = []
    for k, (a, rings) in enumerate(zip(attributes[:n], shapes[:n])):
        area = a["area_km2"]
        rows.append((int(a["BASIN_ID"]), a["BCU_name"], a["NAME"], a["REGION"], None if area is None else float(area), [[{"x": x, "y": y} for x, y in r] for r in rings or []], k))
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T.StructType([*BASINS.fields, T.StructField("position", T.IntegerType())]))


def write_basins(path: str | Path, basins: list[dict]) -> None:
    """A small polygon shapefile, for tests: dicts of the required columns and rings of (x, y)."""
    records = b""
    for k, b in enumerate(basins):
        points = [p for r in b["rings"] for p in r]
        starts = [sum(len(r) for r in b["rings"][:i]) for i in range(len(b["rings"]))]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        body = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(starts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
        records += struct.pack(">ii", k + 1, len(body) // 2) + body
    Path(path).write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + records)
    fields = [("BASIN_ID", b"N", 10, 0), ("BCU_name", b"C", 40, 0), ("NAME", b"C", 40, 0), ("REGION", b"C", 20, 0), ("area_km2", b"N", 20, 4)]
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, len(basins), 32 + 32 * len(fields) + 1, width)
    head += b"".join(n.encode().ljust(11, b"\0") + kind + b"\0" * 4 + bytes([size, decimals]) + b"\0" * 14 for n, kind, size, decimals in fields) + b"\r"
    rows = b""
    for b in basins:
        rows += b" "
        for n, kind, size, decimals in fields:
            v = b[n]
            rows += (f"{v:>{size}.{decimals}f}" if kind == b"N" else str(v).ljust(size)).encode()[:size].ljust(size)
    Path(path).with_suffix(".dbf").write_bytes(head + rows + b"\x1a")
