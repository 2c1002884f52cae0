"""NetCDF files as a data source, in time chunks: classic (1, 2 and 5) and NetCDF-4.

    spark.dataSource.register(NetCdfSource)
    spark.read.format("netcdf").option("variable", "qtot").load(path)

One partition reads one file's stretch of time steps, and of it only the bytes it
needs: of the steps between the options `from` and `to`, and of the cells in the
option `cells` (spans of each row of the grid, see `spans_of`), which seeks within a
step or decodes the storage chunks that hold such cells.  No other cell becomes a row.
(They are options because Spark 4.1 keeps the partitions of a filter that it pushed
into such a source for later queries over the same DataFrame, which loses rows.)

Packed values are unpacked: scale_factor and add_offset, after fill flags.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import json
import struct
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import AREA, GRID
from . import files
from .hdf5 import SIGNATURE, Hdf5, ranges

# The format's type codes and tags.
_TYPES = {1: ("i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8), 7: ("u1", 1), 8: (">u2", 2), 9: (">u4", 4), 10: (">i8", 8), 11: (">u8", 8)}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: str
    begin: int


@dataclass
class Header:
    records: int
    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable] = field(default_factory=dict)
    record_size: int = 0


class _Cursor:
    """Fields of a header; counts take 8 bytes in version 5."""

    def __init__(self, raw: bytes, version: int):
        self.raw, self.at, self.wide = raw, 4, version == 5

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.raw):
            raise EOFError
        return self.raw[self.at - n : self.at]

    def number(self, code: str = ">i") -> int:
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]

    def count(self) -> int:
        return self.number(">q" if self.wide else ">i")

    def name(self) -> str:
        n = self.count()
        return self.take(n + -n % 4)[:n].decode()

    def attributes(self) -> dict:
        tag, n = self.number(), self.count()
        if tag not in (0, _ATTRIBUTE):
            raise ValueError("not an attribute list")
        out = {}
        for _ in range(n):
            name, kind, count = self.name(), self.number(), self.count()
            code, width = _TYPES[kind]
            raw = self.take(count * width + -(count * width) % 4)[: count * width]
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, code)
        return out


def _header(raw: bytes, size: int) -> Header:
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF file")
    c = _Cursor(raw, raw[3])
    records = c.count()
    c.number()
    dims = [(c.name(), c.count()) for _ in range(c.count())]
    h = Header(records, dims, c.attributes())
    c.number()
    for _ in range(c.count()):
        name = c.name()
        ids = [c.count() for _ in range(c.count())]
        attributes, kind = c.attributes(), c.number()
        c.count()  # the stored size wraps for large variables; dimensions tell it
        begin = c.number(">i" if raw[3] == 1 else ">q")
        h.variables[name] = Variable(name, ids, attributes, _TYPES[kind][0], begin)
    own = [v for v in h.variables.values() if v.dims and dims[v.dims[0]][1] == 0]
    each = [int(np.prod([dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize for v in own]
    # Records of several variables are padded to 4 bytes each; those of a single one are not.
    h.record_size = each[0] if len(each) == 1 else sum(n + -n % 4 for n in each)
    if records < 0:  # a writer that streams leaves the count open
        h.records = (size - min(v.begin for v in own)) // h.record_size if own and h.record_size else 0
    return h


class Classic:
    """A classic file's variables."""

    def __init__(self, f):
        self.f = f
        size, n = f.seek(0, 2), 1 << 16
        while True:  # headers are short; long ones take a few tries
            f.seek(0)
            raw = f.read(n)
            try:
                self.header = _header(raw, size)
                return
            except EOFError:
                if n >= size:
                    raise ValueError("the file ends within its header") from None
                n *= 4

    def __contains__(self, name: str) -> bool:
        return name in self.header.variables

    def _variable(self, name: str) -> Variable:
        if name not in self.header.variables:
            raise KeyError(f"no variable {name}")
        return self.header.variables[name]

    def shape(self, name: str) -> list[int]:
        h = self.header
        return [h.dims[d][1] or h.records for d in self._variable(name).dims]

    def dims(self, name: str) -> list[str]:
        return [self.header.dims[d][0] for d in self._variable(name).dims]

    def attributes(self, name: str) -> dict:
        return self._variable(name).attributes

    def steps_together(self, name: str) -> int:
        return 1

    def read(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        """The variable's values, from `first` on along its first dimension."""
        v, shape = self._variable(name), self.shape(name)
        kind = np.dtype(v.kind)
        if not shape:
            return np.frombuffer(self._raw(v.begin, kind.itemsize), kind)[0]
        count = shape[0] - first if count is None else min(count, shape[0] - first)
        return self.cells(name, first, count, np.arange(int(np.prod(shape[1:], dtype=np.int64)))).reshape([count, *shape[1:]])

    def cells(self, name: str, first: int, count: int, flat: np.ndarray) -> np.ndarray:
        """[steps, cells] of the cells with these places (ascending) within a step."""
        v, h, kind = self._variable(name), self.header, np.dtype(self._variable(name).kind)
        each = int(np.prod(self.shape(name)[1:], dtype=np.int64)) * kind.itemsize
        if h.dims[v.dims[0]][1]:
            return ranges(self._raw, v.begin + first * each, each, count, flat, kind)
        # Records of all such variables alternate.
        parts = [ranges(self._raw, v.begin + k * h.record_size, each, 1, flat, kind) for k in range(first, first + count)]
        return np.concatenate(parts) if parts else np.zeros((0, len(flat)), kind)

    def _raw(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(n)
        if len(raw) < n:
            raise ValueError("the file ends within its values")
        return raw


def opened_cube(f) -> Classic | Hdf5:
    f.seek(0)
    return Hdf5(f) if f.read(8) == SIGNATURE else Classic(f)


_STEP = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def decode_times(values: np.ndarray, units: str) -> list[datetime.date]:
    """Dates of "<unit> since Y-M-D" numbers, rounded half to even in their unit."""
    word, _, rest = units.strip().partition(" since ")
    unit = word.strip().lower().rstrip("s")
    y, m, d = (int(x) for x in rest.split()[0].split("T")[0].split("-"))
    start = datetime.date(y, m, d)
    whole = np.rint(np.asarray(values, float)).astype(np.int64).tolist()
    if unit in ("month", "year"):
        months = [y * 12 + m - 1 + n * (12 if unit == "year" else 1) for n in whole]
        return [datetime.date(k // 12, k % 12 + 1, min(d, calendar.monthrange(k // 12, k % 12 + 1)[1])) for k in months]
    if unit not in _STEP:
        raise ValueError(f"unknown time unit in {units!r}")
    return [start + datetime.timedelta(days=n * _STEP[unit] // 86400) for n in whole]


@dataclass
class _Chunk(InputPartition):
    path: str
    first: int
    count: int
    step: int  # time_idx of the first


_LAT, _LON = ("lat", "latitude"), ("lon", "longitude")


def _coordinate(cube: Classic | Hdf5, names: tuple[str, ...]) -> str:
    return next((n for n in names if n in cube), names[0])


def _cells_of(text: str) -> list[tuple[int, int, int]]:
    """(row, first column, last column) of "row:first-last,first-last;row:..."."""
    out = []
    for row in filter(None, text.split(";")):
        y, _, spans = row.partition(":")
        out += [(int(y), *map(int, x.split("-"))) for x in spans.split(",")]
    return out


def unpacked(values: np.ndarray, attributes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles, unpacked, and which are missing: NaN, fill flags as stored, and magnitudes of fill flags."""
    gone = np.isnan(values) if values.dtype.kind == "f" else np.zeros(values.shape, bool)
    for k in ("_FillValue", "missing_value"):
        for flag in np.ravel(attributes.get(k, [])):
            gone = gone | (values == flag)
    out = values.astype(float)
    for k, f in (("scale_factor", np.multiply), ("add_offset", np.add)):
        if k in attributes:
            out = f(out, float(np.ravel(attributes[k])[0]))
    return out, gone | np.isnan(out) | (np.abs(out) >= 1e15)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, static: bool):
        self.paths = sorted(p for part in options["path"].split(",") for p in (files.expanded(part) or [part]))
        self.variable = options["variable"]
        self.chunk = int(options.get("chunk", "100"))
        self.last = int(options["steps"]) if "steps" in options else None
        self.static = static
        self.between = [datetime.date.fromisoformat(options[k]) if k in options else None for k in ("from", "to")]
        self.cells = _cells_of(options["cells"]) if "cells" in options else None
        self.keep_missing = options.get("missing", "keep") != "drop"

    def _steps(self, cube: Classic | Hdf5, n: int) -> np.ndarray:
        """Those of the file's first n steps whose dates are asked for."""
        if self.between == [None, None]:
            return np.arange(n)
        begin, end = self.between
        dates = decode_times(cube.read("time", 0, n), cube.attributes("time")["units"])
        return np.flatnonzero([(begin is None or d >= begin) and (end is None or d <= end) for d in dates])

    def partitions(self):
        out, before = [], 0
        for path in self.paths:
            if self.static:
                out.append(_Chunk(path, 0, 1, 0))
                continue
            with files.opened(path) as f:
                cube = opened_cube(f)
                n = cube.shape(self.variable)[0]
                n = min(n, self.last) if self.last is not None else n
                steps = self._steps(cube, n)
                # Stretches end where storage chunks do, so that no chunk is decoded twice.
                together = cube.steps_together(self.variable)
                length = max(together, self.chunk // together * together)
            for own in np.split(steps, np.flatnonzero(np.diff(steps // length)) + 1) if len(steps) else []:
                # Dates ascend within a file; were they not, each stretch of steps would be a chunk.
                for part in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    out.append(_Chunk(path, int(part[0]), len(part), before + int(part[0])))
            before += n
        return out

    def read(self, part):
        if part is None:  # no step is left
            return
        with files.opened(part.path) as f:
            yield from self._rows(opened_cube(f), part)

    def _rows(self, cube: Classic | Hdf5, part: _Chunk):
        lat, lon = (cube.read(_coordinate(cube, x)).astype(float) for x in (_LAT, _LON))
        names = [n for n in cube.dims(self.variable) if n != "time"]
        if not self.static and cube.dims(self.variable)[0] != "time":
            raise ValueError(f"time must be the first dimension of {self.variable}")
        by_row = names.index(_coordinate(cube, _LAT)) < names.index(_coordinate(cube, _LON))
        if self.cells is None:
            y, x = (g.ravel() for g in np.meshgrid(np.arange(len(lat)), np.arange(len(lon)), indexing="ij"))
        else:
            spans = np.array(self.cells, np.int64).reshape(-1, 3)
            width = spans[:, 2] - spans[:, 1] + 1
            y = np.repeat(spans[:, 0], width)
            x = np.repeat(spans[:, 1], width) + np.arange(len(y)) - np.repeat(np.cumsum(width) - width, width)
        flat = y * len(lon) + x if by_row else x * len(lat) + y
        order = np.argsort(flat, kind="stable")
        y, x, flat = y[order], x[order], flat[order]
        attributes = cube.attributes(self.variable)
        if self.static:
            values, gone = unpacked(cube.read(self.variable).ravel()[flat], attributes)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(values, mask=gone)], names=AREA.names)
            return
        dates = np.array(decode_times(cube.read("time", part.first, part.count), cube.attributes("time")["units"]), "datetime64[D]").astype(np.int32)
        together = cube.steps_together(self.variable)
        b = part.first
        while b < part.first + part.count:  # one storage chunk's steps at a time
            a, b = b, min(part.first + part.count, (b // together + 1) * together)
            steps = cube.cells(self.variable, a, b - a, flat)
            for k, step in enumerate(range(a, b)):
                values, gone = unpacked(steps[k], attributes)
                own = np.arange(len(flat)) if self.keep_missing else np.flatnonzero(~gone)
                n = len(own)
                arrays = [np.full(n, part.step + step - part.first, np.int32), pa.array(np.full(n, dates[step - part.first], np.int32), pa.date32()), y[own].astype(np.int32), x[own].astype(np.int32), lat[y[own]], lon[x[own]]]
                yield pa.RecordBatch.from_arrays([*(v if isinstance(v, pa.Array) else pa.array(v) for v in arrays), pa.array(values[own], mask=gone[own])], names=GRID.names)


def spans_of(mapped: DataFrame) -> str:
    """The cells of a map (lat_idx, lon_idx) as the option `cells`; as long as the grid has rows and basins have edges there."""
    cells = mapped.select("lat_idx", "lon_idx").distinct()
    island = F.col("lon_idx") - F.row_number().over(Window.partitionBy("lat_idx").orderBy("lon_idx"))
    spans = cells.withColumn("_i", island).groupBy("lat_idx", "_i").agg(F.min("lon_idx").alias("a"), F.max("lon_idx").alias("b"))
    span = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    rows = spans.groupBy("lat_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", span.alias("s")))), lambda z: z["s"]), ",").alias("s"))
    return ";".join(f"{r['lat_idx']}:{r['s']}" for r in rows.orderBy("lat_idx").collect())  # one row a row of the grid


class NetCdfSource(DataSource):
    """Cubes [time, lat, lon]; options: variable, chunk (time steps a partition, 100), steps (the first n of each file only),
    from and to (ISO dates, inclusive), cells (spans of rows, see `spans_of`), missing ("drop": cells without a value are no rows).

    Several files are one time axis in the order of their names: time_idx goes on from file to file.
    """

    @classmethod
    def name(cls):
        return "netcdf"

    def schema(self):
        return GRID

    def reader(self, schema):
        return _Reader(dict(self.options), False)


#: A sweep's rows: the run's number, a cell's step and value; and a row a chunk, without a cell, that says why it failed or that it didn't.
RUN_GRID = StructType().add("run", "integer").add("date", "date").add("lat_idx", "integer").add("lon_idx", "integer").add("value", "double").add("error", "string")


@dataclass
class _RunChunk(InputPartition):
    run: int
    chunk: _Chunk | None
    error: str = ""


class _RunsReader(DataSourceReader):
    """Files of several runs; what goes wrong in one is a row of that run and no error of the job."""

    def __init__(self, options: dict):
        self.options = options
        self.runs = json.loads(options["runs"])

    def _reader(self, run: dict) -> _Reader:
        return _Reader({k: v for k, v in self.options.items() if k in ("chunk", "cells", "missing")} | {"path": ",".join(run["paths"]), "variable": run["variable"]}, False)

    def partitions(self):
        def own(numbered):
            n, run = numbered
            try:
                return [_RunChunk(n, c) for c in self._reader(run).partitions()]
            except Exception as e:  # noqa: BLE001  the run's row says it
                return [_RunChunk(n, None, f"{type(e).__name__}: {e}")]

        with ThreadPoolExecutor(16) as pool:  # headers alone
            return [c for chunks in pool.map(own, enumerate(self.runs)) for c in chunks]

    def read(self, part):
        if part is None:
            return
        error = part.error or None
        if part.chunk is not None:
            try:
                with files.opened(part.chunk.path) as f:
                    cube = opened_cube(f)
                    self._same_grid(cube)
                    for b in self._reader(self.runs[part.run])._rows(cube, part.chunk):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part.run, np.int32)), *(b.column(c) for c in ("date", "lat_idx", "lon_idx", "value")), pa.nulls(b.num_rows, pa.string())], names=RUN_GRID.names)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        # A row without a cell says how the chunk went.
        yield pa.RecordBatch.from_arrays([pa.array([part.run], pa.int32()), *(pa.nulls(1, t) for t in (pa.date32(), pa.int32(), pa.int32(), pa.float64())), pa.array([error and error[:500]], pa.string())], names=RUN_GRID.names)

    def _same_grid(self, cube: Classic | Hdf5) -> None:
        if self.options.get("grid") not in (None, grid_digest(cube)):
            raise ValueError("the grid is another one than the cell map's")


def grid_digest(cube: Classic | Hdf5) -> str:
    """Of the coordinates, to about a ten-thousandth of a degree: cubes of one grid have the same."""
    h = hashlib.sha256()
    for names in (_LAT, _LON):
        h.update(np.round(cube.read(_coordinate(cube, names)).astype(float) * 1e4).astype(np.int64).tobytes() + b"|")
    return h.hexdigest()


class NetCdfRunsSource(DataSource):
    """Cubes of many runs as one table; options: runs (JSON list of variable and paths), chunk, cells, missing, grid (see `grid_digest`)."""

    @classmethod
    def name(cls):
        return "netcdf_runs"

    def schema(self):
        return RUN_GRID

    def reader(self, schema):
        return _RunsReader(dict(self.options))


def read_runs(spark: SparkSession, runs: list[dict], mapped: DataFrame | None = None, grid: str | None = None, chunk: int = 100, drop_missing: bool = False) -> DataFrame:
    """RUN_GRID of all runs (each a dict of variable and paths); `run` is the place in the list."""
    spark.dataSource.register(NetCdfRunsSource)
    reader = spark.read.format("netcdf_runs").option("runs", json.dumps(runs)).option("chunk", chunk)
    reader = reader.option("cells", spans_of(mapped)) if mapped is not None else reader
    reader = reader.option("missing", "drop") if drop_missing else reader
    return (reader.option("grid", grid) if grid else reader).load()


class NetCdfAreaSource(DataSource):
    """A field without time, as lat_idx, lon_idx, area_m2."""

    @classmethod
    def name(cls):
        return "netcdf_area"

    def schema(self):
        return AREA

    def reader(self, schema):
        return _Reader({"variable": "land area"} | dict(self.options), True)


def read_cube(
    spark: SparkSession, paths: list[str] | str, variable: str, chunk: int = 100, steps: int | None = None,
    dates: tuple[datetime.date | None, datetime.date | None] = (None, None), mapped: DataFrame | None = None, drop_missing: bool = False,
) -> DataFrame:
    """One or more files, read as one grid; of it only the steps between the dates (inclusive; None: open) and, with a map, its cells.

    drop_missing leaves out cells without a value; whoever counts them as zero must not.
    """
    spark.dataSource.register(NetCdfSource)
    reader = spark.read.format("netcdf").option("variable", variable).option("chunk", chunk)
    reader = reader.option("steps", steps) if steps is not None else reader
    reader = reader.option("cells", spans_of(mapped)) if mapped is not None else reader
    reader = reader.option("missing", "drop") if drop_missing else reader
    for name, date in zip(("from", "to"), dates):
        reader = reader.option(name, date.isoformat()) if date is not None else reader
    return reader.load(paths if isinstance(paths, str) else ",".join(paths))


def read_cells(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """lat_idx, lon_idx, lat, lon of a file's grid, from its first time step alone."""
    return read_cube(spark, path, variable, steps=1).select("lat_idx", "lon_idx", "lat", "lon")


def read_area(spark: SparkSession, path: str, variable: str = "land area", strict: bool = True) -> DataFrame | None:
    """The area field; without the file an error, or None if not strict."""
    if not path or not files.exists(path):
        if strict:
            raise FileNotFoundError(path)
        return None
    spark.dataSource.register(NetCdfAreaSource)
    return spark.read.format("netcdf_area").option("variable", variable).load(path)


def write_cube(path: str, variable: str, values: np.ndarray, lat: np.ndarray, lon: np.ndarray, times: np.ndarray | None = None, units: str = "days since 1850-1-1") -> None:
    """A small classic file, for tests: values [time, lat, lon], or [lat, lon] without times."""
    sizes = ([("time", len(times))] if times is not None else []) + [("lat", len(lat)), ("lon", len(lon))]
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    place = {n: k for k, (n, _) in enumerate(sizes)}
    arrays = {n: (np.asarray(a, ">f8"), [place[n]], "") for n, a in (("time", times), ("lat", lat), ("lon", lon)) if a is not None}
    if times is not None:
        arrays["time"] = (arrays["time"][0], arrays["time"][1], units)
    arrays[variable] = (np.asarray(values, ">f8"), list(range(len(sizes))), "")

    def head(begin: dict[str, int]) -> bytes:
        out = b"CDF\x01" + struct.pack(">iii", 0, _DIMENSION, len(sizes))
        out += b"".join(text(n) + struct.pack(">i", k) for n, k in sizes) + struct.pack(">iiii", 0, 0, _VARIABLE, len(arrays))
        for n, (a, dims, unit) in arrays.items():
            out += text(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims)
            out += struct.pack(">ii", _ATTRIBUTE, 1) + text("units") + struct.pack(">ii", 2, len(unit)) + unit.encode() + b"\0" * (-len(unit) % 4) if unit else struct.pack(">ii", 0, 0)
            out += struct.pack(">iii", 6, a.nbytes, begin.get(n, 0))
        return out

    at, begin = len(head({})), {}
    for n, (a, _, _) in arrays.items():
        begin[n] = at
        at += a.nbytes
    with open(path, "wb") as f:
        f.write(head(begin))
        for a, _, _ in arrays.values():
            f.write(a.tobytes())
