"""Cubes: both formats, packed values, odd classic files, and how much of a file is read."""

import datetime as dt
import struct

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tarnflow.operators.zonal import zonal
from tarnflow.sources import files
from tarnflow.sources.discovery import find_cubes, glob_cubes
from tarnflow.sources.hdf5 import Hdf5
from tarnflow.sources.netcdf import Classic, _Reader, opened_cube, read_area, read_cells, read_cube, spans_of, write_cube
from tarnflow.sources.shapefile import read_basins, write_basins

from .hdf5_files import write_cube4
from .test_sources import square

LAT, LON = 10 - np.arange(11) * 0.5, np.arange(9) * 0.5
STEPS = 23
VALUES = np.random.default_rng(1).normal(size=(STEPS, 11, 9))
VALUES[3, 2, 2], VALUES[4] = 1e20, np.where(VALUES[4] > 1, np.nan, VALUES[4])
UNITS = "months since 2001-1-31"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("chunk,filters,index", [(None, (), "tree"), ((5, 4, 9), (2, 1), "tree"), ((1, 11, 9), (1, 3), "tree"), ((23, 3, 3), (), "tree"), ((5, 6, 9), (2, 1), "fixed"), ((23, 11, 9), (1,), "single"), ((4, 11, 5), (), "implicit")])
def test_both_formats_give_equal_rows(spark, tmp_path, new, chunk, filters, index):
    classic, later = str(tmp_path / "a.nc"), str(tmp_path / "b.nc")
    write_cube(classic, "qtot", VALUES, LAT, LON, np.arange(STEPS), UNITS)
    many = {f"note_{k}": "x" * (20 * k) for k in range(40 if chunk == (5, 4, 9) else 9)}
    write_cube4(later, "qtot", VALUES, LAT, LON, np.arange(STEPS), UNITS, new, chunk, filters, many | {"_FillValue": np.array([1e20])}, index=index)
    want = read_cube(spark, classic, "qtot", chunk=10)
    got = read_cube(spark, later, "qtot", chunk=10)
    assert rows(got) == rows(want) and want.count() == STEPS * 99
    span = (dt.date(2001, 6, 1), dt.date(2001, 12, 1))
    assert rows(read_cube(spark, later, "qtot", chunk=3, dates=span)) == rows(read_cube(spark, classic, "qtot", chunk=3, dates=span))
    mapped = spark.createDataFrame([(1, y, x) for y in (2, 3, 9) for x in (0, 2, 3, 8)], "BASIN_ID int, lat_idx int, lon_idx int")
    for drop in (False, True):
        assert rows(read_cube(spark, later, "qtot", mapped=mapped, drop_missing=drop)) == rows(read_cube(spark, classic, "qtot", mapped=mapped, drop_missing=drop))
    with open(later, "rb") as f:
        attributes = Hdf5(f).attributes("qtot")
        assert {k: attributes[k] for k in many} == many


def test_partitions_follow_storage_chunks(spark, tmp_path):
    path = str(tmp_path / "b.nc")
    write_cube4(path, "qtot", VALUES, LAT, LON, np.arange(STEPS), UNITS, True, (5, 11, 9))
    assert read_cube(spark, path, "qtot", chunk=12).rdd.getNumPartitions() == 3  # of ten steps
    assert read_cube(spark, path, "qtot", chunk=2).rdd.getNumPartitions() == 5  # never less than a chunk's


def test_unwritten_chunks_are_fill(tmp_path):
    path = str(tmp_path / "b.nc")
    for new in (False, True):
        write_cube4(path, "q", VALUES, LAT, LON, np.arange(STEPS), UNITS, new, (5, 4, 9), fill=7.0, skip=lambda o: o[0] == 5 or o[1] == 8)
        with open(path, "rb") as f:
            got = Hdf5(f).read("q")
        want = VALUES.copy()
        want[5:10] = want[:, 8:] = 7.0
        assert np.array_equal(got, want, equal_nan=True)


class Counted:
    """A file that counts the bytes read."""

    read_bytes = 0

    def __init__(self, path):
        self.f = open(path, "rb")  # noqa: SIM115

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def seek(self, *a):
        return self.f.seek(*a)

    def read(self, n):
        raw = self.f.read(n)
        Counted.read_bytes += len(raw)
        return raw


@pytest.mark.parametrize("form", ["classic", "chunks"])
def test_bytes_and_rows_are_bounded_by_what_is_asked(tmp_path, monkeypatch, form):
    path = str(tmp_path / "wide.nc")
    lat, lon = np.arange(60.0), np.arange(1500.0)
    values = np.random.default_rng(2).normal(size=(24, 60, 1500))
    if form == "classic":
        write_cube(path, "q", values, lat, lon, np.arange(24))
    else:
        write_cube4(path, "q", values, lat, lon, np.arange(24), chunk=(6, 20, 100), filters=(1,))
    monkeypatch.setattr(files, "opened", Counted)
    whole, step, part = 24 * 60 * 1500 * 8, 60 * 1500 * 8, 6 * 20 * 100 * 8

    def read(**options):
        Counted.read_bytes = 0
        r = _Reader({"path": path, "variable": "q", "chunk": "6"} | options, False)
        out = [b for p in r.partitions() for b in (r.read(p) if p is not None else ())]
        return sum(b.num_rows for b in out), Counted.read_bytes, out

    about = 12 * 1024 * (6 if form == "chunks" else 1) + 300_000 * (form == "classic")  # headers, coordinates, indexes: once a partition
    n, size, _ = read()
    assert n == 24 * 60 * 1500 and size > 0.8 * whole
    n, size, _ = read(**{"from": "1850-01-08", "to": "1850-01-09"})  # steps 7 and 8
    assert n == 2 * 60 * 1500 and size < (2 if form == "classic" else 6) * step + about
    n, size, out = read(cells="5:100-149;6:90-120,700-710")
    assert n == 24 * (50 + 31 + 11)
    assert size < (24 * (3 * 4096 + 92 * 8) if form == "classic" else 4 * 4 * part) + 3 * about
    got = {(t, y, x): v for b in out for t, y, x, v in zip(*(b.column(c).to_pylist() for c in ("time_idx", "lat_idx", "lon_idx", "value")))}
    assert all(v == values[k] for k, v in got.items())


def test_zonal_sums_from_the_cells_of_basins_alone(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    write_cube4(path, "qtot", VALUES, LAT, LON, np.arange(STEPS), UNITS, True, (5, 4, 9))
    mapped = spark.createDataFrame([(b, y, x) for b, y, x in ((1, 2, 2), (1, 2, 3), (1, 4, 1), (2, 10, 8), (2, 2, 3))], "BASIN_ID int, lat_idx int, lon_idx int")
    assert spans_of(mapped) == "2:2-3;4:1-1;10:8-8"
    want = rows(zonal(read_cube(spark, path, "qtot"), mapped, "sum").select("BASIN_ID", "date", F.round("value", 9)))
    pruned = read_cube(spark, path, "qtot", mapped=mapped, drop_missing=True)
    assert pruned.count() <= STEPS * 4 and rows(zonal(pruned, mapped, "sum").select("BASIN_ID", "date", F.round("value", 9))) == want
    none = mapped.where("BASIN_ID = 3")
    assert read_cube(spark, path, "qtot", mapped=none).count() == 0


@pytest.mark.parametrize("form", ["old", "new"])
def test_packed_values_are_unpacked(spark, tmp_path, form):
    path = str(tmp_path / "p.nc")
    stored = np.arange(-50, 49).reshape(1, 11, 9)
    about = {"scale_factor": np.array([0.5]), "add_offset": np.array([10.0]), "_FillValue": np.array([-50], "<i2")}
    write_cube4(path, "q", stored, LAT, LON, np.arange(1), UNITS, form == "new", (1, 11, 9), attributes=about, dtype="<i2")
    got = {(r["lat_idx"], r["lon_idx"]): r["value"] for r in read_cube(spark, path, "q").collect()}
    assert got[0, 0] is None and got[0, 1] == -49 * 0.5 + 10 and got[10, 8] == 48 * 0.5 + 10


def classic_file(path, records, variables, version=1, streaming=False):
    """A file of record variables: (name, type code, numbers); values are bytes, shorts or doubles of one record each."""
    wide = version == 5
    count = lambda n: struct.pack(">q" if wide else ">i", n)
    text = lambda s: count(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    kinds = {"b": (1, ">i1"), "h": (3, ">i2"), "d": (6, ">f8")}
    offset = lambda n: struct.pack(">i" if version == 1 else ">q", n)

    def head(begin):
        out = b"CDF" + bytes([version]) + (b"\xff" * (8 if wide else 4) if streaming else count(records)) + struct.pack(">i", 10) + count(2) + text("time") + count(0) + text("x") + count(3)
        out += struct.pack(">i", 0) + count(0) + struct.pack(">i", 11) + count(len(variables))
        for k, (name, code, _) in enumerate(variables):
            out += text(name) + count(2) + count(0) + count(1) + struct.pack(">i", 0) + count(0) + struct.pack(">i", kinds[code][0]) + count(3 * np.dtype(kinds[code][1]).itemsize) + offset(begin[k])
        return out

    size = [3 * np.dtype(kinds[c][1]).itemsize for _, c, _ in variables]
    size = size if len(size) == 1 else [n + -n % 4 for n in size]
    at = len(head([0] * len(variables)))
    begin = [at + sum(size[:k]) for k in range(len(variables))]
    body = b"".join(np.asarray(v[r], kinds[c][1]).tobytes().ljust(n, b"\0") for r in range(records) for (_, c, v), n in zip(variables, size))
    with open(path, "wb") as f:
        f.write(head(begin) + body)


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("streaming", [False, True])
@pytest.mark.parametrize("codes", ["b", "h", "bh", "hd", "dbb"])
def test_records_padding_and_open_counts(tmp_path, version, streaming, codes):
    """A single record variable of short values is not padded; several are; a streaming writer's count comes from the size."""
    path = str(tmp_path / "r.nc")
    values = [np.arange(k, k + 15).reshape(5, 3) for k in range(len(codes))]
    classic_file(path, 5, [(f"v{k}", c, v) for k, (c, v) in enumerate(zip(codes, values))], version, streaming)
    with open(path, "rb") as f:
        cube = Classic(f)
        for k, v in enumerate(values):
            assert cube.shape(f"v{k}") == [5, 3] and cube.read(f"v{k}").tolist() == v.tolist() and cube.read(f"v{k}", 3, 9).tolist() == v[3:].tolist()
            assert cube.cells(f"v{k}", 1, 2, np.array([0, 2])).tolist() == v[1:3, [0, 2]].tolist()


def test_files_by_uri(spark, tmp_path, monkeypatch):
    """The same over file:// and over a second file system."""
    folder = tmp_path / "CWatM" / "ssp126" / "GFDL-ESM4"
    folder.mkdir(parents=True)
    write_cube(str(folder / "x_qtot_monthly.nc"), "qtot", VALUES, LAT, LON, np.arange(STEPS), UNITS)
    write_cube(str(tmp_path / "area.nc"), "land area", np.ones((11, 9)), LAT, LON)
    write_basins(tmp_path / "b.shp", [square(1, 0, 0), square(2, 50, 50)])
    base = f"file://{tmp_path}"
    found = find_cubes(base, "CWatM", "gfdl-esm4", "ssp126", "future", "qtot", "monthly")
    assert found == [f"file://{folder}/x_qtot_monthly.nc"] and glob_cubes(f"file://{folder}", "x", "", "qtot") == found
    assert rows(read_cube(spark, found, "qtot")) == rows(read_cube(spark, str(folder / "x_qtot_monthly.nc"), "qtot"))
    assert rows(read_cube(spark, f"file://{folder}/*.nc", "qtot")) == rows(read_cube(spark, found, "qtot"))
    assert read_area(spark, f"{base}/area.nc").count() == 99 and read_area(spark, f"{base}/none.nc", strict=False) is None
    assert read_basins(spark, f"{base}/b.shp").count() == 2 and read_cells(spark, found[0], "qtot").count() == 99
    made = pyarrow.fs._MockFileSystem()
    made.create_dir("top/ssp126")
    for name in ("a_qtot_monthly.nc", "notes.txt"):
        with made.open_output_stream(f"top/ssp126/{name}") as f:
            f.write((folder / "x_qtot_monthly.nc").read_bytes())
    monkeypatch.setitem(files._MADE, "mem", lambda uri: (made, uri.removeprefix("mem://")))
    assert glob_cubes("mem://top/ssp126", "a", "", "qtot") == ["mem://top/ssp126/a_qtot_monthly.nc"]
    assert files.exists("mem://top/ssp126/notes.txt") and not files.exists("mem://top/nothing") and files.listed("mem://top/nothing") == []
    reader = _Reader({"path": "mem://top/ssp126/*.nc", "variable": "qtot"}, False)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == STEPS * 99


def test_broken_files_say_so(tmp_path):
    for raw in (b"", b"CDF", b"CDF\x07" + bytes(40), b"\x89HDF\r\n\x1a\n" + bytes([9]) + bytes(120), b"\x89HDF\r\n\x1a\n"):
        (tmp_path / "x.nc").write_bytes(raw)
        with pytest.raises((ValueError, IndexError)), open(tmp_path / "x.nc", "rb") as f:
            opened_cube(f)


def made_runs(tmp_path):
    """Four runs of two variables: both formats, a broken file, another grid; and jobs for these and a missing one."""
    from tarnflow.plans.config import RunConfig

    write_cube(str(tmp_path / "area.nc"), "land area", np.arange(99.0).reshape(11, 9) * 1e6, LAT, LON)
    write_basins(tmp_path / "b.shp", [square(1, 0, 5, 2.0), square(2, 1, 6, 3.0), square(3, 70, 70)])
    jobs = []
    for hydro, variable in (("H08", "qtot"), ("CWatM", "qtot"), ("CWatM", "dis"), ("broken", "qtot"), ("other", "qtot"), ("none", "qtot")):
        folder = tmp_path / hydro / "ssp126" / "GFDL-ESM4"
        folder.mkdir(parents=True, exist_ok=True)
        path = str(folder / f"x_{variable}_monthly.nc")
        if hydro == "H08":
            write_cube(path, variable, VALUES, LAT, LON, np.arange(STEPS), UNITS)
        elif hydro == "CWatM":
            write_cube4(path, variable, VALUES * 2, LAT, LON, np.arange(STEPS), UNITS, True, (5, 4, 9))
        elif hydro == "broken":
            write_cube4(path, variable, VALUES, LAT, LON, np.arange(STEPS), UNITS, False, (5, 11, 9), (1,))
            raw = bytearray((folder / f"x_{variable}_monthly.nc").read_bytes())
            raw[9000:9400] = b"\xff" * 400  # a damaged chunk
            (folder / f"x_{variable}_monthly.nc").write_bytes(raw)
        elif hydro == "other":
            write_cube(path, variable, VALUES, LAT + 0.25, LON, np.arange(STEPS), UNITS)
        jobs.append(RunConfig(variable=variable, hydro_model=hydro, climate_model="gfdl-esm4", scenario="ssp126", data_period="future", input_dir=str(tmp_path), area_file=str(tmp_path / "area.nc"), basin_shapefile=str(tmp_path / "b.shp"), output_dir=str(tmp_path / "out")))
    return jobs


def test_a_sweep_is_one_plan_and_a_bad_run_fails_alone(spark, tmp_path):
    from dataclasses import replace

    from tarnflow.plans.jobs import run_sweep
    from tarnflow.plans.pipelines import process_run
    from tarnflow.sources import wide_csv

    jobs = made_runs(tmp_path)
    status = run_sweep(spark, jobs)
    assert [r["status"] for r in status] == ["success", "success", "success", "failed", "failed", "failed"]
    assert "grid" in status[4]["error"] and "file" in status[5]["error"] and status[3]["error"]
    panel = spark.read.parquet(f"{jobs[0].output_dir}/panel")
    got = {(r["variable"], r["hydro_model"], r["BASIN_ID"], r["date"]): r["value"] for r in panel.collect()}
    want = {}
    for job in jobs[:3]:
        job = replace(job, output_dir=str(tmp_path / "single"), spatial_method="max" if job.variable == "dis" else "sum")
        for r in spark.read.parquet(process_run(spark, job)[0]).where("date IS NOT NULL").collect():
            want[job.variable, job.hydro_model, r["BASIN_ID"], r["date"]] = r[job.variable]
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()} and len(got) == 3 * 2 * STEPS
    wide = wide_csv.read_runs(spark, f"{jobs[0].output_dir}/wide/qtot_monthly", "qtot")
    assert wide.count() == 2 * 2 * STEPS and {r[0] for r in wide.select("hydro_model").distinct().collect()} == {"H08", "CWatM"}
    assert {r["BCU_name"] for r in wide.collect()} == {"bcu, 1", "bcu, 2"}
    assert [r["status"] for r in run_sweep(spark, jobs[5:])] == ["failed"]


def test_annual_and_outlet_commands(spark, tmp_path):
    import json

    from tarnflow.plans import cli

    job = made_runs(tmp_path)[0]
    argv = ["--input-dir", str(tmp_path / "H08" / "ssp126" / "GFDL-ESM4"), "--area-file", job.area_file, "--basin-shapefile", job.basin_shapefile, "--output-dir", str(tmp_path / "o"), "--test-file", str(tmp_path / "H08" / "ssp126" / "GFDL-ESM4" / "x_qtot_monthly.nc"), "--scenario", "ssp126", "--region", "R12"]
    means = {}
    for more in ([], ["--skip-missing"]):
        assert cli.main(["annual", *argv, "--method", "mean", *more], spark) == 0
        rows = spark.read.option("header", True).csv(str(tmp_path / "o" / "qtot_ssp126_mean.csv")).collect()
        assert list(rows[0].asDict()) == ["BASIN_ID", "BCU_name", "2001", "2002", "Model", "Scenario", "Variable", "Region", "Unit"]
        assert len(rows) == 3 and {r["Unit"] for r in rows} == {"km3/year"}
        means[bool(more)] = {r["BASIN_ID"]: float(r["2001"]) for r in rows}
    # Basin 1 has cells with lat from 5 to 7 and lon from 0 to 2, upper edges outside.
    y, x = [k for k, v in enumerate(LAT) if 5 <= v < 7], [k for k, v in enumerate(LON) if 0 <= v < 2]
    v = np.where(np.abs(VALUES[:12]) > 1e15, np.nan, VALUES[:12])[:, y][:, :, x] * (np.arange(99.0).reshape(11, 9)[y][:, x] * 1e6) * 365.25 * 86400 * 1e-12
    assert means[False]["1"] == pytest.approx(np.nan_to_num(v).mean(axis=0).mean()) and means[True]["1"] == pytest.approx(np.nanmean(v, axis=0).mean())
    assert means[False]["3"] == 0.0
    assert cli.main(["outlets", *argv, "--every", "2"], spark) == 0
    found = [json.loads(line) for p in (tmp_path / "o" / "outlets" / "basins.json").glob("part-*") for line in p.read_text().splitlines()]
    assert {r["BASIN_ID"]: r["status"] for r in found} == {1: "moving", 2: "moving", 3: "empty"}
    summary = [json.loads(line) for p in (tmp_path / "o" / "outlets" / "summary.json").glob("part-*") for line in p.read_text().splitlines()]
    assert summary[0]["total_basins"] == 3 and summary[0]["moving_basins"] == 2
