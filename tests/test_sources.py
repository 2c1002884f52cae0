"""Readers, writers, whole pipelines and the streaming form."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators.monthly import monthly
from tarnflow.plans import cli
from tarnflow.plans.config import RunConfig
from tarnflow.plans.pipelines import process_run, rolling_panel, variance_analysis
from tarnflow.schema import METADATA
from tarnflow.sources import sinks
from tarnflow.sources.discovery import available_models, find_cubes, glob_cubes, run_directory, run_files
from tarnflow.sources.netcdf import decode_times, read_area, read_cells, read_cube, write_cube
from tarnflow.sources.shapefile import read_attributes, read_basins, write_basins
from tarnflow.sources.wide_csv import load_runs, read_long, read_panel, read_wide
from tarnflow.streaming.monthly import finish_months, monthly_stream

LAT, LON = np.array([0.75, 0.25, -0.25, -0.75]), np.array([0.25, 0.75, 1.25])


def square(i, x, y, size=1.0, **more):
    return {"BASIN_ID": i, "BCU_name": f"bcu, {i}", "NAME": f"name {i}", "REGION": "AFR", "area_km2": 10.5, "rings": [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]} | more


def test_cube_round_trip_in_chunks(spark, tmp_path):
    values = np.arange(5 * 4 * 3, dtype=float).reshape(5, 4, 3)
    values[0, 0, 0], values[1, 1, 1] = 1e20, np.nan
    write_cube(str(tmp_path / "a.nc"), "qtot", values, LAT, LON, np.arange(5), "months since 2015-1-31")
    df = read_cube(spark, str(tmp_path / "a.nc"), "qtot", chunk=2)
    assert df.rdd.getNumPartitions() == 3
    rows = {(r["time_idx"], r["lat_idx"], r["lon_idx"]): r for r in df.collect()}
    assert len(rows) == 60 and rows[0, 0, 0]["value"] is None and rows[1, 1, 1]["value"] is None
    assert rows[4, 3, 2]["value"] == 59.0 and rows[1, 2, 0]["date"] == dt.date(2015, 2, 28) and rows[1, 2, 0]["lat"] == -0.25
    assert read_cube(spark, str(tmp_path / "a.nc"), "qtot", steps=2).count() == 24
    write_cube(str(tmp_path / "b.nc"), "qtot", values[:1], LAT, LON, np.arange(1))
    # Two files are one time axis: the second file's only step comes after the first file's five.
    both = read_cube(spark, [str(tmp_path / "a.nc"), str(tmp_path / "b.nc")], "qtot", chunk=2)
    steps = {r["time_idx"]: (r["n"], r["date"]) for r in both.groupBy("time_idx").agg(F.count("*").alias("n"), F.min("date").alias("date")).collect()}
    assert sorted(steps) == list(range(6)) and all(n == 12 for n, _ in steps.values()) and steps[5][1] == dt.date(1850, 1, 1)
    cells = read_cells(spark, str(tmp_path / "a.nc"), "qtot")
    assert cells.count() == 12 and sorted(map(tuple, cells.collect())) == sorted(map(tuple, both.select(*cells.columns).distinct().collect()))
    (tmp_path / "c.nc").write_bytes(b"neither format")
    with pytest.raises(Exception, match="NetCDF"):
        read_cube(spark, str(tmp_path / "c.nc"), "qtot").count()


def test_only_the_dates_asked_for_are_read(spark, tmp_path):
    values = np.arange(7 * 4 * 3, dtype=float).reshape(7, 4, 3)
    paths = [str(tmp_path / f"{n}.nc") for n in "ab"]
    write_cube(paths[0], "qtot", values, LAT, LON, np.arange(7), "months since 2015-1-1")
    write_cube(paths[1], "qtot", values + 100, LAT, LON, np.arange(7, 14), "months since 2015-1-1")
    whole = read_cube(spark, paths, "qtot", chunk=3)
    everything = sorted(map(tuple, whole.collect()))
    assert whole.rdd.getNumPartitions() == 6 and len(everything) == 14 * 12
    day = lambda m: dt.date(2015, m, 1)
    # Chunks: months 1-3, 4-6, 7 of the first file, 8-10, 11-13, 14 of the second.
    for begin, end, chunks in ((day(9), None, 3), (day(2), day(3), 1), (None, day(4), 2), (day(7), day(8), 2), (dt.date(2030, 1, 1), None, None)):
        kept = read_cube(spark, paths, "qtot", chunk=3, dates=(begin, end))
        assert chunks is None or kept.rdd.getNumPartitions() == chunks
        assert sorted(map(tuple, kept.collect())) == [r for r in everything if (begin is None or r[1] >= begin) and (end is None or r[1] <= end)]
    # One frame under several filters, one after the other.
    for k in (8, 3):
        assert whole.where(F.col("time_idx") == k).count() == 12
    assert whole.where((F.col("time_idx") == 1) | (F.col("lon_idx") == 2)).count() == 12 + 13 * 4


def test_times_match_the_column_form():
    assert decode_times(np.array([0.5, 1.5]), "days since 2000-2-28") == [dt.date(2000, 2, 28), dt.date(2000, 3, 1)]
    assert decode_times(np.array([12, 13]), "months since 1999-12-31") == [dt.date(2000, 12, 31), dt.date(2001, 1, 31)]
    assert decode_times(np.array([-1]), "hours since 2000-1-1 00:00") == [dt.date(1999, 12, 31)]


def test_shapefile_round_trip(spark, tmp_path):
    ring = square(2, 0, 0)
    ring["rings"].append([(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)])
    write_basins(tmp_path / "b.shp", [square(1, 5, 5), ring])
    rows = read_basins(spark, str(tmp_path / "b.shp")).orderBy("position").collect()
    assert [r["BASIN_ID"] for r in rows] == [1, 2] and len(rows[1]["rings"]) == 2 and rows[0]["BCU_name"] == "bcu, 1" and rows[0]["area_km2"] == 10.5
    assert read_basins(spark, str(tmp_path / "b.shp"), 1).count() == 1
    raw = (tmp_path / "b.dbf").read_bytes().replace(b"REGION", b"REGIOX")
    (tmp_path / "b.dbf").write_bytes(raw)
    assert "REGIOX" in read_attributes(tmp_path / "b.dbf")[0]
    with pytest.raises(ValueError, match="REGION"):
        read_basins(spark, str(tmp_path / "b.shp"))


def test_discovery(spark, tmp_path):
    folder = Path(run_directory(str(tmp_path), "CWatM", "gfdl-esm4", "ssp126", "future"))
    assert folder.parts[-2:] == ("ssp126", "GFDL-ESM4")
    folder.mkdir(parents=True)
    for n in ("x_qtot_monthly.nc", "x_dis_monthly.nc", "x_qtot_daily.nc"):
        (folder / n).touch()
    args = (str(tmp_path), "CWatM", "gfdl-esm4", "ssp126", "future")
    assert [p.rsplit("/", 1)[1] for p in find_cubes(*args, "qtot", "monthly")] == ["x_qtot_monthly.nc"]
    with pytest.raises(FileNotFoundError):
        find_cubes(*args, "qr", "monthly")
    assert glob_cubes(str(folder), "X", "", "dis") == [str(folder / "x_dis_monthly.nc")] and glob_cubes(str(folder), "y", "", "dis") == []
    for n in ("qtot_monthly_H08_gfdl-esm4_ssp126_future.csv", "qtot_monthly_CWatM_mri-esm2-0_ssp126_future.csv", "notes.csv"):
        (tmp_path / n).write_text("a\n")
    found = available_models(run_files(spark, str(tmp_path)), "qtot", "monthly").collect()[0]
    assert (found["hydro_models"], found["climate_models"]) == (["CWatM", "H08"], ["gfdl-esm4", "mri-esm2-0"])


@pytest.mark.parametrize("n", [3, 2500])
def test_wide_files_of_few_and_of_many_dates(spark, tmp_path, n):
    dates = [str(dt.date(2000, 1, 1) + dt.timedelta(days=k)) for k in range(n)]
    lines = ["BASIN_ID,BCU_name,NAME,REGION,area_km2," + ",".join(dates)]
    lines.append('1.0,"a, b",nile,AFR,2.5,' + ",".join(str(float(k)) for k in range(n)))
    lines.append("2.0,c,po,EUR,3.5," + ",".join("" if k == 1 else str(k + 0.5) for k in range(n)))
    for h in ("H08", "CWatM"):
        (tmp_path / f"qtot_daily_{h}_gfdl-esm4_ssp126_future.csv").write_text("\n".join(lines) + "\n")
    long = read_long(spark, str(tmp_path / "qtot_daily_H08_gfdl-esm4_ssp126_future.csv"), "qtot")
    rows = {(r["BASIN_ID"], str(r["date"])): r for r in long.collect()}
    assert len(rows) == 2 * n - 1 and (2, dates[1]) not in rows
    assert rows[1, dates[2]]["qtot"] == 2.0 and rows[1, dates[0]]["BCU_name"] == "a, b" and rows[2, dates[-1]]["year"] == int(dates[-1][:4])
    panel = load_runs(spark, str(tmp_path), "qtot", "daily", ["H08", "CWatM", "JULES-W2"], ["gfdl-esm4"], ["ssp126"], "future")
    assert panel.count() == 2 * (2 * n - 1) and {r[0] for r in panel.select("hydro_model").distinct().collect()} == {"H08", "CWatM"}
    with pytest.raises(FileNotFoundError):
        load_runs(spark, str(tmp_path), "dis", "daily", ["H08"], ["gfdl-esm4"], ["ssp126"], "future")


def test_grid_to_files_end_to_end(spark, tmp_path):
    values = np.ones((2, 4, 3)) * np.array([1.0, 2.0])[:, None, None]
    write_cube(str(tmp_path / "run.nc"), "qtot", values, LAT, LON, np.arange(2), "months since 2015-1-1")
    write_cube(str(tmp_path / "area.nc"), "land area", np.full((4, 3), 1e6), LAT, LON)
    write_basins(tmp_path / "b.shp", [square(1, 0, 0), square(2, 50, 50)])
    config = RunConfig(test_file=str(tmp_path / "run.nc"), area_file=str(tmp_path / "area.nc"), basin_shapefile=str(tmp_path / "b.shp"), output_dir=str(tmp_path / "out"), scenario="ssp126", data_period="future")
    long, wide = process_run(spark, config)
    rows = {(r["BASIN_ID"], str(r["date"])): r["qtot"] for r in spark.read.parquet(long).collect()}
    factor = 365.25 * 86400 * 1e-12 * 1e6
    assert rows[1, "2015-01-01"] == pytest.approx(4 * factor) and rows[1, "2015-02-01"] == pytest.approx(8 * factor) and rows[2, "None"] is None
    table = spark.read.option("header", True).csv(wide)
    assert table.columns[-2:] == ["2015-01-01", "2015-02-01"]
    lines = {r["BASIN_ID"]: r for r in table.collect()}
    assert float(lines["1"]["2015-02-01"]) == rows[1, "2015-02-01"] and lines["2"]["2015-01-01"] is None and lines["1"]["BCU_name"] == "bcu, 1"
    assert read_area(spark, str(tmp_path / "no.nc"), strict=False) is None
    argv = ["aggregate", "--test-file", config.test_file, "--area-file", config.area_file, "--basin-shapefile", config.basin_shapefile, "--output-dir", str(tmp_path / "cli")]
    assert cli.main(argv, spark) == 0 and (tmp_path / "cli").is_dir()
    assert cli.main(["sweep", "--dry-run"], spark) == 0


@pytest.mark.parametrize("n", [4, 2500])
def test_wide_files_come_back(spark, tmp_path, n):
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    ids = "BASIN_ID long, BCU_name string, NAME string, REGION string, area_km2 double"
    rows = [(1, "a, \"b\"", "x", None, 1.5, d, k + 0.25) for k, d in enumerate(dates) if k not in (0, 2)]
    rows += [(2, "c", "y", "z", 2.5, dates[2], 7.0), (3, "d", "y", "z", 3.5, None, None), (4, "e", "y", "z", 4.5, dates[0], None)]
    rows += [(1, "a, \"b\"", "x", None, 1.5, dates[1], 9.0)]  # a second value of a date: the least counts
    long = spark.createDataFrame(rows, ids + ", date date, q double")
    names = [str(d) for d in dates]
    sinks.write_wide(long, "q", names, METADATA, str(tmp_path / "w"))
    table = {r["BASIN_ID"]: r for r in read_wide(spark, str(tmp_path / "w")).collect()}
    assert set(table) == {"1", "2", "3", "4"} and list(table["1"].asDict()) == [*METADATA, *names]
    assert [table["1"][d] for d in names] == [None if k in (0, 2) else str(k + 0.25) for k in range(n)] and table["1"]["BCU_name"] == "a, \"b\""
    assert [d for d in names if table["2"][d] is not None] == names[2:3] and not any(table[b][d] for b in "34" for d in names)
    back = sorted((r["BASIN_ID"], r["date"], r["q"]) for r in read_long(spark, str(tmp_path / "w"), "q").collect())
    assert back == sorted([(1, d, k + 0.25) for k, d in enumerate(dates) if k not in (0, 2)] + [(2, dates[2], 7.0)])
    sinks.write_wide(long.where("BASIN_ID = 3"), "q", [], METADATA, str(tmp_path / "none"))
    assert read_wide(spark, str(tmp_path / "none")).collect()[0]["BASIN_ID"] == "3"


def test_panel_pipelines_and_sinks(spark, tmp_path):
    day = F.explode(F.sequence(F.lit(dt.date(2013, 1, 1)), F.lit(dt.date(2017, 12, 31)))).alias("date")
    keys = "BASIN_ID long, NAME string, REGION string, hydro_model string, climate_model string"
    base = spark.createDataFrame([(1, "a", "r", h, c) for h in ("h1", "h2") for c in ("C1", "C2")], keys).select("*", F.lit("n").alias("BCU_name"), F.lit(1.0).alias("area_km2"), day)
    value = (F.dayofyear("date") + F.length("hydro_model") * F.year("date") % 7 + F.when(F.col("climate_model") == "C1", 3).otherwise(0)).cast("double")
    daily = base.withColumn("qtot", value)
    m = monthly(daily, "qtot", ("BASIN_ID", "NAME", "REGION", "area_km2", "hydro_model", "climate_model"))
    past, later = m.where("year < 2015"), m.where("year >= 2015")
    future = later.withColumn("ssp_scenario", F.lit("ssp126")).unionByName(later.withColumn("ssp_scenario", F.lit("ssp370")).withColumn("qtot_mean", F.col("qtot_mean") + 1))
    panel = rolling_panel(past, future, windows={"5yr": 12})
    assert panel.count() == 2 * 2 * 36 * 2 and panel.where("qtot_mean_5yr IS NULL").count() == 0 and panel.where("climate_model = 'c1'").count() > 0
    results = variance_analysis(panel, {"qtot_mean": "annual"})
    assert set(results) == {"annual_results", "annual_summary", "annual_significance", "annual_report", "comparison"} and results["annual_results"].count() == 1
    assert "month_x_ssp_scenario_pct" in results["annual_results"].columns
    sinks.write_panel(panel, str(tmp_path / "panel"))
    back = read_panel(spark, str(tmp_path / "panel"), "qtot_mean")
    assert back.count() == panel.count()
    assert "ssp126" in str(back.where("ssp_scenario = 'ssp126'").inputFiles())
    assert cli.main(["ensemble", "--input", str(tmp_path / "panel"), "--output", str(tmp_path / "ens"), "--regional"], spark) == 0
    assert (tmp_path / "ens" / "box").is_dir()
    assert cli.main(["anova", "--input", str(tmp_path / "panel"), "--output", str(tmp_path / "anova")], spark) == 0
    assert sinks.as_json(back.limit(1)).collect()[0]["json"].startswith("{")
    sinks.write_json(back.limit(1), str(tmp_path / "json"))
    assert sinks.log_to(str(tmp_path / "log")).exists()


def test_streaming_months_equal_batch(spark, tmp_path):
    # Large means beside small differences: sums of squares would cancel.
    rows = [(b, dt.date(2001, m, d), 1e9 + b * m + d) for b in (1, 2) for m in (1, 2, 3) for d in range(1, 29)]
    schema = "BASIN_ID long, date date, q double"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = monthly_stream(stream, "q", ("BASIN_ID",)).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["BASIN_ID"], r["month"]): r for r in finish_months(spark.table("days"), "q", ("BASIN_ID",)).collect()}
    for r in monthly(df, "q", ("BASIN_ID",)).collect():
        g = got[r["BASIN_ID"], r["month"]]
        assert all(g[c] == pytest.approx(r[c]) for c in ("q_mean", "q_std", "q_min", "q_max")) and g["date"] == r["date"]
