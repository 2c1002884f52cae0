"""Closed-form cases for each operator family."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnflow.functions.cells import clean, depth_mm_per_day, missing_share, unit_factor
from tarnflow.functions.dates import decode_time
from tarnflow.functions.naming import parse_run_file, run_file
from tarnflow.operators import anova as av
from tarnflow.operators import compare, ensemble, outlet, panel as pn, rolling, zonal
from tarnflow.operators.geo import cell_basin, with_weights
from tarnflow.operators.monthly import monthly
from tarnflow.plans import jobs
from tarnflow.plans.config import RunConfig, expand_path, load_config
from tarnflow.schema import BASINS, GRID

D = dt.date


def rect(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def basin_frame(spark, shapes):
    rows = [(i, f"b{i}", f"n{i}", "r", 1.0, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in shapes.items()]
    return spark.createDataFrame(rows, BASINS)


def grid_frame(spark, values, date=D(2000, 1, 15)):
    """values: {time: 8 x 8 list}; lat falls with the row."""
    rows = [(t, date + dt.timedelta(days=31 * t), y, x, 3.5 - y, x - 3.5, None if v[y][x] is None else float(v[y][x])) for t, v in values.items() for y in range(8) for x in range(8)]
    return spark.createDataFrame(rows, GRID)


def cells_of(grid):
    return grid.select("lat_idx", "lon_idx", "lat", "lon").distinct()


ONES = {0: [[1.0] * 8 for _ in range(8)]}


def by_basin(df, column="value"):
    return {r["BASIN_ID"]: r[column] for r in df.collect()}


def even_odd(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def square_meets(ring, x, y, half):
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if min(x1, x2) <= x + half and max(x1, x2) >= x - half and min(y1, y2) <= y + half and max(y1, y2) >= y - half:
            sides = [(x2 - x1) * (y + b * half - y1) - (y2 - y1) * (x + a * half - x1) for a in (-1, 1) for b in (-1, 1)]
            if min(sides) <= 0 <= max(sides):
                return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_scanline_equals_the_rule_cell_by_cell(spark, seed):
    """Random stars with holes, edges through centres, an uneven grid, and both rules."""
    rng = random.Random(seed)
    lats = sorted({round(rng.uniform(-5, 5), 1) for _ in range(14)}, reverse=True) if seed == 3 else [4.75 - 0.5 * k for k in range(20)]
    lons = [-4.75 + 0.5 * k for k in range(20)]
    cells = [(y, x, lat, lon) for y, lat in enumerate(lats) for x, lon in enumerate(lons)]
    shapes = {}
    for b in range(1, 6):
        cx, cy, rings = rng.uniform(-3, 3), rng.uniform(-3, 3), []
        for size in (3.0, 1.0):
            k = rng.randrange(3, 12)
            ring = [(cx + size * rng.uniform(0.3, 1) * math.cos(6.283 * i / k), cy + size * rng.uniform(0.3, 1) * math.sin(6.283 * i / k)) for i in range(k)]
            ring = [(round(x * 4) / 4, round(y * 4) / 4) for x, y in ring] if seed % 2 else ring
            rings.append([*ring, ring[0]])
        shapes[b] = rings
    shapes[6] = [[(0.25, 0.25), (0.25, 0.25)], []]  # without area
    frame = spark.createDataFrame(cells, "lat_idx int, lon_idx int, lat double, lon double")
    inside = {(b, y, x) for b, rings in shapes.items() for y, x, lat, lon in cells if even_odd(rings, lon, lat)}
    basins = basin_frame(spark, shapes)
    for columns in (16.0, 1.5):
        assert {tuple(r) for r in cell_basin(frame, basins, columns=columns).collect()} == inside
    half = 0.25
    touched = inside | {(b, y, x) for b, rings in shapes.items() for y, x, lat, lon in cells if any(square_meets(r, lon, lat, half) for r in rings)}
    got = cell_basin(frame, basins, all_touched=True, half=half, mark_contained=True).collect()
    assert len(got) == len(touched) and {tuple(r)[:3] for r in got} == touched and {tuple(r)[:3] for r in got if r["contained"]} == inside


def test_a_polygon_of_100_000_points(spark):
    n = 100_000
    ring = [{"x": 90 * math.cos(2 * math.pi * k / n) * (1 + 0.01 * math.sin(500 * k / n)), "y": 80 * math.sin(2 * math.pi * k / n)} for k in range(n)]
    basins = spark.createDataFrame([(1, "b", "n", "r", 1.0, [[*ring, ring[0]]])], BASINS)
    y, x = F.floor(F.col("id") / 720).cast("int"), (F.col("id") % 720).cast("int")
    cells = spark.range(720 * 360).select(y.alias("lat_idx"), x.alias("lon_idx"), (89.75 - y * 0.5).alias("lat"), (x * 0.5 - 179.75).alias("lon"))
    mapped = cell_basin(cells, basins)
    assert "rings" not in mapped.columns and mapped.count() == pytest.approx(math.pi * 90 * 80 * 4, rel=0.02)
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) >= 2 and "BroadcastNestedLoop" not in mapped._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_uniform_grid_counts_cells_and_shapes(spark):
    grid = grid_frame(spark, ONES)
    basins = basin_frame(spark, {1: [rect(-4, -4, 0, 0)], 2: [rect(-4, -4, 4, 4), rect(-2, -2, 2, 2)], 3: [rect(0.1, 0.1, 0.3, 0.3)], 4: [rect(-4, -4, -3, -3), rect(3, 3, 4, 4)]})
    m = cell_basin(cells_of(grid), basins)
    out = zonal.with_basins(basins, zonal.zonal(grid, m, "sum"))
    assert by_basin(out) == {1: 16.0, 2: 48.0, 3: None, 4: 2.0}
    assert set(out.columns) >= {"BCU_name", "NAME", "REGION", "area_km2"}


def test_a_centre_on_an_edge_belongs_to_one_of_two_neighbours(spark):
    grid = grid_frame(spark, ONES)
    basins = basin_frame(spark, {1: [rect(-4, -4, 0.5, 4)], 2: [rect(0.5, -4, 4, 4)]})
    m = cell_basin(cells_of(grid), basins)
    assert m.count() == 64 and m.select("lat_idx", "lon_idx").distinct().count() == 64


def test_overlap_counts_twice_or_for_the_last(spark):
    grid = grid_frame(spark, ONES)
    basins = basin_frame(spark, {1: [rect(-4, -4, 0, 0)], 2: [rect(-2, -4, 2, 0)]})
    both = by_basin(zonal.zonal(grid, cell_basin(cells_of(grid), basins), "sum"))
    last = by_basin(zonal.zonal(grid, cell_basin(cells_of(grid), basins, "last"), "sum"))
    assert both == {1: 16.0, 2: 16.0} and last == {1: 8.0, 2: 16.0}
    with pytest.raises(ValueError):
        cell_basin(cells_of(grid), basins, "first")


def test_all_touched_adds_border_cells(spark):
    grid = grid_frame(spark, ONES)
    basins = basin_frame(spark, {1: [rect(0.1, 0.1, 0.3, 0.3)], 2: [rect(-0.2, -0.2, 0.2, 0.2)]})
    m = cell_basin(cells_of(grid), basins, all_touched=True, half=0.5)
    assert by_basin(zonal.zonal(grid, m, "sum")) == {1: 1.0, 2: 4.0}


def test_contained_cells_win_ties_over_touched_ones(spark):
    grid = grid_frame(spark, ONES)
    basins = basin_frame(spark, {1: [rect(-3.2, -3.2, -1.8, -1.8)]})  # one centre, and parts of the eight cells around it
    m = cell_basin(cells_of(grid), basins, all_touched=True, half=0.5, mark_contained=True)
    assert m.count() == 9 and m.where("contained").count() == 1
    top = outlet.outlets(grid, m).collect()[0]
    assert (top["lat_idx"], top["lon_idx"]) == (6, 1)
    assert zonal.sample_steps(grid_frame(spark, {t: ONES[0] for t in range(7)}), 3, 6).select("time_idx").distinct().count() == 2


def test_tiles_lose_no_cell(spark):
    cells = spark.range(36 * 18).select((F.floor(F.col("id") / 36)).cast("int").alias("lat_idx"), (F.col("id") % 36).cast("int").alias("lon_idx")).select("*", (F.col("lat_idx") * 10 - 85.0).alias("lat"), (F.col("lon_idx") * 10 - 175.0).alias("lon"))
    basins = basin_frame(spark, {1: [rect(-180, -90, 180, 90)], 2: [rect(-31, -31, 29, 31)]})
    for tile in (7.0, 10.0, 400.0):
        assert {r["BASIN_ID"]: r["n"] for r in cell_basin(cells, basins, columns=tile).groupBy("BASIN_ID").agg(F.count("*").alias("n")).collect()} == {1: 648, 2: 36}


def test_fill_flags_and_nan_go_before_or_after(spark):
    values = [[1.0] * 8 for _ in range(8)]
    values[4][0], values[4][1], values[5][0] = 1e20, float("nan"), None
    grid = grid_frame(spark, {0: values})
    m = cell_basin(cells_of(grid), basin_frame(spark, {1: [rect(-4, -4, 0, 0)]}))
    assert by_basin(zonal.zonal(grid, m, "sum")) == {1: 13.0}
    assert by_basin(zonal.zonal(grid, m, "sum", mask_stage="post")) == {1: None}
    row = grid.agg(missing_share(F.col("value")).alias("m"), F.count(clean(F.col("value"))).alias("n")).collect()[0]
    assert row["m"] == 2 / 64 and row["n"] == 61


def test_methods_and_discharge_rule(spark):
    grid = grid_frame(spark, {0: [[float(8 * y + x) for x in range(8)] for y in range(8)]})
    m = cell_basin(cells_of(grid), basin_frame(spark, {1: [rect(-4, -4, -2, -2)]}))
    got = {k: by_basin(zonal.zonal(grid, m, k))[1] for k in ("sum", "mean", "max")}
    assert got == {"sum": 48 + 49 + 56 + 57, "mean": 52.5, "max": 57}
    for bad in (lambda: zonal.zonal(grid, m, "median"), lambda: zonal.zonal(grid, m, "sum", "dis")):
        with pytest.raises(ValueError):
            bad()
    assert by_basin(zonal.zonal(grid, m, "sum", "dis", force=True))[1] == 210


def test_units_and_weights(spark):
    assert unit_factor("dis", 365)[0] == pytest.approx(365 * 86400 / 1e9) and not unit_factor("dis")[1]
    assert unit_factor("qtot", 365) == (pytest.approx(3.1536e-5), True)
    with pytest.raises(ValueError):
        unit_factor("qg")
    grid = grid_frame(spark, ONES)
    m = cell_basin(cells_of(grid), basin_frame(spark, {1: [rect(-4, -4, -3, -2)]}))
    area = spark.createDataFrame([(6, 0, 2.0), (7, 0, float("nan"))], "lat_idx int, lon_idx int, area_m2 double")
    assert by_basin(zonal.zonal(grid, with_weights(m, area, 10.0), "sum")) == {1: 20.0}
    assert spark.range(1).select(depth_mm_per_day(F.lit(1.0), F.lit(86400.0 * 1000)).alias("d")).collect()[0]["d"] == pytest.approx(1.0)


def test_annual_stages(spark):
    v = {t: [[float(t + 1)] * 8 for _ in range(8)] for t in range(3)}
    grid = grid_frame(spark, v)
    basins = basin_frame(spark, {1: [rect(-4, -4, -2, -2)], 2: [rect(0.1, 0.1, 0.3, 0.3)]})
    m = cell_basin(cells_of(grid), basins)
    want = {"sum": 24.0, "max": 3.0, "mean": 2.0, "quantile": 1.2, "meansd": 2 + np.std([1, 2, 3])}
    for method, x in want.items():
        got = by_basin(zonal.annual(grid, m, basins, method))
        assert got[1] == pytest.approx(x) and got[2] == 0.0
    with pytest.raises(ValueError):
        zonal.annual(grid, m, basins, "mode")


def test_outlets_ties_moves_and_empty(spark):
    v = [[[0.0] * 8 for _ in range(8)] for _ in range(2)]
    v[0][6][1] = v[0][6][0] = 9.0  # a tie: the first by row, then column
    v[1][7][1] = 5.0
    grid = grid_frame(spark, dict(enumerate(v)))
    basins = basin_frame(spark, {1: [rect(-4, -4, -2, -2)], 2: [rect(0.1, 0.1, 0.3, 0.3)], 3: [rect(3, 3, 4, 4)]})
    report = outlet.stability(outlet.outlets(grid, cell_basin(cells_of(grid), basins)), basins)
    got = {r["BASIN_ID"]: r for r in report.collect()}
    assert [tuple(p) for p in got[1]["unique_locations"]] == [(6, 0), (7, 1)]
    assert [got[i]["status"] for i in (1, 2, 3)] == ["moving", "empty", "fixed"]
    assert (got[1]["min_value"], got[1]["max_value"], got[1]["n_observations"], got[2]["n_observations"]) == (5.0, 9.0, 2, 0)
    s = outlet.stability_summary(report, "m").collect()[0]
    assert (s["total_basins"], s["fixed_basins"], s["moving_basins"], s["empty_basins"]) == (3, 1, 1, 1)
    assert outlet.agreement_summary(outlet.agreement(report, report)).collect()[0]["agree_pct"] == 100.0
    assert outlet.stability_summary(report.limit(0)).collect()[0]["fixed_pct"] is None


def test_time_decoding(spark):
    cases = [(0.5, "days since 1901-1-1", D(1901, 1, 1)), (1.5, "days since 1901-01-01 00:00:00", D(1901, 1, 3)), (2.5, "day since 1901-1-1", D(1901, 1, 3)), (1.0, "months since 2015-1-31", D(2015, 2, 28)), (1.0, "years since 2016-2-29", D(2017, 2, 28)), (25.0, "hours since 2000-1-1", D(2000, 1, 2)), (-1.0, "minutes since 2000-1-1", D(1999, 12, 31)), (86400.0, "seconds since 2000-1-1", D(2000, 1, 2)), (1.0, "fortnights since 2000-1-1", None), (None, "days since 2000-1-1", None)]
    df = spark.createDataFrame([(i, v, u) for i, (v, u, _) in enumerate(cases)], "i int, v double, u string")
    got = {r["i"]: r["d"] for r in df.select("i", decode_time(F.col("v"), F.col("u")).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_file_names(spark):
    names = [run_file("qtot", "monthly", "MIROC-INTEG-LAND", "gfdl-esm4", "ssp126", "future"), "/x/qr_daily_Water_GAP_UKESM1-0-LL_historical_historical.csv", "qtot_monthly_H08_other_ssp126_future.csv", "qtot_monthly_H08_gfdl-esm4_ssp126_future.nc", "a_b.csv", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r["i"]: r["r"] for r in df.select("i", parse_run_file(F.col("n")).alias("r")).collect()}
    assert tuple(got[0]) == ("qtot", "monthly", "MIROC-INTEG-LAND", "gfdl-esm4", "ssp126", "future")
    assert tuple(got[1]) == ("qr", "daily", "Water-GAP", "UKESM1-0-LL", "historical", "historical")
    assert got[2] is got[3] is got[4] is got[5] is None


def test_reshape_round_trip(spark):
    wide = spark.createDataFrame([(1, "a", 1.0, None, 3.0), (2, "b", None, 5.0, 6.0)], "BASIN_ID long, NAME string, `2001-01-15` double, `2001-02-15` double, `2001-03-15` double")
    long = pn.to_long(wide, "qtot")
    assert long.columns == ["BASIN_ID", "NAME", "date", "qtot", "year", "month"] and long.count() == 4
    again = pn.to_wide(long, "qtot", ["2001-01-15", "2001-02-15", "2001-03-15"], ("BASIN_ID", "NAME"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))
    with pytest.raises(ValueError):
        pn.to_long(wide.select("BASIN_ID"), "qtot")
    with pytest.raises(FileNotFoundError):
        pn.concat_runs([])


def series(spark, rows):
    return spark.createDataFrame(rows, "BASIN_ID long, hydro_model string, climate_model string, ssp_scenario string, date date, year int, month int, q double")


def months(first, n):
    return [D(first + k // 12, k % 12 + 1, 15) for k in range(n)]


def test_rolling_matches_a_plain_loop_on_both_paths(spark):
    rng = random.Random(4)
    past = [(1, "h", "c", "historical", d, d.year, d.month, None if rng.random() < 0.05 else rng.uniform(0, 9)) for d in months(2010, 60)]
    future = [(1, "h", "c", s, d, d.year, d.month, rng.uniform(0, 9)) for s in ("ssp126", "ssp585") for d in months(2015, 36)]
    joined = pn.join_history(series(spark, past), series(spark, future))
    assert joined.where("data_period = 'historical'").count() == 120
    for method in ("sliding", "blocks"):
        out = rolling.rolling_means(joined, "q", {"w": 12}, method=method)
        for scenario in ("ssp126", "ssp585"):
            rows = sorted((r["date"], r["q"], r["q_w"]) for r in out.where(F.col("ssp_scenario") == scenario).collect())
            for k, (_, _, got) in enumerate(rows):
                own = [q for _, q, _ in rows[max(0, k - 11) : k + 1]]
                want = sum(own) / 12 if len(own) == 12 and None not in own else None
                assert got == (pytest.approx(want) if want is not None else None)
    kept = rolling.future_only(rolling.with_periods(joined), 2016)
    assert {r["decade"] for r in kept.select("decade").distinct().collect()} == {2010} and kept.count() == 48
    a = rolling.availability(rolling.rolling_means(series(spark, future), "q", {"w": 12}), ("q_w",), 2016).collect()[0]
    assert (a["first_year"], a["last_year"], a["n_values"], a["n_future_values"]) == (2015, 2017, 50, 48)


@pytest.mark.parametrize("n,length", [(1, 30), (7, 30), (7, 6), (10, 40), (10, 41), (400, 1500)])
def test_block_sums_do_not_cancel(spark, n, length):
    """Values of 1e9 and one of 1e15 long before: differences of running totals would lose the small digits."""
    rng = random.Random(n)
    values = [1e15 if k == 0 else None if rng.random() < 0.02 else 1e9 + rng.random() for k in range(length)]
    rows = [(b, D(1900, 1, 1) + dt.timedelta(days=k), v) for b in (1, 2) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "BASIN_ID long, date date, q double")
    got = sorted((r["BASIN_ID"], r["date"], r["q_w"], r["q_two"]) for r in rolling.rolling_means(df, "q", {"w": n, "two": 2}, ("BASIN_ID",), method="blocks").collect())
    assert len(got) == 2 * length
    for (_, date, a, b), k in zip(got, [*range(length)] * 2):
        for size, mean in ((n, a), (2, b)):
            own = values[max(0, k - size + 1) : k + 1]
            if len(own) < size or None in own:
                assert mean is None
            else:
                assert mean == pytest.approx(math.fsum(own) / size, rel=1e-14)
    with pytest.raises(ValueError):
        rolling.rolling_means(df, "q", {"w": n}, ("BASIN_ID",), method="prefix")


@pytest.mark.parametrize("method", ["sliding", "blocks"])
def test_stretches_give_the_same_means(spark, method):
    """Series of 1 to 700 rows in stretches of 88 or more, with null keys, dates and values, and at two widths."""
    rng = random.Random(6)
    rows = [(b, k % 2, None if k == 5 else D(1900, 1, 1) + dt.timedelta(days=2 * k), None if rng.random() < 0.01 else rng.uniform(0, 9)) for b, n in ((1, 700), (2, 1), (3, 176), (None, 300), (4, 12), (5, 88)) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "BASIN_ID long, flag int, date date, q double").repartition(5)
    result = lambda **how: sorted((tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in rolling.rolling_means(df, "q", {"a": 12, "b": 3}, ("BASIN_ID",), method=method, **how).collect()))
    want = result()
    assert len(want) == len(rows) and want == result(stretch=88) == result(stretch=131)
    # A stretch has its own rows and those just before it.
    cut = rolling.stretches(df, len(rows), 88, 11, ("BASIN_ID",)).withColumn("p", F.spark_partition_id())
    sizes = cut.groupBy("p").agg(F.sum(F.col("_own").cast("int")).alias("own"), F.count("*").alias("all"), F.countDistinct("_chunk").alias("chunks")).collect()
    assert sum(r["own"] for r in sizes) == len(rows) and all(r["own"] <= 88 and r["all"] <= 99 and r["chunks"] == 1 for r in sizes)
    assert rolling.rolling_means(df.limit(0), "q", {"a": 12}, ("BASIN_ID",), method=method).count() == 0


def test_one_long_series_is_many_tasks(spark):
    n = 700_000
    df = spark.range(n).select(F.lit(1).alias("BASIN_ID"), F.col("id").alias("date"), (F.col("id") % 1000).cast("double").alias("q"))
    out = rolling.rolling_means(df, "q", {"w": 3, "b": 400}, ("BASIN_ID",)).withColumn("p", F.spark_partition_id()).cache()
    sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 300_000
    assert out.where("q_w IS NULL").count() == 2 and out.where("q_b IS NULL").count() == 399
    assert out.where("date >= 2 AND date % 1000 >= 2 AND q_w <> q - 1").count() == 0
    out.unpersist()


def test_halo_gives_the_same_future_from_few_rows(spark):
    rng = random.Random(8)
    past = [(b, "h", c, "historical", d, d.year, d.month, rng.uniform(0, 9)) for b in (1, 2, 3) for c in "xy" for d in months(1990, 330) if b < 3 or d.year > 2014]  # to mid-2017
    future = [(b, "h", c, s, d, d.year, d.month, None if rng.random() < 0.1 else rng.uniform(0, 9)) for b in (1, 2, 4) for c in "xy" for s in ("ssp126", "ssp585") for d in months(2014, 60) if (d.year, d.month) > (2017, 6)]
    history, later = series(spark, past), series(spark, future)
    windows = {"a": 3, "b": 12}
    for method in ("sliding", "blocks"):
        want = rolling.future_only(rolling.rolling_means(pn.join_history(history, later), "q", windows, method=method), 2015, ("ssp126",))
        got = rolling.future_means(history, later, "q", windows, 2015, ("ssp126",), method=method)
        columns = ("BASIN_ID", "climate_model", "ssp_scenario", "date", "data_period", "q_a", "q_b")
        rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*columns).collect())
        assert rounded(got) == rounded(want) and len(rounded(got)) > 100
    halo = rolling.seam_halo(history, 11, 2015)
    assert halo.where("year < 2015").count() == 4 * 11 and halo.where("year >= 2015").count() == history.where("year >= 2015").count()
    assert "WindowGroupLimit" in halo._jdf.queryExecution().executedPlan().toString()


def test_history_or_future_alone(spark):
    past = series(spark, [(1, "h", "c", "historical", d, d.year, d.month, 1.0) for d in months(2010, 5)])
    assert {r["ssp_scenario"] for r in pn.join_history(past, past.limit(0)).collect()} == {"historical"}
    assert pn.join_history(past.limit(0), past).count() == 5
    assert rolling.frequency(past) == "monthly"
    daily = spark.createDataFrame([(D(2000, 1, d),) for d in (1, 1, 2, 2, 3)], "date date")
    assert rolling.frequency(daily) == "daily"


def test_monthly_is_exact_over_any_split_and_drops_null_keys(spark):
    rng = random.Random(1)
    rows = [(b, D(2001, m, d), rng.uniform(0, 1)) for b in (1, 2) for m in (1, 2) for d in range(1, 28)] + [(None, D(2001, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "BASIN_ID long, date date, qtot double")
    want = pd.DataFrame([r for r in rows if r[0]], columns=["b", "d", "v"]).assign(m=lambda x: x.d.map(lambda d: d.month)).groupby(["b", "m"]).v.agg(["mean", "std", "min", "max"])
    for parts in (1, 7):
        got = monthly(df.repartition(parts), "qtot", ("BASIN_ID", "absent")).collect()
        assert len(got) == 4
        for r in got:
            w = want.loc[(r["BASIN_ID"], r["month"])]
            assert (r["qtot_mean"], r["qtot_std"], r["qtot_min"], r["qtot_max"]) == tuple(pytest.approx(x) for x in w)
            assert r["date"] == D(2001, r["month"], 15)
    assert monthly(df, "qtot", ("BASIN_ID",), ("mean",)).columns == ["BASIN_ID", "year", "month", "qtot", "date"]


def balanced(spark, noise=0.0, basin=1):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(2):
        for c in range(3):
            for h in range(2):
                for m in range(1, 7):
                    for y in range(2000, 2005):
                        rows.append((basin, "n", "r", 1.0, f"h{h}", f"c{c}", f"s{s}", y, m, float(3 * s + 2 * c + h + 0.5 * m + 0.1 * (y - 2002) + noise * rng.normal())))
    return spark.createDataFrame(rows, "BASIN_ID long, NAME string, REGION string, area_km2 double, hydro_model string, climate_model string, ssp_scenario string, year int, month int, q double")


def test_balanced_anova_equals_the_textbook(spark):
    panel = balanced(spark, 0.3)
    row = av.anova(panel, "q").collect()[0].asDict()
    p = panel.toPandas()
    n, grand = len(p), p.q.mean()
    main = {k: ((p.groupby(k).q.mean() - grand) ** 2 * p.groupby(k).q.size()).sum() for k in ("ssp_scenario", "climate_model", "hydro_model", "month")}
    shares = {k: row[f"{k}_pct"] for k in main}
    for a in main:
        for b in main:
            assert shares[a] / shares[b] == pytest.approx(main[a] / main[b])
    assert sum(v for k, v in row.items() if k.endswith("_pct")) == pytest.approx(100)
    assert row["n_observations"] == n and row["mean_value"] == pytest.approx(grand) and row["std_value"] == pytest.approx(p.q.std())
    assert row["ssp_scenario_pvalue"] < 1e-6 and 0 <= row["ssp_scenario_x_year_pvalue"] <= 1 and 0 < row["r_squared"] < 1
    assert len(av.terms_of("qtot_mean")) == 8 and av.term_name(av.SEASONAL[-1]) == "month_x_ssp_scenario"


def test_anova_guards_summary_and_significance(spark):
    panel = balanced(spark, 0.3).unionByName(balanced(spark, 0.3, 2).where("hydro_model = 'h0'")).unionByName(balanced(spark, 0.3, 3).limit(149))
    r = av.anova(panel, "q")
    assert [x["basin_id"] for x in r.collect()] == [1]
    assert {x["BASIN_ID"]: x["reason"] for x in av.skipped(panel, "q").collect()} == {2: "one level of hydro_model", 3: "too few values"}
    s = av.summary(r)
    assert [x["metric"] for x in s.collect()] == ["Mean", "Median", "Std Dev", "Min", "Max"] and s.columns[-1] == "residual_pct"
    g = {x["factor"]: x for x in av.significance(r).collect()}
    assert g["SSP Scenario"]["percentage_significant"] == 100.0 and "SSP Scenario × Climate Model" in g
    assert av.compare_models([r]).collect()[0]["n_basins"] == 1
    # An empty scenario by climate cell lowers the interaction's degrees of freedom.
    p = balanced(spark, 0.3).toPandas()
    for frame, df in ((p, 2), (p[~((p.ssp_scenario == "s1") & (p.climate_model == "c2"))], 1)):
        cells = frame.groupby([*av.FACTORS, "year"], as_index=False).agg(n=("q", "size"), mean=("q", "mean"), css=("q", lambda x: ((x - x.mean()) ** 2).sum()))
        assert av.fit_cells(cells, av.BASE)["table"][("ssp_scenario", "climate_model")][1] == df


def test_anova_does_not_change_with_the_origin(spark):
    """Unbalanced data against nested least squares, and the same at 1e9."""
    panel = balanced(spark, 0.5).where("NOT (ssp_scenario = 's1' AND climate_model = 'c2') AND (month + year) % 5 > 0")
    p = panel.toPandas()

    def rss(terms):
        x = [np.ones((len(p), 1))]
        for t in terms:
            block = np.ones((len(p), 1))
            for name in t:
                one = p.year.to_numpy(float)[:, None] - 2002 if name == "year" else pd.get_dummies(p[name], drop_first=True).to_numpy(float)
                block = (block[:, :, None] * one[:, None, :]).reshape(len(p), -1)
            x.append(block)
        x = np.concatenate(x, axis=1)
        beta, _, rank, _ = np.linalg.lstsq(x, p.q.to_numpy(), rcond=1e-10)
        return np.square(p.q - x @ beta).sum(), rank

    full, rank = rss(av.SEASONAL)
    want = {}
    for t in av.SEASONAL:
        rest = [u for u in av.SEASONAL if u != t and not set(t) < set(u)]
        (a, ra), (b, rb) = rss(rest), rss([*rest, t])
        want[av.term_name(t)] = a - b, rb - ra
    total = sum(q for q, _ in want.values()) + full
    for shift in (0.0, 1e9, -1e9):
        row = av.anova(panel.withColumn("q", F.col("q") + shift), "q", terms=av.SEASONAL).collect()[0].asDict()
        close = {"rel": 1e-9 if shift == 0 else 1e-5, "abs": 1e-9 if shift == 0 else 1e-6}
        for name, (ss, df) in want.items():
            assert row[f"{name}_pct"] == pytest.approx(100 * ss / total, **close)
            assert row[f"{name}_pvalue"] == pytest.approx(av.f_survival((ss / df) / (full / (len(p) - rank)), df, len(p) - rank), **close)
        assert row["residual_pct"] == pytest.approx(100 * full / total, **close) and row["r_squared"] == pytest.approx(1 - full / np.square(p.q - p.q.mean()).sum(), **close)
        assert row["mean_value"] == pytest.approx(p.q.mean() + shift, rel=1e-12) and row["std_value"] == pytest.approx(p.q.std(), **close)


def test_f_distribution_tail():
    for f, d2 in ((0.5, 10), (3.0, 40), (7.7, 1000)):
        assert av.f_survival(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-9)
    assert av.f_survival(0, 3, 5) == 1.0 and math.isnan(av.f_survival(math.nan, 3, 5))
    assert av.f_survival(1.0, 7, 7) == pytest.approx(0.5)
    assert av.f_survival(161.4476, 1, 1) == pytest.approx(0.05, rel=1e-5)


def test_ensemble_cases(spark):
    panel = balanced(spark)
    m = ensemble.match_basins(spark.createDataFrame([(2, "Nile"), (1, "White NILE"), (3, None), (4, "Po")], "BASIN_ID long, NAME string"), ("nile", "^po$", "x"))
    assert sorted(map(tuple, m.collect())) == [("^po$", 4, "Po"), ("nile", 1, "White NILE")]
    v = ensemble.variance_decomposition(ensemble.annual_means(panel, "q"), "q").collect()[0]
    assert v["ssp_pct"] > v["hydro_model_pct"] > 0
    flat = ensemble.annual_means(panel.withColumn("q", F.lit(1.0)), "q")
    f = ensemble.variance_decomposition(flat, "q").collect()[0]
    assert (f["ssp_pct"], f["residual_pct"]) == (0.0, 100.0)
    assert ensemble.regional_annual(panel.withColumn("q", F.lit(None).cast("double")), "q").agg(F.sum("q")).collect()[0][0] == 0.0
    box = ensemble.box_stats(spark.createDataFrame([(1, "s", 1, float(x)) for x in (1, 2, 3, 4, 100)], "BASIN_ID long, ssp_scenario string, month int, q double"), "q", "ssp_scenario").collect()[0]
    assert (box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"]) == (2, 3, 4, 1, 4)
    with pytest.raises(ValueError):
        ensemble.spread(panel, "q", "month")
    assert ensemble.heatmap(panel, "q", 1, "s0", "c0").columns[2:] == [f"m{k:02d}" for k in range(1, 13)]


def test_agreement_metrics(spark):
    a = spark.createDataFrame([(1, i, float(i)) for i in range(1, 11)], "BASIN_ID long, t int, v double")
    r = compare.agreement_metrics(a, a.withColumn("v", F.col("v") * 1.1), ("BASIN_ID", "t"), "v").collect()[0]
    assert r["r"] == pytest.approx(1) and r["mean_relative"] == pytest.approx(0.1) and r["range_ratio"] == pytest.approx(1.1)
    assert compare.agreement_by_basin(a, a.withColumn("v", F.lit(0.0)), ("BASIN_ID", "t"), "v").collect()[0]["max_relative"] == 1.0


def test_jobs_and_settings(spark, tmp_path, monkeypatch):
    m = jobs.job_matrix(spark, climate=("a", "b", "c", "d", "e", "f"), resolutions=("daily", "monthly"))
    assert m.count() == 360 and {r["jobs"] for r in jobs.job_counts(m, "variable").collect()} == {180}
    few = jobs.configs(m.limit(3), RunConfig())
    records = jobs.planned(few)
    assert [r["status"] for r in records] == ["planned"] * 3 and records[0]["climate_model"] == "a"
    records = [{"status": x} for x in ("success", "failed", "success")]
    rate = jobs.success_rates(spark.createDataFrame([(r["status"],) for r in records], "status string")).collect()[0]
    assert (rate["total"], rate["failed"]) == (3, 1)
    monkeypatch.setenv("SOME_PLACE", "/data")
    assert expand_path("${SOME_PLACE}/a/../b") == "/data/b" and expand_path("${UNSET_PLACE_X}/a") == "/a"
    (tmp_path / "c.yaml").write_text("variable: dis\ninput_dir: ${SOME_PLACE}/in\n")
    c = load_config(RunConfig(scenario="ssp370"), str(tmp_path / "c.yaml"))
    assert (c.variable, c.scenario, c.input_dir) == ("dis", "ssp370", "/data/in")
    (tmp_path / "bad.yaml").write_text("colour: red\n")
    with pytest.raises(ValueError):
        load_config(RunConfig(), str(tmp_path / "bad.yaml"))


def test_box_stats_read_one_sorted_run(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "s", 1, float(v)) for v in rng.integers(0, 9, 501)] + [(1, "s", 2, float(v)) for v in rng.normal(size=40)] + [(2, "s", 1, 5.0), (2, "s", 1, None), (None, "s", 1, 1.0), (3, "s", 1, -1.0), (3, "s", 1, 2.0), (1, "s", 2, 99.0)]
    df = spark.createDataFrame(rows, "BASIN_ID long, ssp_scenario string, month int, q double")
    out = ensemble.box_stats(df, "q", "ssp_scenario")
    for r in out.collect():
        v = np.array([x[3] for x in rows if x[0] == r["BASIN_ID"] and x[2] == r["month"] and x[3] is not None])
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        own = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"], r["n"], r["whisker_low"], r["whisker_high"]) == (pytest.approx(q1), pytest.approx(q2), pytest.approx(q3), len(v), own.min(), own.max())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 4 and "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
