"""The sweep: one job per combination of models, scenario, variable and resolution."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import clean, unit_factor
from ..operators.geo import cell_basin, with_weights
from ..schema import CLIMATE_MODELS, HYDRO_MODELS, METADATA, RUN, SCENARIOS, VARIABLES
from ..sources import files
from ..sources.discovery import find_cubes
from ..sources.netcdf import grid_digest, opened_cube, read_area, read_cells, read_runs
from ..sources.shapefile import read_basins
from ..sources.sinks import write_panel, write_run_lines
from .config import RunConfig

log = logging.getLogger(__name__)


def job_matrix(spark: SparkSession, hydro: tuple[str, ...] = HYDRO_MODELS, climate: tuple[str, ...] = CLIMATE_MODELS, scenarios: tuple[str, ...] = SCENARIOS, variables: tuple[str, ...] = VARIABLES, resolutions: tuple[str, ...] = ("monthly",)) -> DataFrame:
    """Every combination of the levels given; their number is the lists' product."""
    out = spark.range(1).select()
    for name, levels in (("hydro_model", hydro), ("climate_model", climate), ("scenario", scenarios), ("variable", variables), ("temporal_resolution", resolutions)):
        out = out.select("*", F.explode(F.array(*map(F.lit, levels))).alias(name))
    return out


def matrix_of(levels: dict[str, DataFrame]) -> DataFrame:
    """The same from level tables (one column each, few rows)."""
    out = None
    for name, df in levels.items():
        one = df.select(F.col(df.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def job_counts(jobs: DataFrame, by: str) -> DataFrame:
    """by, jobs."""
    return jobs.groupBy(by).agg(F.count("*").alias("jobs"))


def success_rates(report: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed and the percentage, from rows with `status`."""
    good = F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).cast("long")
    n = F.count("*")
    out = report.agg(n.alias("total"), F.coalesce(good, F.lit(0)).alias("succeeded"))
    return out.withColumns({"failed": F.col("total") - F.col("succeeded"), "success_pct": F.when(F.col("total") > 0, 100.0 * F.col("succeeded") / F.col("total"))})


def configs(jobs: DataFrame, base: RunConfig) -> list[RunConfig]:
    """One setting per job; the matrix is small by construction."""
    return [replace(base, **r.asDict()) for r in jobs.collect()]


def planned(jobs: list[RunConfig]) -> list[dict]:
    """Status rows of a dry run."""
    return [_keys(job) | {"status": "planned", "error": ""} for job in jobs]


def _keys(job: RunConfig) -> dict:
    return {"hydro_model": job.hydro_model, "climate_model": job.climate_model, "scenario": job.scenario, "variable": job.variable, "temporal_resolution": job.temporal_resolution}


def run_sweep(spark: SparkSession, jobs: list[RunConfig]) -> list[dict]:
    """All runs as one plan: their cubes are one table keyed by run, aggregated by one job.

    The runs share the basins, areas, output folder and grid of the first whose
    files can be opened.  Results go to {output_dir}/panel (Parquet, by variable and
    RUN) and, wide, to {output_dir}/wide/{variable}_{resolution}/run={file}.  Returns
    one status row a run: a run whose files are missing, broken or of another grid
    has failed, and no row of it is written; the others are.
    """
    found, failed = [], {}
    for n, job in enumerate(jobs):
        try:
            found.append((n, find_cubes(job.input_dir, job.hydro_model, job.climate_model, job.scenario, job.data_period, job.variable, job.temporal_resolution, job.test_file)))
        except OSError as e:
            failed[n] = str(e)
    grid, first = None, None
    for n, paths in found:
        try:
            with files.opened(paths[0]) as f:
                grid, first = grid_digest(opened_cube(f)), (n, paths[0])
            break
        except Exception as e:  # noqa: BLE001  that run's own row will say it
            log.warning("%s: %s", paths[0], e)
    written: dict[int, str | None] = {}
    if first is not None:
        base = jobs[first[0]]
        series = _swept(spark, jobs, found, first[1], grid)
        out = f"{base.output_dir}/sweep"
        series.write.mode("overwrite").parquet(out)
        rows = spark.read.parquet(out)
        written = {r["run"]: r["error"] for r in rows.groupBy("run").agg(F.max("error").alias("error")).collect()}  # one row a run
        _write_runs(spark, rows, jobs, [n for n, _ in found if written.get(n, "no step was read") is None])
    for n, _ in found:
        if (why := written.get(n, "no step was read")) is not None:
            failed[n] = why
    return [_keys(job) | {"status": "failed" if n in failed else "success", "error": failed.get(n, "")} for n, job in enumerate(jobs)]


def _swept(spark: SparkSession, jobs: list[RunConfig], found: list[tuple[int, list[str]]], first: str, grid: str) -> DataFrame:
    """run, BASIN_ID, date, value, error: one scan, one join with the cell map, one aggregation."""
    base = jobs[found[0][0]]
    basins = read_basins(spark, base.basin_shapefile)
    cells = cell_basin(read_cells(spark, first, jobs[next(n for n, p in found if first in p)].variable), basins)
    kinds = {v: unit_factor(v) for v in sorted({jobs[n].variable for n, _ in found})}
    area = read_area(spark, base.area_file) if any(needs for _, needs in kinds.values()) else None
    mapped = with_weights(cells, area)
    raw = read_runs(spark, [{"variable": jobs[n].variable, "paths": paths} for n, paths in found], mapped, grid, drop_missing=True)
    about = spark.createDataFrame([(k, n, jobs[n].variable, jobs[n].spatial_method, *kinds[jobs[n].variable]) for k, (n, _) in enumerate(found)], "run int, _job int, _variable string, _method string, _factor double, _area boolean")
    rows = raw.join(F.broadcast(about), "run").join(F.broadcast(mapped), ["lat_idx", "lon_idx"], "left")  # the map is bounded by the grid
    value = clean(F.col("value")) * F.col("_factor") * F.when(F.col("_area"), F.col("weight")).otherwise(1.0)
    made = rows.groupBy("_job", "BASIN_ID", "date").agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.max("error").alias("error"), F.min("_method").alias("_m"), F.min("_variable").alias("_v"))
    chosen = F.when((F.col("_v") == "dis") | (F.col("_m") == "max"), F.col("max")).when(F.col("_m") == "mean", F.col("mean")).otherwise(F.col("sum"))
    return made.select(F.col("_job").alias("run"), "BASIN_ID", "date", chosen.alias("value"), "error")


def _write_runs(spark: SparkSession, rows: DataFrame, jobs: list[RunConfig], good: list[int]) -> None:
    """Panel and wide files of the runs that went well."""
    if not good:
        return
    base = jobs[good[0]]
    basins = read_basins(spark, base.basin_shapefile).select(*METADATA)
    keys = spark.createDataFrame([(n, jobs[n].hydro_model, jobs[n].climate_model, jobs[n].scenario, jobs[n].variable) for n in good], "run int, hydro_model string, climate_model string, ssp_scenario string, variable string")
    kept = rows.where("error IS NULL AND BASIN_ID IS NOT NULL").join(F.broadcast(keys), "run").join(F.broadcast(basins), "BASIN_ID")
    panel = kept.withColumns({"year": F.year("date"), "month": F.month("date")}).select(*METADATA, *RUN, "variable", "date", "value", "year", "month")
    write_panel(panel, f"{base.output_dir}/panel", ("variable", *RUN))
    for variable in sorted({jobs[n].variable for n in good}):
        write_run_lines(panel.where(F.col("variable") == variable), "value", f"{base.output_dir}/wide/{variable}_{base.temporal_resolution}", variable, base.temporal_resolution, base.data_period)
