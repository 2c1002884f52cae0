"""The engine's end-to-end plans, each one lazy DataFrame plan between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import unit_factor
from ..functions.naming import run_file
from ..operators import anova as av
from ..operators.geo import cell_basin, with_weights
from ..operators.monthly import monthly
from ..operators.rolling import DAILY, MONTHLY, frequency, future_means, with_periods
from ..operators.outlet import outlets, stability, stability_summary
from ..operators.zonal import annual, sample_steps, with_basins, zonal
from ..schema import METADATA, RUN
from ..sources.discovery import find_cubes, glob_cubes
from ..sources.netcdf import read_area, read_cells, read_cube
from ..sources.shapefile import read_basins
from ..sources.sinks import annual_lines, write_json, write_lines, write_wide
from .config import RunConfig

#: Target columns of the variance analysis and the name of each temporal model.
TARGETS = {"qtot_mean": "annual", "qtot_mean_5yr": "5yr_rolling", "qtot_mean_30yr": "30yr_rolling"}


def weighted_map(cells: DataFrame, basins: DataFrame, area: DataFrame | None, variable: str, overlap: str = "all", days_per_year: float = 365.25) -> DataFrame:
    """Cells of basins with area and unit factor folded into one weight."""
    factor, needs_area = unit_factor(variable, days_per_year)
    if needs_area and area is None:
        raise ValueError(f"{variable} needs cell areas")
    return with_weights(cell_basin(cells, basins, overlap), area if needs_area else None, factor)


def basin_series(grid: DataFrame, basins: DataFrame, area: DataFrame | None, variable: str, method: str = "sum", overlap: str = "all", days_per_year: float = 365.25, cells: DataFrame | None = None) -> DataFrame:
    """Grid to basins in km3 per year: metadata, date, value; basins without cells have one row without a date.

    The map of cells, areas and the factor are joined once, small and first.
    Without `cells` (lat_idx, lon_idx, lat, lon) they come from a pass over the grid.
    """
    cells = grid.select("lat_idx", "lon_idx", "lat", "lon").distinct() if cells is None else cells
    return with_basins(basins, zonal(grid, weighted_map(cells, basins, area, variable, overlap, days_per_year), method, variable))


def _inputs(spark: SparkSession, config: RunConfig, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """Basins, and the weighted map of the files' grid."""
    basins = read_basins(spark, config.basin_shapefile)
    area = read_area(spark, config.area_file) if config.variable != "dis" else None
    return basins, weighted_map(read_cells(spark, files[0], config.variable), basins, area, config.variable)


def process_run(spark: SparkSession, config: RunConfig) -> list[str]:
    """Read one run's cubes, aggregate, write {run}.parquet (long) and {run}.csv (wide); returns the paths."""
    files = find_cubes(config.input_dir, config.hydro_model, config.climate_model, config.scenario, config.data_period, config.variable, config.temporal_resolution, config.test_file)
    basins, mapped = _inputs(spark, config, files)
    grid = read_cube(spark, files, config.variable, mapped=mapped, drop_missing=True)
    out = with_basins(basins, zonal(grid, mapped, config.spatial_method, config.variable))
    name = run_file(config.variable, config.temporal_resolution, config.hydro_model, config.climate_model, config.scenario, config.data_period).removesuffix(".csv")
    long = f"{config.output_dir}/{name}.parquet"
    out.withColumnRenamed("value", config.variable).write.mode("overwrite").parquet(long)
    written = spark.read.parquet(long)
    dates = [str(r["date"]) for r in written.select("date").where("date IS NOT NULL").distinct().orderBy("date").collect()]
    write_wide(written, config.variable, dates, METADATA, f"{config.output_dir}/{name}.csv")
    return [long, f"{config.output_dir}/{name}.csv"]


def annual_run(spark: SparkSession, config: RunConfig, method: str = "sum", q: float = 0.1, fill: float | None = 0.0) -> str:
    """One run's cubes to the annual table {variable}_{scenario}_{method}.csv: a column for each year, constant columns; returns the path.

    Each cell is reduced over its year, then the basin's cells (see `zonal.annual`);
    missing cells count as `fill`.  The constants name the run.
    """
    files = [config.test_file] if config.test_file else glob_cubes(config.input_dir, config.climate_model, config.scenario, config.variable, config.temporal_resolution)
    if not files:
        raise FileNotFoundError(f"no {config.variable} cube of {config.climate_model} {config.scenario} in {config.input_dir}")
    basins, mapped = _inputs(spark, config, files)
    grid = read_cube(spark, files, config.variable, mapped=mapped, drop_missing=fill is None)
    values = annual(grid, mapped, basins, method, q, fill)
    about = {"Model": config.hydro_model, "Scenario": config.scenario, "Variable": config.variable, "Region": config.region, "Unit": "km3/year"}
    path = f"{config.output_dir}/{config.variable}_{config.scenario}_{method}.csv"
    write_lines(annual_lines(values, basins, about), path)
    return path


def outlet_report(spark: SparkSession, config: RunConfig, steps: int = 50, n_basins: int | None = 20, every: int = 5, all_touched: bool = False) -> list[str]:
    """Where a run's outlets lie and whether they move: basins.json (one a line) and summary.json below output_dir; returns the paths."""
    files = find_cubes(config.input_dir, config.hydro_model, config.climate_model, config.scenario, config.data_period, config.variable, config.temporal_resolution, config.test_file)
    basins = read_basins(spark, config.basin_shapefile, n_basins)
    mapped = cell_basin(read_cells(spark, files[0], config.variable), basins, all_touched=all_touched, mark_contained=all_touched)
    grid = sample_steps(read_cube(spark, files, config.variable, steps=steps, mapped=mapped, drop_missing=True), every)
    report = stability(outlets(grid, mapped), basins)
    out = [f"{config.output_dir}/outlets/{name}.json" for name in ("basins", "summary")]
    write_json(report.coalesce(1), out[0])
    write_json(stability_summary(report, "all touched" if all_touched else "centre"), out[1])
    return out


def monthly_panel(daily: DataFrame, value: str = "qtot") -> DataFrame:
    """Daily panel to monthly statistics over all ids, sorted as reports want it."""
    keys = tuple(c for c in (*METADATA, *RUN) if c in daily.columns)
    return monthly(daily, value, keys).orderBy("BASIN_ID", *RUN, "date")


def rolling_panel(history: DataFrame, future: DataFrame, value: str = "qtot_mean", windows: dict[str, int] | None = None, first_year: int = 2015, scenarios: tuple[str, ...] | None = None, freq: str | None = "monthly") -> DataFrame:
    """The future with trailing means across the seam and flags; of history only what the windows reach is joined."""
    history, future = (x.withColumn("climate_model", F.lower("climate_model")) for x in (history, future))
    if windows is None:
        windows = DAILY if (freq or frequency(future)) == "daily" else MONTHLY
    return with_periods(future_means(history, future, value, windows, first_year, scenarios))


def variance_analysis(panel: DataFrame, targets: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """For each target that the panel has: results, summary, significance; and the comparison of all."""
    out, results = {}, []
    for target, name in (targets or TARGETS).items():
        if target not in panel.columns:
            continue
        r = av.anova(panel, target, name)
        results.append(r)
        out |= {f"{name}_results": r, f"{name}_summary": av.summary(r), f"{name}_significance": av.significance(r), f"{name}_report": av.report(r)}
    if results:
        out["comparison"] = av.compare_models(results)
    return out
