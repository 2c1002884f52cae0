"""Aggregation of grid cells to basins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean

METHODS = {"sum": F.sum, "mean": F.avg, "max": F.max}


def _method(name: str, variable: str | None = None, force: bool = False):
    if name not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    if variable == "dis" and name != "max" and not force:
        raise ValueError("discharge is routed: a basin's is its outlet's, so only max makes sense (force=True overrides)")
    return METHODS[name]


def zonal(grid: DataFrame, mapped: DataFrame, method: str = "sum", variable: str | None = None, mask_stage: str = "pre", force: bool = False, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """BASIN_ID, *keys, value: cells' values (times the map's weight, if any) by basin and step.

    mask_stage "pre" drops fill flags cell by cell; "post" only from results.
    Basins without any value have no row (see `with_basins`).  Partial sums are
    formed before the shuffle, so that carries basins times steps rows a task.
    """
    if mask_stage not in ("pre", "post"):
        raise ValueError("mask_stage must be 'pre' or 'post'")
    aggregate = _method(method, variable, force)
    value: Column = clean(F.col("value")) if mask_stage == "pre" else F.col("value")
    joined = grid.join(mapped, ["lat_idx", "lon_idx"])
    if "weight" in mapped.columns:
        value = value * F.col("weight")
    out = joined.groupBy("BASIN_ID", *keys).agg(aggregate(value).alias("value"))
    return out.withColumn("value", clean(F.col("value"))) if mask_stage == "post" else out


def sample_steps(grid: DataFrame, every: int = 1, first: int | None = None) -> DataFrame:
    """Every n-th time step, of the first ones only if `first` is given.

    They filter what the scan yields; to read only the first steps of files, give the reader `steps`.
    """
    kept = grid.where(F.col("time_idx") < first) if first is not None else grid
    return kept.where(F.col("time_idx") % every == 0) if every > 1 else kept


def with_basins(basins: DataFrame, values: DataFrame, metadata: tuple[str, ...] = ("BASIN_ID", "BCU_name", "NAME", "REGION", "area_km2")) -> DataFrame:
    """Every basin's metadata with its values, NULL where it has none."""
    return basins.select(*[c for c in metadata if c in basins.columns]).join(values, "BASIN_ID", "left")


def annual(grid: DataFrame, mapped: DataFrame, basins: DataFrame, method: str = "sum", q: float = 0.1, fill: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """BASIN_ID, *keys, year, value in two stages: each cell over its year, then the basin's cells.

    sum: sum, then sum.  max: max, then max.  mean: mean, then mean.
    quantile: the q-quantile (linear), then mean.  meansd: mean of the cells'
    means plus mean of their standard deviations (population).
    A basin without cells, or without a value, has 0 in each year of the grid.
    fill stands for missing cells before either stage, as pipelines that replace
    them by 0 do; without it they are skipped.  keys (a run's, say) split the grid.
    """
    v = clean(F.col("value"))
    v = v if fill is None else F.coalesce(v, F.lit(float(fill)))
    stages = {
        "sum": (F.coalesce(F.sum("v"), F.lit(0.0)), F.sum("c")), "max": (F.max("v"), F.max("c")), "mean": (F.avg("v"), F.avg("c")),
        "quantile": (F.percentile("v", F.lit(q)), F.avg("c")), "meansd": (F.struct(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")), F.avg("c.m") + F.avg("c.s")),
    }
    if method not in stages:
        raise ValueError(f"method must be one of {sorted(stages)}")
    by_cell, by_basin = stages[method]
    rows = grid.select(*keys, "lat_idx", "lon_idx", F.year("date").cast("int").alias("year"), v.alias("v"))
    # Cells outside every basin go before anything is shuffled by cell.
    used = rows.join(mapped.select("lat_idx", "lon_idx").distinct(), ["lat_idx", "lon_idx"], "left_semi")
    cells = used.groupBy(*keys, "lat_idx", "lon_idx", "year").agg(by_cell.alias("c"))
    weighed = mapped.select("BASIN_ID", "lat_idx", "lon_idx", *(["weight"] if "weight" in mapped.columns else []))
    met = cells.join(weighed, ["lat_idx", "lon_idx"])
    if "weight" in mapped.columns:  # not negative, so that it goes through every first stage
        w = F.col("weight")
        met = met.withColumn("c", F.struct((F.col("c.m") * w).alias("m"), (F.col("c.s") * w).alias("s")) if method == "meansd" else F.col("c") * w)
    found = met.groupBy("BASIN_ID", *keys, "year").agg(by_basin.alias("value"))
    frame = basins.select("BASIN_ID").distinct().crossJoin(F.broadcast(rows.select(*keys, "year").distinct()))  # basins times runs times years
    return frame.join(found, ["BASIN_ID", *keys, "year"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
