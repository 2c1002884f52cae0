"""Outlet cells: where a basin's discharge is largest, and whether that place moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean


def outlets(grid: DataFrame, mapped: DataFrame, key: str = "time_idx") -> DataFrame:
    """BASIN_ID, key, lat_idx, lon_idx, value: the cell of the largest value; ties to the first by row, then column.

    With a map that has `contained` (see `geo.cell_basin`), contained cells win
    ties over merely touched ones.
    """
    prefer = [F.col("contained").cast("int")] if "contained" in mapped.columns else []
    v = clean(F.col("value"))
    cells = grid.withColumn("value", v).where(F.col("value").isNotNull()).join(mapped, ["lat_idx", "lon_idx"])
    rank = F.struct(F.col("value"), *prefer, -F.col("lat_idx"), -F.col("lon_idx"))
    best = cells.groupBy("BASIN_ID", key).agg(F.max_by(F.struct("lat_idx", "lon_idx", "value"), rank).alias("o"))
    return best.select("BASIN_ID", key, "o.lat_idx", "o.lon_idx", "o.value")


def stability(found: DataFrame, basins: DataFrame) -> DataFrame:
    """Per basin: status (empty, fixed or moving), its places, the range of its maxima, observations."""
    per = found.groupBy("BASIN_ID").agg(
        F.array_sort(F.collect_set(F.struct("lat_idx", "lon_idx"))).alias("unique_locations"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n_observations"),
    )
    all_ = basins.select("BASIN_ID").join(per, "BASIN_ID", "left")
    places = F.coalesce(F.size("unique_locations"), F.lit(0))
    places = F.when(F.col("unique_locations").isNull(), 0).otherwise(places)
    status = F.when(places == 0, "empty").when(places == 1, "fixed").otherwise("moving")
    return all_.select("BASIN_ID", status.alias("status"), places.cast("int").alias("n_unique_locations"), "unique_locations", "min_value", "max_value", F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"))


def stability_summary(report: DataFrame, method: str = "") -> DataFrame:
    """One row: counts and percentages (of all basins) by status."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long")
    share = lambda c: F.when(F.col("total_basins") > 0, 100.0 * F.col(c) / F.col("total_basins"))
    counts = report.agg(F.count("*").alias("total_basins"), *(F.coalesce(count(s), F.lit(0)).alias(f"{s}_basins") for s in ("fixed", "moving", "empty")))
    return counts.select(F.lit(method).alias("method"), "*", share("fixed_basins").alias("fixed_pct"), share("moving_basins").alias("moving_pct"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """BASIN_ID, agree: whether two reports have the same set of places, for basins that both have."""
    places = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<struct<lat_idx:int,lon_idx:int>>")))
    left = a.select("BASIN_ID", F.col("unique_locations").alias("_a"))
    right = b.select("BASIN_ID", F.col("unique_locations").alias("_b"))
    return left.join(right, "BASIN_ID").select("BASIN_ID", (places("_a") == places("_b")).alias("agree"))


def agreement_summary(compared: DataFrame) -> DataFrame:
    agree: Column = F.sum(F.col("agree").cast("int"))
    n = F.count("*")
    return compared.agg(n.alias("n_basins"), F.coalesce(agree, F.lit(0)).cast("long").alias("n_agree"), F.when(n > 0, 100.0 * agree / n).alias("agree_pct"))
