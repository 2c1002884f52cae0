"""Wide tables to the long panel and back, and the seam between history and future."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month, year
from ..schema import METADATA, RUN

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")


def date_columns(columns: list[str]) -> list[str]:
    """Columns named by an ISO date, in order."""
    return sorted(c for c in columns if _DATE.match(c))


def to_long(wide: DataFrame, value: str, ids: tuple[str, ...] | None = None) -> DataFrame:
    """One row per id and date column: ids, date, value, year, month; rows without a value go.

    ids that the table lacks are left out.  For tables of many thousand date
    columns use `sources.wide_csv` instead, which never makes a column of each.
    """
    dates = date_columns(wide.columns)
    if not dates:
        raise ValueError("the table has no column named by a date")
    ids = tuple(c for c in ids or (*METADATA, *RUN) if c in wide.columns)
    cast = wide.select(*ids, *(F.col(f"`{c}`").cast("double").alias(c) for c in dates))
    long = cast.unpivot(list(ids), [f"`{c}`" for c in dates], "date", value)
    long = long.withColumn("date", F.to_date(F.replace(F.col("date"), F.lit("`"), F.lit(""))))
    return long.dropna(subset=[value]).withColumns({"year": year(F.col("date")), "month": month(F.col("date"))})


def to_wide(long: DataFrame, value: str, dates: list[str], ids: tuple[str, ...] = METADATA) -> DataFrame:
    """One column per date (given, so no extra pass looks for them)."""
    ids = tuple(c for c in ids if c in long.columns)
    return long.groupBy(*ids).pivot("date", dates).agg(F.first(value, ignorenulls=True))


def join_history(history: DataFrame, future: DataFrame) -> DataFrame:
    """History once per scenario of the future, then the future: one series per scenario.

    `data_period` tells the two apart.  Without a future, history keeps the
    scenario it has.  The distinct scenarios are a handful of rows.
    """
    tagged = future.withColumn("data_period", F.lit("future"))
    scenarios = future.select("ssp_scenario").where(F.col("ssp_scenario").isNotNull()).distinct()
    past = history.withColumn("data_period", F.lit("historical"))
    own = past.select("ssp_scenario").limit(1) if "ssp_scenario" in history.columns else None
    if own is None:
        spread = past.crossJoin(F.broadcast(scenarios))
    else:
        # A null stands for "as it is" and is there only where no scenario is.
        names = scenarios.agg(F.collect_set("ssp_scenario").alias("_names"))
        spread = past.crossJoin(F.broadcast(names)).withColumn("ssp_scenario", F.explode(F.when(F.size("_names") > 0, F.col("_names")).otherwise(F.array("ssp_scenario")))).drop("_names")
    return spread.unionByName(tagged, allowMissingColumns=True)


def concat_runs(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are NULL."""
    if not frames:
        raise FileNotFoundError("no run to concatenate")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def levels(panel: DataFrame, columns: tuple[str, ...] = RUN) -> DataFrame:
    """One row: the sorted distinct levels of each column, and their number."""
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in columns]
    return panel.agg(*sets).select(*columns, *(F.size(c).cast("long").alias(f"n_{c}") for c in columns))
