"""Daily series to monthly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import mid_month, month, year

STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def monthly(daily: DataFrame, value: str, keys: tuple[str, ...], statistics: tuple[str, ...] = ("mean", "std", "min", "max")) -> DataFrame:
    """keys, year, month, one column a statistic, date (the month's 15th).

    Columns are {value}_{statistic}; of a single statistic, just {value}.  All
    statistics are exact, however the rows are split: partial aggregates carry
    moments, not means.  Rows with a null key go.
    """
    unknown = set(statistics) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    keys = tuple(k for k in keys if k in daily.columns)
    name = (lambda s: f"{value}_{s}") if len(statistics) > 1 else (lambda s: value)
    rows = daily.dropna(subset=[*keys, "date"]).select(*keys, year(F.col("date")).alias("year"), month(F.col("date")).alias("month"), F.col(value).alias("_v"))
    out = rows.groupBy(*keys, "year", "month").agg(*(STATISTICS[s]("_v").alias(name(s)) for s in statistics))
    return out.withColumn("date", mid_month(F.col("year"), F.col("month")))
