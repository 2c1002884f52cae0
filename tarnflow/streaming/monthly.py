"""Monthly statistics of a growing daily panel (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import mid_month, month, year


def monthly_stream(daily: DataFrame, value: str, keys: tuple[str, ...], lateness: str = "40 days") -> DataFrame:
    """Daily moments of a streaming panel with a DATE column `date`; `finish_months` makes months of them.

    Rows may come late by `lateness`; in append mode a day comes out once, when
    the watermark has passed it, and its state goes.
    """
    stamped = daily.withColumn("_ts", F.col("date").cast("timestamp")).withWatermark("_ts", lateness)
    # Windows have a fixed length; a window of one day carries the event time, months are keys beside it.
    v = F.col(value).cast("double")
    by_day = stamped.groupBy(F.window("_ts", "1 day").alias("_w"), *keys).agg(F.count(v).alias("n"), F.sum(v).alias("s"), (F.var_pop(v) * F.count(v)).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))
    day = F.to_date(F.col("_w.start"))
    return by_day.select(*keys, day.alias("date"), year(day).alias("year"), month(day).alias("month"), "n", "s", "squares", "low", "high")


def finish_months(days: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Daily moments (what `monthly_stream` has written) to {value}_mean, _std, _min, _max by month.

    squares are about the day's own mean, and days are shifted to the month's: no large sums cancel.
    """
    months = [*keys, "year", "month"]
    n, s = F.sum("n"), F.sum("s")
    month_mean = F.when(n.over(Window.partitionBy(*months)) > 0, s.over(Window.partitionBy(*months)) / n.over(Window.partitionBy(*months)))
    away = F.when(F.col("n") > 0, F.col("s") / F.col("n")) - month_mean
    shifted = days.withColumn("_squares", F.col("squares") + F.col("n") * away * away)
    spread = F.when(n > 1, F.sqrt(F.sum("_squares") / (n - 1)))
    out = shifted.groupBy(*months).agg(
        F.when(n > 0, s / n).alias(f"{value}_mean"), spread.alias(f"{value}_std"), F.min("low").alias(f"{value}_min"), F.max("high").alias(f"{value}_max"),
    )
    return out.withColumn("date", mid_month(F.col("year"), F.col("month")))
