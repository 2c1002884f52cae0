"""Order statistics from counted values: equal values meet before the shuffle, then one sorted run tells all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _v, _n: how often each value occurs in each group."""
    return rows.select(*keys, F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))


def with_quantiles(counts: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """counts with each group's quantiles (linear between neighbours) and its number of values, `n`.

    A group's distinct values are sorted once; the value of rank r (from 0) is the
    first whose running count exceeds r.
    """
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumns({"_upto": F.sum("_n").over(run), "n": F.sum("_n").over(whole)})

    def ranked(r: Column) -> Column:
        return F.min(F.when(F.col("_upto") > r, F.col("_v"))).over(whole)

    for name, q in quantiles.items():
        place = (F.col("n") - 1) * q
        low, high = ranked(F.floor(place)), ranked(F.ceil(place))
        out = out.withColumns({"_low": low, "_high": high})
        out = out.withColumn(name, F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place))).drop("_low", "_high")
    return out.drop("_upto")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median."""
    return with_quantiles(counted(rows, keys, value), keys, {"median": 0.5}).groupBy(*keys).agg(F.min("median").alias("median"))
