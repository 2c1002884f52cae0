"""How well two methods' results agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _measures(a: str, b: str) -> list:
    x, y = F.col(a), F.col(b)
    relative = F.when(F.abs(x) > 0, F.abs(x - y) / F.abs(x))
    span = lambda c: F.max(c) - F.min(c)
    return [
        F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"), F.avg(relative).alias("mean_relative"), F.max(relative).alias("max_relative"),
        F.median(F.abs(x)).alias("median_scale"), F.when(span(x) > 0, span(y) / span(x)).alias("range_ratio"),
    ]


def agreement_metrics(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """One row: correlation, relative differences, median scale and ratio of ranges over common keys with both values."""
    return paired(a, b, keys, value).agg(*_measures("_a", "_b"))


def agreement_by_basin(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """The same per basin."""
    return paired(a, b, keys, value).groupBy("BASIN_ID").agg(*_measures("_a", "_b"))


def paired(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    left, right = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return left.join(right, list(keys)).dropna(subset=["_a", "_b"])
