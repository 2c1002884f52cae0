"""Aggregates over the model ensemble, as plots and reports use them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_name
from ..functions.order import counted, with_quantiles

GROUPS = ("ssp_scenario", "climate_model", "hydro_model")


def _group(by: str) -> str:
    if by not in GROUPS:
        raise ValueError(f"group must be one of {GROUPS}")
    return by


def match_basins(panel: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """target, BASIN_ID, NAME: for each pattern the first basin whose name has it.

    Patterns are regular expressions, matched anywhere and without regard to
    case; NULL names never match; first means the smallest id.  Patterns that
    match nothing have no row.
    """
    names = panel.select("BASIN_ID", "NAME").dropDuplicates()
    hits = F.array(*[F.when(F.col("NAME").rlike(f"(?i){p}"), F.lit(p)) for p in patterns])
    rows = names.select("BASIN_ID", "NAME", F.explode(F.array_compact(hits)).alias("target"))
    first = rows.groupBy("target").agg(F.min(F.struct("BASIN_ID", "NAME")).alias("b"))
    return first.select("target", "b.BASIN_ID", "b.NAME")


def only_basins(panel: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows of the matched basins (one for each pattern at most)."""
    return panel.join(F.broadcast(matched.select("BASIN_ID").distinct()), "BASIN_ID", "left_semi")


def without_hydro_models(panel: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return panel.where(~F.col("hydro_model").isin(*names)) if names else panel


def years(panel: DataFrame, first: int = 2030, last: int = 2090) -> DataFrame:
    """Both ends count."""
    return panel.where(F.col("year").between(first, last))


def annual_means(panel: DataFrame, value: str) -> DataFrame:
    """Per basin, run and year: REGION and the mean."""
    keys = ("BASIN_ID", "NAME", "climate_model", "hydro_model", "ssp_scenario", "year")
    return panel.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("REGION").alias("REGION"), F.avg(value).alias(value))


def regional_annual(panel: DataFrame, value: str) -> DataFrame:
    """Per region, run and year the sum over basins and months; a region is named as a basin too."""
    keys = ("REGION", "climate_model", "ssp_scenario", "hydro_model", "year")
    out = panel.dropna(subset=list(keys)).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    return out.withColumns({"BASIN_ID": F.col("REGION"), "NAME": F.col("REGION")})


def regional_monthly(panel: DataFrame, value: str) -> DataFrame:
    """The same by month, with the month's first date."""
    keys = ("REGION", "climate_model", "ssp_scenario", "hydro_model", "year", "month")
    out = panel.dropna(subset=list(keys)).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value), F.min("date").alias("date"))
    return out.withColumns({"BASIN_ID": F.col("REGION"), "NAME": F.col("REGION")})


def monthly_rows(panel: DataFrame, value: str, matched: DataFrame | None = None) -> DataFrame:
    """The rows behind climatologies: with the month's short name, of the matched basins if given."""
    rows = only_basins(panel, matched) if matched is not None else panel
    columns = [c for c in ("BASIN_ID", "NAME", "REGION", *GROUPS, "date", "year", "month") if c in rows.columns]
    return rows.select(*columns, month_name(F.col("month")).alias("month_name"), value)


def _stats(value: str) -> list:
    return [F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"), F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max")]


def spread(panel: DataFrame, value: str, by: str) -> DataFrame:
    """Per basin, level and year: mean, std, min, max over the other dimensions."""
    keys = ("BASIN_ID", _group(by), "year")
    return panel.dropna(subset=list(keys)).groupBy(*keys).agg(*_stats(value))


def lines(panel: DataFrame, value: str, by: str) -> DataFrame:
    """Per basin, level and year: the mean."""
    keys = ("BASIN_ID", _group(by), "year")
    return panel.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value).alias(value))


def climatology(panel: DataFrame, value: str, by: str) -> DataFrame:
    """Per basin, level and month: mean, std, min, max, and the band mean -/+ std."""
    keys = ("BASIN_ID", _group(by), "month")
    out = panel.dropna(subset=list(keys)).groupBy(*keys).agg(*_stats(value))
    mean, std = F.col(f"{value}_mean"), F.coalesce(F.col(f"{value}_std"), F.lit(0.0))
    return out.withColumns({"band_low": mean - std, "band_high": mean + std, "month_name": month_name(F.col("month"))})


def box_stats(panel: DataFrame, value: str, by: str, reach: float = 1.5) -> DataFrame:
    """Per basin, level and month: quartiles (linear) and whiskers, the extreme data within reach * IQR of the box.

    One pass: values are counted before the shuffle, and all is read off each group's sorted run.
    """
    keys = ["BASIN_ID", _group(by), "month"]
    counts = counted(panel.dropna(subset=[*keys, value]), keys, value)
    boxed = with_quantiles(counts, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    away = reach * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - away, F.col("q3") + away)
    same = [F.min(c).alias(c) for c in ("q1", "median", "q3", "n")]
    return boxed.groupBy(*keys).agg(*same, F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"))


def heatmap(panel: DataFrame, value: str, basin: int | None = None, scenario: str | None = None, model: str | None = None) -> DataFrame:
    """Per basin and year, a column for each month's mean (m01 .. m12); of one basin, scenario, climate model if given."""
    rows = panel
    for column, wanted in (("BASIN_ID", basin), ("ssp_scenario", scenario), ("climate_model", model)):
        rows = rows.where(F.col(column) == wanted) if wanted is not None else rows
    return rows.groupBy("BASIN_ID", "year").agg(*(F.avg(F.when(F.col("month") == m, F.col(value))).alias(f"m{m:02d}") for m in range(1, 13)))


def heatmaps(panel: DataFrame, value: str, scenarios: tuple[str, ...] = (), models: tuple[str, ...] = ()) -> DataFrame:
    """The same for several scenarios and climate models at once (all, unless named): a row for each basin, scenario, model and year, in one pass."""
    keys = ("BASIN_ID", "ssp_scenario", "climate_model", "year")
    rows = panel.dropna(subset=list(keys))
    rows = rows.where(F.col("ssp_scenario").isin(*scenarios)) if scenarios else rows
    rows = rows.where(F.col("climate_model").isin(*models)) if models else rows
    return rows.groupBy(*keys).agg(*(F.avg(F.when(F.col("month") == m, F.col(value))).alias(f"m{m:02d}") for m in range(1, 13)))


def grouped_series(annual: DataFrame, value: str) -> DataFrame:
    """The spread over years by scenario, by climate model and by hydro model, in one pass: by, level, and `spread`'s columns."""
    rows = annual.dropna(subset=["BASIN_ID", "year"])
    levels = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("level")) for c in GROUPS]))
    each = rows.select("BASIN_ID", "year", value, levels.alias("_l")).select("BASIN_ID", "year", value, "_l.by", "_l.level")
    return each.dropna(subset=["level"]).groupBy("BASIN_ID", "by", "level", "year").agg(*_stats(value))


def variance_decomposition(annual: DataFrame, value: str) -> DataFrame:
    """Per basin: variance of the means by scenario, climate model, hydro model and year, as percentages of the total variance.

    0 with one level only or no variance; residual_pct = 100 - the four.
    """
    names = {"ssp": "ssp_scenario", "climate_model": "climate_model", "hydro_model": "hydro_model", "year": "year"}
    columns = list(names.values())
    # One pass: the whole basin and each factor's levels are grouping sets; _set has a bit for each column left out.
    sets = annual.groupingSets([["BASIN_ID"], *(["BASIN_ID", c] for c in columns)], "BASIN_ID", *columns)
    means = sets.agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.grouping_id().alias("_set"))
    n = len(columns)
    whole = 2**n - 1
    of = lambda k, c: F.var_samp(F.when((F.col("_set") == whole - 2 ** (n - 1 - k)) & F.col(c).isNotNull(), F.col("_m")))
    parts = [F.coalesce(of(k, c), F.lit(0.0)).alias(f"{short}_variance") for k, (short, c) in enumerate(names.items())]
    out = means.groupBy("BASIN_ID").agg(F.max(F.when(F.col("_set") == whole, F.col("_v"))).alias("total_variance"), *parts)
    total = F.col("total_variance")
    share = lambda s: F.when(total > 0, F.coalesce(F.col(f"{s}_variance"), F.lit(0.0)) / total * 100).otherwise(0.0)
    out = out.withColumns({f"{s}_pct": share(s) for s in names})
    rest = 100.0 - sum((F.col(f"{s}_pct") for s in names), F.lit(0.0))
    return out.withColumns({"residual_pct": rest, "log10_total": F.when(total >= 0, F.log10(total + 1))})


def pattern_of(name: str) -> str:
    """A pattern that matches the name itself."""
    return re.escape(name)
