"""Ordinary least squares and Type-II analysis of variance, basin by basin.

The panel is first summed into cells of equal factor levels (count, mean, squares
about the mean): least squares needs no more, and nothing cancels where means are
large.  So the data are aggregated before the shuffle and a basin's group is bounded
by the number of level combinations.  Each group's cross products are then swept,
term by term: what is left of the target's own is the residual.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACTORS = ("ssp_scenario", "climate_model", "hydro_model", "month")
BASE = (("ssp_scenario",), ("climate_model",), ("hydro_model",), ("month",), ("year",), ("ssp_scenario", "climate_model"), ("ssp_scenario", "year"))
SEASONAL = (*BASE, ("month", "ssp_scenario"))
LEAST = 150


def terms_of(target: str) -> tuple[tuple[str, ...], ...]:
    """The monthly means' own target also has month by scenario."""
    return SEASONAL if target == "qtot_mean" else BASE


def term_name(term: tuple[str, ...]) -> str:
    return "_x_".join(term)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def f_survival(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if not (f == f) or df1 <= 0 or df2 <= 0:
        return math.nan
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def _coded(cells: pd.DataFrame, name: str) -> np.ndarray:
    """Treatment coding of a factor; a number is centred."""
    if name == "year":
        y = cells["year"].to_numpy(float)
        return (y - y.mean())[:, None]
    codes, names = pd.factorize(cells[name], sort=True)
    return (codes[:, None] == np.arange(1, len(names))[None, :]).astype(float)


def _design(cells: pd.DataFrame, term: tuple[str, ...]) -> np.ndarray:
    block = _coded(cells, term[0])
    for name in term[1:]:
        other = _coded(cells, name)
        block = (block[:, :, None] * other[:, None, :]).reshape(len(cells), -1)
    return block


#: A column of which the sweep has left less than this share is a combination of those before.
_LEFT = 1e-9


def sweep(products: np.ndarray, columns: list[int], first: np.ndarray) -> tuple[np.ndarray, int]:
    """Cross products after taking the columns out of all others, and how many of them were independent.

    first: the diagonal before any sweep.
    """
    rank = 0
    for k in columns:
        if products[k, k] > _LEFT * first[k]:
            products = products - np.outer(products[:, k], products[k]) / products[k, k]
            rank += 1
    return products, rank


def fit_cells(cells: pd.DataFrame, terms: tuple[tuple[str, ...], ...]) -> dict:
    """Sums of squares (Type II), degrees of freedom, p-values and R2 from cells with n, mean, css (squares about the mean)."""
    n, mean, css = (cells[c].to_numpy(float) for c in ("n", "mean", "css"))
    total, within = n.sum(), float(css.sum())
    origin = mean[0]
    middle = origin + float((n * (mean - origin)).sum() / total)
    y = mean - middle
    blocks = {t: _design(cells, t) for t in terms}
    ends = np.cumsum([1, *(b.shape[1] for b in blocks.values())])
    columns = {t: list(range(a, b)) for t, a, b in zip(terms, ends, ends[1:])}
    x = np.concatenate([np.ones((len(cells), 1)), *blocks.values(), y[:, None]], axis=1)
    products = x.T @ (x * n[:, None])
    first = np.diagonal(products).copy()
    products, _ = sweep(products, [0], first)
    centre = products[-1, -1] + within
    full, rank = sweep(products, [k for t in terms for k in columns[t]], first)
    residual, df_rest = max(full[-1, -1], 0.0) + within, total - 1 - rank
    table = {}
    for t in terms:
        rest = [k for u in terms if u != t and not set(t) < set(u) for k in columns[u]]
        without, _ = sweep(products, rest, first)
        own, df = sweep(without, columns[t], first)
        table[t] = max(without[-1, -1] - own[-1, -1], 0.0), df
    scale = residual / df_rest if df_rest > 0 else math.nan
    p = {t: f_survival((q / d) / scale if d > 0 and scale > 0 else math.nan, d, df_rest) for t, (q, d) in table.items()}
    return {"table": table, "residual": residual, "df_residual": df_rest, "p": p, "r2": 1 - residual / centre if centre > 0 else math.nan, "n": int(total), "mean": middle, "std": math.sqrt(centre / (total - 1)) if total > 1 else math.nan}


def anova(panel: DataFrame, target: str, model_name: str = "base", terms: tuple[tuple[str, ...], ...] | None = None, least: int = LEAST) -> DataFrame:
    """One row per basin: share of each term's sum of squares, its p-value, R2, residual share.

    Basins with fewer than `least` values, or with one level only of scenario,
    climate or hydro model, have no row (`skipped` lists them).  Shares are of
    the sum of all terms' squares and the residual.
    """
    terms = terms or terms_of(target)
    rows = panel.dropna(subset=[target, "BASIN_ID", *FACTORS, "year"])
    v = F.col(target).cast("double")
    cells = rows.groupBy("BASIN_ID", *FACTORS, "year").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("css"), F.min("NAME").alias("basin_name"), F.min("REGION").alias("region"),
        (F.min("area_km2") if "area_km2" in panel.columns else F.min(F.lit(None).cast("double"))).alias("area_km2"),
    )
    names = [term_name(t) for t in terms]
    least_of = lambda c: c.dropna().min() if c.notna().any() else None

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if group["n"].sum() < least or any(group[c].nunique() < 2 for c in FACTORS[:3]):
            return pd.DataFrame()
        out = fit_cells(group.sort_values([*FACTORS, "year"]), terms)
        total = sum(q for q, _ in out["table"].values()) + out["residual"]
        row = {"basin_id": group["BASIN_ID"].iloc[0], "basin_name": least_of(group["basin_name"]), "region": least_of(group["region"]), "area_km2": least_of(group["area_km2"]), "n_observations": out["n"], "r_squared": out["r2"], "temporal_model": model_name, "mean_value": out["mean"], "std_value": out["std"]}
        for t, name in zip(terms, names):
            row[f"{name}_pct"] = 100 * out["table"][t][0] / total if total > 0 else 0.0
            row[f"{name}_pvalue"] = out["p"][t]
        row["residual_pct"] = 100 * out["residual"] / total if total > 0 else 0.0
        return pd.DataFrame([row])

    schema = "basin_id long, basin_name string, region string, area_km2 double, n_observations long, r_squared double, temporal_model string, mean_value double, std_value double, " + ", ".join(f"`{n}_pct` double, `{n}_pvalue` double" for n in names) + ", residual_pct double"
    return cells.withColumn("BASIN_ID", F.col("BASIN_ID").cast("long")).groupBy("BASIN_ID").applyInPandas(one, schema)


def skipped(panel: DataFrame, target: str, least: int = LEAST) -> DataFrame:
    """BASIN_ID, reason for the basins that `anova` leaves out."""
    rows = panel.dropna(subset=["BASIN_ID"])
    used = F.col(target).isNotNull() & F.col("year").isNotNull()
    for c in FACTORS:
        used = used & F.col(c).isNotNull()
    about = rows.groupBy("BASIN_ID").agg(F.count(F.when(used, 1)).alias("n"), *(F.count_distinct(F.when(used, F.col(c))).alias(c) for c in FACTORS[:3]))
    reason = F.when(F.col("n") < least, F.lit("too few values"))
    for c in FACTORS[:3]:
        reason = reason.when(F.col(c) < 2, F.lit(f"one level of {c}"))
    return about.select("BASIN_ID", reason.alias("reason")).where("reason IS NOT NULL")


def _shares(results: DataFrame) -> list[str]:
    return [c for c in results.columns if c.endswith("_pct")]


def summary(results: DataFrame) -> DataFrame:
    """metric (Mean, Median, Std Dev, Min, Max) by one column for each share, in one pass."""
    shares = _shares(results)
    made = {"Mean": F.avg, "Median": F.median, "Std Dev": F.stddev_samp, "Min": F.min, "Max": F.max}
    rows = [F.struct(F.lit(name).alias("metric"), *(f(c).alias(c) for c in shares)) for name, f in made.items()]
    return results.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def pretty(term: str) -> str:
    """ssp_scenario_x_year -> SSP Scenario × Year."""
    return " × ".join(" ".join("SSP" if w == "ssp" else w.title() for w in part.split("_")) for part in term.split("_x_"))


def significance(results: DataFrame, level: float = 0.05) -> DataFrame:
    """factor, significant_basins, total_basins, percentage_significant; a missing p-value isn't significant."""
    names = [c.removesuffix("_pvalue") for c in results.columns if c.endswith("_pvalue")]
    n = F.count("*")

    def row(t: str):
        p = F.col(f"{t}_pvalue")
        hits = F.coalesce(F.sum(F.when(~F.isnan(p) & (p < level), 1).otherwise(0)), F.lit(0)).cast("long")
        return F.struct(F.lit(pretty(t)).alias("factor"), hits.alias("significant_basins"), n.alias("total_basins"), F.when(n > 0, 100.0 * hits / n).alias("percentage_significant"))

    return results.agg(F.array(*map(row, names)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def report(results: DataFrame, level: float = 0.05) -> DataFrame:
    """factor, kind (main or interaction), mean and deviation of its share over basins, percentage of basins where it is significant; one pass."""
    names = [c.removesuffix("_pvalue") for c in results.columns if c.endswith("_pvalue")]
    n = F.count("*")

    def row(t: str):
        p = F.col(f"{t}_pvalue")
        hits = F.sum(F.when(~F.isnan(p) & (p < level), 1).otherwise(0))
        kind = "interaction" if "_x_" in t else "main"
        return F.struct(F.lit(pretty(t)).alias("factor"), F.lit(kind).alias("kind"), F.avg(f"{t}_pct").alias("mean_pct"), F.stddev_samp(f"{t}_pct").alias("std_pct"), F.when(n > 0, 100.0 * hits / n).alias("percentage_significant"))

    return results.agg(F.array(*map(row, names)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def compare_models(results: list[DataFrame]) -> DataFrame:
    """Per temporal model: mean share of scenario by year, mean R2, number of basins."""
    kept = [r.select("temporal_model", F.col("ssp_scenario_x_year_pct"), "r_squared") for r in results]
    out = kept[0]
    for r in kept[1:]:
        out = out.unionByName(r)
    return out.groupBy("temporal_model").agg(F.avg("ssp_scenario_x_year_pct").alias("mean_ssp_x_year_pct"), F.avg("r_squared").alias("mean_r_squared"), F.count("*").alias("n_basins"))


def one_way(panel: DataFrame, target: str, factor: str) -> DataFrame:
    """Per basin, without Python: sums of squares between and within the factor's levels, and F."""
    rows = panel.dropna(subset=["BASIN_ID", factor, target])
    v = F.col(target).cast("double")
    by_level = rows.groupBy("BASIN_ID", factor).agg(F.count("*").alias("n"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count("*")).alias("_within"))
    # Squares of differences, not differences of squares: those cancel where means are large.
    basin = Window.partitionBy("BASIN_ID")
    about = F.col("_mean") - F.sum(F.col("n") * F.col("_mean")).over(basin) / F.sum("n").over(basin)
    out = by_level.withColumn("_between", F.col("n") * about * about).groupBy("BASIN_ID").agg(
        F.sum("n").alias("n"), F.count("*").alias("levels"), F.sum("_between").alias("ss_between"), F.sum("_within").alias("ss_within"),
    )
    f = (F.col("ss_between") / (F.col("levels") - 1)) / (F.col("ss_within") / (F.col("n") - F.col("levels")))
    return out.withColumn("f", F.when((F.col("levels") > 1) & (F.col("n") > F.col("levels")) & (F.col("ss_within") > 0), f))
