"""Registered queries of the ensemble engine, each with its DuckDB equivalent.

The operators work on grids and panels.  The driver's tables stand in for them:

* panel: lineitem with supplier, nation, region and orders; a basin is a nation,
  the value l_quantity; history ends with 1997;
* grid: embeddings as 8 x 8 cells and one month per row, with four polygons;
* daily series: events by user and day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.cells import clean, missing_share, to_volume, zero_if_missing
from .functions.dates import decode_time, month_name
from .functions.naming import parse_run_file
from .operators import anova as av
from .operators import compare, ensemble, outlet, panel as pn, rolling, zonal
from .operators.geo import cell_basin, with_weights
from .operators.monthly import monthly
from .plans import jobs
from .session import scratch
from .sources import sinks, wide_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_KEYS = ("BASIN_ID", "NAME", "REGION", "hydro_model", "climate_model", "ssp_scenario")
_SEAM = 1998


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None, name: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query; its date columns come out as ISO text on both sides, which compares the same everywhere."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in dates})) if dates else f
        if sql is not None:
            replaced = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            ORACLE_SQL[key] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) q" if dates else sql
        return f

    return register


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def literals(spark: SparkSession, rows: list[dict[str, Column]]) -> DataFrame:
    """A small constant table, as one expression."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*(c.alias(k) for k, c in r.items())) for r in rows])))


# Panel ------------------------------------------------------------------------------------------

_PANEL = """
panel AS (
  SELECT CAST(s.s_nationkey AS BIGINT) AS BASIN_ID, n.n_name AS NAME, r.r_name AS REGION, l.l_returnflag AS hydro_model,
         o.o_orderpriority AS climate_model, l.l_linestatus AS ssp_scenario, CAST(l.l_shipdate AS DATE) AS date,
         CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(month(l.l_shipdate) AS INTEGER) AS month, l.l_quantity AS qtot
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
monthly AS (
  SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month, avg(qtot) AS qtot_mean,
         stddev_samp(qtot) AS qtot_std, min(qtot) AS qtot_min, max(qtot) AS qtot_max, make_date(year, month, 15) AS date
  FROM panel GROUP BY BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month)"""

_JOINED = _PANEL + f""",
past AS (
  SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, year, month, avg(qtot) AS qtot, make_date(year, month, 15) AS date
  FROM panel WHERE year < {_SEAM} GROUP BY BASIN_ID, NAME, REGION, hydro_model, climate_model, year, month),
later AS (
  SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month, avg(qtot) AS qtot, make_date(year, month, 15) AS date
  FROM panel WHERE year >= {_SEAM} GROUP BY BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month),
joined AS (
  SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, s.ssp_scenario, year, month, qtot, date, 'historical' AS data_period
  FROM past CROSS JOIN (SELECT DISTINCT ssp_scenario FROM later) s
  UNION ALL SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month, qtot, date, 'future' FROM later)"""

_ROLLED = _JOINED + """,
rolled AS (
  SELECT *, CASE WHEN count(qtot) OVER a = 6 THEN avg(qtot) OVER a END AS qtot_6m, CASE WHEN count(qtot) OVER b = 12 THEN avg(qtot) OVER b END AS qtot_12m
  FROM joined
  WINDOW a AS (PARTITION BY BASIN_ID, hydro_model, climate_model, ssp_scenario ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY BASIN_ID, hydro_model, climate_model, ssp_scenario ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in panel; the small dimension tables broadcast by their measured size."""
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    basins = nation.join(region, nation.n_regionkey == region.r_regionkey)
    places = supplier.join(basins, supplier.s_nationkey == basins.n_nationkey).select("s_suppkey", F.col("s_nationkey").cast("long").alias("BASIN_ID"), F.col("n_name").alias("NAME"), F.col("r_name").alias("REGION"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = lines.join(places, lines.l_suppkey == places.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    date = F.to_date("l_shipdate")
    return rows.select(
        "BASIN_ID", "NAME", "REGION", F.col("l_returnflag").alias("hydro_model"), F.col("o_orderpriority").alias("climate_model"), F.col("l_linestatus").alias("ssp_scenario"),
        date.alias("date"), F.year(date).cast("int").alias("year"), F.month(date).cast("int").alias("month"), F.col("l_quantity").alias("qtot"),
    )


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(daily_panel(spark, sf_dir), "qtot", _KEYS)


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    daily = daily_panel(spark, sf_dir)
    past = monthly(daily.where(F.col("year") < _SEAM), "qtot", _KEYS[:-1], ("mean",))
    later = monthly(daily.where(F.col("year") >= _SEAM), "qtot", _KEYS, ("mean",))
    return past, later


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.join_history(*_periods(spark, sf_dir))


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_means(_joined(spark, sf_dir), "qtot", {"6m": 6, "12m": 12})


@_query(f"WITH {_PANEL} SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month, round(qtot_mean, 6) AS qtot_mean, round(qtot_std, 6) AS qtot_std, qtot_min, qtot_max, date FROM monthly", dates=("date",))
def monthly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_monthly(spark, sf_dir), "qtot_mean", "qtot_std")


_WIDE_KEYS = ("BASIN_ID", "NAME", "REGION")
_BY_MONTH = f"WITH {_PANEL} SELECT BASIN_ID, NAME, REGION, make_date(year, month, 15) AS date, max(qtot) AS qtot, year, month FROM panel GROUP BY BASIN_ID, NAME, REGION, year, month"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.wide_lines(monthly(daily_panel(spark, sf_dir), "qtot", _WIDE_KEYS, ("max",)), "qtot", None, _WIDE_KEYS)


def _lines_sql(cells: str, ids: tuple[str, ...], label: str, tail: str = "", tail_names: str = "", order: str = "k") -> str:
    """Lines of a wide table in SQL, from cells (ids, k, v as text): a cell for each id and each k that there is."""
    key, line = ", ".join(ids), " || ',' || ".join(ids)
    return f"""WITH c AS ({cells}), ks AS (SELECT DISTINCT k FROM c WHERE k IS NOT NULL), ids AS (SELECT DISTINCT {key} FROM c)
SELECT {key}, '{",".join(ids)}' || (SELECT coalesce(',' || string_agg({label}, ',' ORDER BY {order}), '') FROM ks) || '{tail_names}' AS header,
{line} || coalesce(',' || string_agg(coalesce(v, ''), ',' ORDER BY {order}), '') || '{tail}' AS line FROM ids CROSS JOIN ks LEFT JOIN c USING ({key}, k) GROUP BY {key}"""


# A cell for each month, step or year that the panel has, as the lines of the files: no column is made of a date.
@_query(_lines_sql(f"SELECT BASIN_ID, NAME, REGION, CAST(date AS VARCHAR) AS k, CAST(qtot AS VARCHAR) AS v FROM ({_BY_MONTH})", _WIDE_KEYS, "k"))
def wide_basin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


@_query(_BY_MONTH, dates=("date",))
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_csv.lines_to_long(_wide(spark, sf_dir).select("header", "line"), "qtot", _WIDE_KEYS)


@_query(_lines_sql(f"""SELECT BASIN_ID, dense_rank() OVER (ORDER BY year, month) AS k, CAST(CAST(qtot AS DECIMAL(18, 6)) AS VARCHAR) AS v
FROM (WITH {_PANEL} SELECT BASIN_ID, year, month, round(avg(qtot), 6) AS qtot FROM panel GROUP BY BASIN_ID, year, month)""", ("BASIN_ID",), "'timestep_' || k"))
def timestep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps are months counted from the first: the panel has one for each."""
    by_basin = _round(monthly(daily_panel(spark, sf_dir), "qtot", ("BASIN_ID",), ("mean",)), "qtot")
    steps = by_basin.withColumns({"time_idx": F.dense_rank().over(Window.orderBy("date")) - 1, "qtot": F.col("qtot").cast("decimal(18, 6)")})  # basins times months
    return sinks.wide_lines(steps, "qtot", None, ("BASIN_ID",), "time_idx", label=sinks.step_name)


_ABOUT = {"Model": "CWatM", "Scenario": "historical", "Variable": "qtot", "Region": "R12", "Unit": "km3/year"}


@_query(_lines_sql(f"""SELECT CAST(n_nationkey AS BIGINT) AS BASIN_ID, n_name AS BCU_name, CAST(year AS VARCHAR) AS k, CAST(qtot AS VARCHAR) AS v
FROM nation LEFT JOIN (WITH {_PANEL} SELECT BASIN_ID AS basin, year, sum(qtot) AS qtot FROM panel GROUP BY BASIN_ID, year) ON n_nationkey = basin""",
                   ("BASIN_ID", "BCU_name"), "k", "".join("," + v for v in _ABOUT.values()), "".join("," + k for k in _ABOUT)))
def annual_wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = daily_panel(spark, sf_dir).groupBy("BASIN_ID", "year").agg(F.sum("qtot").alias("value"))
    basins = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("BASIN_ID"), F.col("n_name").alias("BCU_name"))
    return sinks.annual_lines(annual, basins, _ABOUT)


_RUN_FILES = f"""SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, make_date(year, month, 15) AS date, max(qtot) AS qtot, year, month FROM (WITH {_PANEL} SELECT * FROM panel)
GROUP BY BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month"""


@_query(_RUN_FILES, dates=("date",))
def wide_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide file for each run of the panel, written to the shared folder; all read back by one scan."""
    by_run = monthly(daily_panel(spark, sf_dir), "qtot", _KEYS, ("max",))
    folder = sinks.write_run_lines(by_run, "qtot", scratch(spark, "runs"), "qtot", "monthly", "all", _WIDE_KEYS)
    models = tuple(r[0] for r in _table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect())  # a handful
    return wide_csv.read_runs(spark, folder, "qtot", _WIDE_KEYS, models)


@_query(f"WITH {_JOINED} SELECT BASIN_ID, NAME, REGION, hydro_model, climate_model, ssp_scenario, year, month, round(qtot, 6) AS qtot, date, data_period FROM joined", dates=("date",))
def union_hist_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_joined(spark, sf_dir), "qtot")


@_query(f"WITH {_ROLLED} SELECT BASIN_ID, hydro_model, climate_model, ssp_scenario, date, data_period, round(qtot_6m, 6) AS qtot_6m, round(qtot_12m, 6) AS qtot_12m FROM rolled", dates=("date",))
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_rolled(spark, sf_dir).select("BASIN_ID", "hydro_model", "climate_model", "ssp_scenario", "date", "data_period", "qtot_6m", "qtot_12m"), "qtot_6m", "qtot_12m")


@_query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, round(sum(value), 6) AS value FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, date, round(CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END, 5) AS value_7d FROM d
WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", dates=("date",))
def rolling_mean_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 6).alias("value"))
    out = rolling.rolling_means(events, "value", {"7d": 7}, ("user_id",), method="blocks")
    return out.select("user_id", "date", F.round("value_7d", 5).alias("value_7d"))


@_query(f"""WITH {_JOINED} SELECT BASIN_ID, hydro_model, climate_model, ssp_scenario, date, year BETWEEN 1995 AND 1996 AS period_1995_1996, year BETWEEN 1997 AND 1998 AS period_1997_1998,
year BETWEEN 1999 AND 2001 AS period_1999_2001, CAST(floor(year / 10.0) * 10 AS INTEGER) AS decade FROM joined""", dates=("date",))
def period_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = rolling.with_periods(_joined(spark, sf_dir), ((1995, 1996), (1997, 1998), (1999, 2001)))
    return flagged.select("BASIN_ID", "hydro_model", "climate_model", "ssp_scenario", "date", "period_1995_1996", "period_1997_1998", "period_1999_2001", "decade")


@_query(f"WITH {_ROLLED} SELECT BASIN_ID, hydro_model, climate_model, ssp_scenario, date, round(qtot_12m, 6) AS qtot_12m FROM rolled WHERE year >= {_SEAM} AND ssp_scenario IN ('F')", dates=("date",))
def future_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rolling.future_means(*_periods(spark, sf_dir), "qtot", {"12m": 12}, _SEAM, ("F",))
    return _round(kept.select("BASIN_ID", "hydro_model", "climate_model", "ssp_scenario", "date", "qtot_12m"), "qtot_12m")


@_query(f"WITH {_ROLLED} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", min(year) FILTER (WHERE {c} IS NOT NULL) AS first_year, max(year) FILTER (WHERE {c} IS NOT NULL) AS last_year, count({c}) AS n_values,
min(year) FILTER (WHERE {c} IS NOT NULL AND year >= {_SEAM}) AS first_future_year, max(year) FILTER (WHERE {c} IS NOT NULL AND year >= {_SEAM}) AS last_future_year, count({c}) FILTER (WHERE year >= {_SEAM}) AS n_future_values FROM rolled""" for c in ("qtot_6m", "qtot_12m")))
def rolling_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.availability(_rolled(spark, sf_dir), ("qtot_6m", "qtot_12m"), _SEAM)


# Ensemble ---------------------------------------------------------------------------------------

_TARGETS = ("nation_1", "N_2$", "^n.*7$", "nowhere")


@_query(f"WITH {_PANEL}, t AS (SELECT unnest(['nation_1', 'N_2$', '^n.*7$', 'nowhere']) AS target), m AS (SELECT DISTINCT target, BASIN_ID, NAME FROM panel JOIN t ON regexp_matches(NAME, target, 'i')) "
        "SELECT target, BASIN_ID, NAME FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY BASIN_ID) AS k FROM m) WHERE k = 1")
def basin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.match_basins(daily_panel(spark, sf_dir), _TARGETS)


@_query(f"WITH {_PANEL} SELECT BASIN_ID, date, count(*) AS n FROM panel WHERE BASIN_ID IN (SELECT min(BASIN_ID) FROM panel WHERE regexp_matches(NAME, 'ation_3', 'i')) AND hydro_model NOT IN ('N') AND year BETWEEN 1996 AND 1999 GROUP BY BASIN_ID, date", dates=("date",))
def basin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = ensemble.without_hydro_models(daily_panel(spark, sf_dir), ("N",))
    kept = ensemble.only_basins(panel, ensemble.match_basins(daily_panel(spark, sf_dir), ("ation_3",)))
    return ensemble.years(kept, 1996, 1999).groupBy("BASIN_ID", "date").agg(F.count("*").alias("n"))


_ANNUAL = _PANEL + """,
annual AS (SELECT BASIN_ID, NAME, climate_model, hydro_model, ssp_scenario, year, min(REGION) AS REGION, avg(qtot_mean) AS qtot FROM monthly GROUP BY BASIN_ID, NAME, climate_model, hydro_model, ssp_scenario, year)"""


def _annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.annual_means(_monthly(spark, sf_dir).withColumnRenamed("qtot_mean", "qtot"), "qtot")


@_query(f"WITH {_ANNUAL} SELECT BASIN_ID, NAME, climate_model, hydro_model, ssp_scenario, year, REGION, round(qtot, 6) AS qtot FROM annual")
def annual_basin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_annual(spark, sf_dir), "qtot")


@_query(f"WITH {_PANEL} SELECT REGION, climate_model, ssp_scenario, hydro_model, year, coalesce(sum(qtot), 0) AS qtot, REGION AS BASIN_ID, REGION AS NAME FROM panel GROUP BY REGION, climate_model, ssp_scenario, hydro_model, year")
def regional_annual_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.regional_annual(daily_panel(spark, sf_dir), "qtot")


@_query(f"WITH {_PANEL} SELECT REGION, climate_model, ssp_scenario, hydro_model, year, month, coalesce(sum(qtot), 0) AS qtot, min(date) AS date, REGION AS BASIN_ID, REGION AS NAME FROM panel GROUP BY REGION, climate_model, ssp_scenario, hydro_model, year, month", dates=("date",))
def regional_monthly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.regional_monthly(daily_panel(spark, sf_dir), "qtot")


def _spread(by: str) -> Query:
    return lambda spark, sf_dir: _round(ensemble.spread(_annual(spark, sf_dir), "qtot", by), "qtot_mean", "qtot_std", "qtot_min", "qtot_max")


for _by, _short in (("ssp_scenario", "ssp"), ("climate_model", "climate"), ("hydro_model", "hydro")):
    _query(f"WITH {_ANNUAL} SELECT BASIN_ID, {_by}, year, round(avg(qtot), 6) AS qtot_mean, round(stddev_samp(qtot), 6) AS qtot_std, round(min(qtot), 6) AS qtot_min, round(max(qtot), 6) AS qtot_max FROM annual GROUP BY BASIN_ID, {_by}, year", f"spread_by_{_short}")(_spread(_by))


@_query(f"WITH {_ANNUAL} SELECT BASIN_ID, hydro_model, year, round(avg(qtot), 6) AS qtot FROM annual GROUP BY BASIN_ID, hydro_model, year")
def lines_by_hydro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensemble.lines(_annual(spark, sf_dir), "qtot", "hydro_model"), "qtot")


_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month]"


@_query(f"""WITH {_PANEL}, c AS (SELECT BASIN_ID, ssp_scenario, month, avg(qtot) AS m, stddev_samp(qtot) AS s, min(qtot) AS lo, max(qtot) AS hi FROM panel GROUP BY BASIN_ID, ssp_scenario, month)
SELECT BASIN_ID, ssp_scenario, month, round(m, 6) AS qtot_mean, round(s, 6) AS qtot_std, lo AS qtot_min, hi AS qtot_max, round(m - coalesce(s, 0), 6) AS band_low, round(m + coalesce(s, 0), 6) AS band_high, {_MONTHS} AS month_name FROM c""")
def climatology_by_ssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensemble.climatology(daily_panel(spark, sf_dir), "qtot", "ssp_scenario"), "qtot_mean", "qtot_std", "band_low", "band_high")


@_query(f"WITH {_PANEL} SELECT BASIN_ID, NAME, REGION, ssp_scenario, climate_model, hydro_model, date, year, month, {_MONTHS} AS month_name, round(qtot_mean, 6) AS qtot_mean FROM monthly", dates=("date",))
def monthly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensemble.monthly_rows(_monthly(spark, sf_dir), "qtot_mean"), "qtot_mean")


@_query(f"""WITH {_PANEL}, q AS (SELECT BASIN_ID, ssp_scenario, month, quantile_cont(qtot, 0.25) AS q1, quantile_cont(qtot, 0.5) AS median, quantile_cont(qtot, 0.75) AS q3, count(*) AS n FROM panel GROUP BY BASIN_ID, ssp_scenario, month)
SELECT BASIN_ID, ssp_scenario, month, q1, median, q3, n, min(qtot) FILTER (WHERE qtot BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(qtot) FILTER (WHERE qtot BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM panel JOIN q USING (BASIN_ID, ssp_scenario, month) GROUP BY BASIN_ID, ssp_scenario, month, q1, median, q3, n""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.box_stats(daily_panel(spark, sf_dir), "qtot", "ssp_scenario")


_HEAT = ", ".join(f"round(avg(qtot) FILTER (WHERE month = {m}), 6) AS m{m:02d}" for m in range(1, 13))


@_query(f"WITH {_PANEL} SELECT BASIN_ID, year, {_HEAT} FROM panel WHERE ssp_scenario = 'O' GROUP BY BASIN_ID, year")
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensemble.heatmap(daily_panel(spark, sf_dir), "qtot", scenario="O"), *[f"m{m:02d}" for m in range(1, 13)])


@_query(f"WITH {_PANEL} SELECT BASIN_ID, ssp_scenario, climate_model, year, {_HEAT} FROM panel WHERE ssp_scenario IN ('O', 'F') AND climate_model IN ('1-URGENT', '5-LOW') GROUP BY BASIN_ID, ssp_scenario, climate_model, year")
def heatmap_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ensemble.heatmaps(daily_panel(spark, sf_dir), "qtot", ("O", "F"), ("1-URGENT", "5-LOW")), *[f"m{m:02d}" for m in range(1, 13)])


@_query(f"WITH {_ANNUAL} " + " UNION ALL ".join(f"""SELECT BASIN_ID, '{c}' AS "by", {c} AS level, year, round(avg(qtot), 6) AS qtot_mean, round(stddev_samp(qtot), 6) AS qtot_std, round(min(qtot), 6) AS qtot_min, round(max(qtot), 6) AS qtot_max FROM annual GROUP BY BASIN_ID, {c}, year""" for c in ensemble.GROUPS))
def grouped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets of grouped plots: all three groupings."""
    return _round(ensemble.grouped_series(_annual(spark, sf_dir), "qtot"), "qtot_mean", "qtot_std", "qtot_min", "qtot_max")


_PARTS = {"ssp": "ssp_scenario", "climate_model": "climate_model", "hydro_model": "hydro_model", "year": "year"}
_VARIANCES = ", ".join(f"v_{k} AS (SELECT BASIN_ID, coalesce(var_samp(m), 0) AS {k}_variance FROM (SELECT BASIN_ID, {c}, avg(qtot) AS m FROM annual GROUP BY BASIN_ID, {c}) GROUP BY BASIN_ID)" for k, c in _PARTS.items())
_PCT = {k: f"CASE WHEN total_variance > 0 THEN {k}_variance / total_variance * 100 ELSE 0 END" for k in _PARTS}


@_query(f"WITH {_ANNUAL}, t AS (SELECT BASIN_ID, var_samp(qtot) AS total_variance FROM annual GROUP BY BASIN_ID), {_VARIANCES} SELECT BASIN_ID, round(total_variance, 6) AS total_variance, "
        + ", ".join(f"round({k}_variance, 6) AS {k}_variance, round({_PCT[k]}, 6) AS {k}_pct" for k in _PARTS)
        + f", round(100 - ({' + '.join(_PCT.values())}), 6) AS residual_pct, round(log10(total_variance + 1), 6) AS log10_total FROM t " + " ".join(f"JOIN v_{k} USING (BASIN_ID)" for k in _PARTS))
def variance_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ensemble.variance_decomposition(_annual(spark, sf_dir), "qtot")
    return _round(out, *[c for c in out.columns if c != "BASIN_ID"])


@_query(f"WITH {_PANEL} SELECT string_agg(DISTINCT hydro_model, ',' ORDER BY hydro_model) AS hydro_model, string_agg(DISTINCT climate_model, ',' ORDER BY climate_model) AS climate_model, string_agg(DISTINCT ssp_scenario, ',' ORDER BY ssp_scenario) AS ssp_scenario, count(DISTINCT hydro_model) AS n_hydro_model, count(DISTINCT climate_model) AS n_climate_model, count(DISTINCT ssp_scenario) AS n_ssp_scenario FROM panel")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pn.levels(daily_panel(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("hydro_model", "climate_model", "ssp_scenario")})


# Analysis of variance ---------------------------------------------------------------------------


@_query(f"""WITH {_PANEL}, g AS (SELECT BASIN_ID, hydro_model, count(*) AS n, sum(qtot) AS s, sum(qtot * qtot) AS ss FROM panel GROUP BY BASIN_ID, hydro_model),
a AS (SELECT BASIN_ID, CAST(sum(n) AS BIGINT) AS n, count(*) AS levels, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ss_between, sum(ss) - sum(s * s / n) AS ss_within FROM g GROUP BY BASIN_ID)
SELECT BASIN_ID, n, levels, round(ss_between, 4) AS ss_between, round(ss_within, 4) AS ss_within, round((ss_between / (levels - 1)) / (ss_within / (n - levels)), 6) AS f FROM a""")
def oneway_ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = av.one_way(daily_panel(spark, sf_dir), "qtot", "hydro_model")
    return _round(_round(out, "ss_between", "ss_within", digits=4), "f")


def _anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return av.anova(daily_panel(spark, sf_dir), "qtot", "daily")


def _swept_sql(x: str, rows: str, value: str, model: str, terms: tuple[tuple[str, ...], ...]) -> str:
    """CTEs that end in {x}: one row a basin, as `anova` returns it.

    Each cell of equal levels is a list: 1, every term's columns, the target.  Sums
    of their products are one list a basin, of which a recursive query takes out one
    column after the other; p-values are the incomplete beta function's continued
    fraction, by another one.
    """
    levels = {"ssp_scenario": f"[(ssp_scenario = l)::DOUBLE FOR l IN {x}l.s[2:]]", "climate_model": f"[(climate_model = l)::DOUBLE FOR l IN {x}l.c[2:]]", "hydro_model": f"[(hydro_model = l)::DOUBLE FOR l IN {x}l.h[2:]]",
              "month": "[(month = l)::DOUBLE FOR l IN range(2, 13)]", "year": "[year - y0]"}
    coded = {t: levels[t[0]] if len(t) == 1 else f"flatten([[a * b FOR b IN {levels[t[1]]}] FOR a IN {levels[t[0]]}])" for t in terms}
    names = [av.term_name(t) for t in terms]
    begins = {t: "2" + "".join(f" + n_{m}" for m in names[:k]) for k, t in enumerate(terms)}
    columns = {t: f"range({begins[t]}, {begins[t]} + n_{n})" for t, n in zip(terms, names)}
    joined = lambda ts: "[1]" + "".join(f" || {columns[t]}" for t in ts)
    rest = {t: [u for u in terms if u != t and not set(t) < set(u)] for t in terms}
    specs = [f"('all', 1, {joined(terms)})"] + [f"('{n}', {k}, {joined(ts)})" for t, n in zip(terms, names) for k, ts in ((0, rest[t]), (1, [*rest[t], t]))]
    p = f"(SELECT beta FROM {x}p WHERE {x}p.BASIN_ID = w.BASIN_ID AND {x}p.term = '{{n}}')"
    shares = ", ".join(f"100 * max(ss) FILTER (WHERE term = '{n}') / sum(ss) AS {n}_pct" for n in names)
    return f"""
{x}k AS MATERIALIZED (SELECT BASIN_ID, ssp_scenario, climate_model, hydro_model, month, year, count(*) AS n, avg({value}) AS mean, var_pop({value}) * count(*) AS css, min(NAME) AS basin_name, min(REGION) AS region FROM {rows} GROUP BY ALL),
{x}l AS MATERIALIZED (SELECT list_sort(list(DISTINCT ssp_scenario)) AS s, list_sort(list(DISTINCT climate_model)) AS c, list_sort(list(DISTINCT hydro_model)) AS h FROM {x}k),
{x}b AS MATERIALIZED (SELECT BASIN_ID, min(basin_name) AS basin_name, min(region) AS region, CAST(sum(n) AS BIGINT) AS n, sum(n * mean) / sum(n) AS middle, avg(year) AS y0, sum(css) AS within FROM {x}k GROUP BY BASIN_ID
  HAVING sum(n) >= {av.LEAST} AND count(DISTINCT ssp_scenario) > 1 AND count(DISTINCT climate_model) > 1 AND count(DISTINCT hydro_model) > 1),
{x}d AS MATERIALIZED (SELECT BASIN_ID, k.n, [1.0::DOUBLE]{"".join(f" || {coded[t]}" for t in terms)} || [mean - middle] AS d, {", ".join(f"len({coded[t]}) AS n_{n}" for t, n in zip(terms, names))} FROM {x}k k JOIN {x}b b USING (BASIN_ID), {x}l),
{x}z AS (SELECT {", ".join(f"max(n_{n}) AS n_{n}" for n in names)}, max(len(d)) AS size FROM {x}d),
{x}m AS MATERIALIZED (SELECT BASIN_ID, list(v ORDER BY i, j) AS m, list(v ORDER BY i) FILTER (WHERE i = j) AS first FROM (SELECT BASIN_ID, i, j, sum(n * d[i] * d[j]) AS v FROM {x}d, (SELECT unnest(range(1, size + 1)) AS i FROM {x}z), (SELECT unnest(range(1, size + 1)) AS j FROM {x}z) GROUP BY BASIN_ID, i, j) GROUP BY BASIN_ID),
{x}o AS MATERIALIZED (SELECT o.term, o.part, o.cols, size FROM {x}z, LATERAL (VALUES {", ".join(specs)}) o(term, part, cols)),
{x}s AS (SELECT BASIN_ID, term, part, cols, size, first, 1 AS step, 0 AS rank, m FROM {x}m, {x}o
  UNION ALL SELECT BASIN_ID, term, part, cols, size, first, step + 1, rank + (m[(k - 1) * size + k] > 1e-9 * first[k])::INTEGER,
    CASE WHEN m[(k - 1) * size + k] > 1e-9 * first[k] THEN [m[e + 1] - m[(e // size) * size + k] * m[(k - 1) * size + e % size + 1] / m[(k - 1) * size + k] FOR e IN range(size * size)] ELSE m END
  FROM (SELECT *, cols[step] AS k FROM {x}s WHERE step <= len(cols))),
{x}e AS MATERIALIZED (SELECT BASIN_ID, term, part, rank, m[size * size] AS rss FROM {x}s WHERE step = len(cols) + 1),
{x}t AS MATERIALIZED (SELECT a.BASIN_ID, a.term, greatest(a.rss - c.rss, 0) AS ss, c.rank - a.rank AS df FROM {x}e a JOIN {x}e c ON a.BASIN_ID = c.BASIN_ID AND a.term = c.term AND a.part = 0 AND c.part = 1),
{x}r AS MATERIALIZED (SELECT BASIN_ID, greatest(rss, 0) + within AS residual, n - rank AS df, (SELECT m[size * size] FROM {x}s q WHERE q.BASIN_ID = b.BASIN_ID AND q.term = 'all' AND step = 2) + within AS centre FROM {x}e JOIN {x}b b USING (BASIN_ID) WHERE term = 'all'),
{x}f AS MATERIALIZED (SELECT BASIN_ID, term, CASE WHEN flip THEN b ELSE a END AS a, CASE WHEN flip THEN a ELSE b END AS b, CASE WHEN flip THEN 1 - x ELSE x END AS x, flip FROM (SELECT *, x > (a + 1) / (a + b + 2) AS flip FROM (
  SELECT BASIN_ID, term, r.df / 2.0::DOUBLE AS a, t.df / 2.0::DOUBLE AS b, r.df / (r.df + t.df * (ss / t.df) / (residual / r.df)) AS x FROM {x}t t JOIN {x}r r USING (BASIN_ID) WHERE t.df > 0 AND ss > 0))),
{x}g AS (SELECT BASIN_ID, term, a, b, x, 0 AS i, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h, 2.0::DOUBLE AS last FROM {x}f
  UNION ALL SELECT BASIN_ID, term, a, b, x, i + 1, c2, d2, h * (c1 * d1) * (c2 * d2), c2 * d2 FROM (SELECT *, 1 / (1 + u2 * d1) AS d2, 1 + u2 / c1 AS c2 FROM (SELECT *, 1 / (1 + u1 * d) AS d1, 1 + u1 / c AS c1 FROM (
    SELECT *, (i + 1) * (b - i - 1) * x / ((a + 2 * i + 1) * (a + 2 * i + 2)) AS u1, -(a + i + 1) * (a + b + i + 1) * x / ((a + 2 * i + 2) * (a + 2 * i + 3)) AS u2 FROM {x}g WHERE abs(last - 1) > 1e-15 AND i < 5000)))),
{x}p AS MATERIALIZED (SELECT BASIN_ID, term, CASE WHEN flip THEN 1 - q ELSE q END AS beta FROM (SELECT f.BASIN_ID, f.term, flip, exp(lgamma(f.a + f.b) - lgamma(f.a) - lgamma(f.b) + f.a * ln(f.x) + f.b * ln(1 - f.x)) / f.a * arg_max(h, i) AS q FROM {x}f f JOIN {x}g g ON f.BASIN_ID = g.BASIN_ID AND f.term = g.term GROUP BY f.BASIN_ID, f.term, flip, f.a, f.b, f.x)),
{x}w AS (SELECT BASIN_ID, {shares} FROM (SELECT BASIN_ID, term, ss FROM {x}t UNION ALL SELECT BASIN_ID, 'residual', residual FROM {x}r) GROUP BY BASIN_ID),
{x} AS MATERIALIZED (SELECT w.BASIN_ID AS basin_id, basin_name, region, CAST(NULL AS DOUBLE) AS area_km2, b.n AS n_observations, 1 - residual / centre AS r_squared, '{model}' AS temporal_model, middle AS mean_value, sqrt(centre / (b.n - 1)) AS std_value,
  {", ".join(f"{n}_pct, {p.format(n=n)} AS {n}_pvalue" for n in names)}, 100 - ({" + ".join(f"{n}_pct" for n in names)}) AS residual_pct FROM {x}w w JOIN {x}b b USING (BASIN_ID) JOIN {x}r r USING (BASIN_ID))"""


_NAMES = [av.term_name(t) for t in av.BASE]
_SHARES = [f"{n}_pct" for n in (*_NAMES, "residual")]
_NUMBERS = ["r_squared", "mean_value", "std_value", *_SHARES, *(f"{n}_pvalue" for n in _NAMES)]
_DAILY_ANOVA = f"WITH RECURSIVE {_PANEL}, {_swept_sql('v', 'panel', 'qtot', 'daily', av.BASE)}"
_STATISTICS = {"Mean": "avg", "Median": "median", "Std Dev": "stddev_samp", "Min": "min", "Max": "max"}


@_query(f"{_DAILY_ANOVA} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)}) FROM v")
def anova_type2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_anova(spark, sf_dir), *_NUMBERS)


@_query(f"{_DAILY_ANOVA} " + " UNION ALL ".join(f"SELECT '{name}' AS metric, {', '.join(f'round({f}({c}), 6) AS {c}' for c in _SHARES)} FROM v" for name, f in _STATISTICS.items()))
def anova_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(av.summary(_anova(spark, sf_dir)), *_SHARES)


@_query(f"{_DAILY_ANOVA} " + " UNION ALL ".join(f"SELECT '{av.pretty(n)}' AS factor, count(*) FILTER (WHERE {n}_pvalue < 0.05) AS significant_basins, count(*) AS total_basins, round(100.0::DOUBLE * count(*) FILTER (WHERE {n}_pvalue < 0.05) / count(*), 6) AS percentage_significant FROM v" for n in _NAMES))
def anova_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(av.significance(_anova(spark, sf_dir)), "percentage_significant")


@_query(f"{_DAILY_ANOVA} " + " UNION ALL ".join(f"SELECT '{av.pretty(n)}' AS factor, round(avg({n}_pct), 6) AS mean_pct, round(stddev_samp({n}_pct), 6) AS std_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE {n}_pvalue < 0.05) / count(*), 6) AS percentage_significant, '{'interaction' if '_x_' in n else 'main'}' AS kind FROM v" for n in _NAMES))
def anova_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(av.report(_anova(spark, sf_dir)), "mean_pct", "std_pct", "percentage_significant")


@_query(f"{_DAILY_ANOVA}, {_swept_sql('u', 'monthly', 'qtot_mean', 'monthly', av.SEASONAL)} " + " UNION ALL ".join(f"SELECT temporal_model, round(avg(ssp_scenario_x_year_pct), 6) AS mean_ssp_x_year_pct, round(avg(r_squared), 6) AS mean_r_squared, count(*) AS n_basins FROM {x} GROUP BY temporal_model" for x in "vu"))
def anova_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly_means = _monthly(spark, sf_dir)
    return _round(av.compare_models([_anova(spark, sf_dir), av.anova(monthly_means, "qtot_mean", "monthly")]), "mean_ssp_x_year_pct", "mean_r_squared")


@_query(f"""WITH {_PANEL}, u AS (SELECT BASIN_ID, count(*) AS n, count(DISTINCT ssp_scenario) AS a, count(DISTINCT climate_model) AS b, count(DISTINCT hydro_model) AS c FROM panel GROUP BY BASIN_ID)
SELECT BASIN_ID, CASE WHEN n < 2400 THEN 'too few values' WHEN a < 2 THEN 'one level of ssp_scenario' WHEN b < 2 THEN 'one level of climate_model' ELSE 'one level of hydro_model' END AS reason
FROM u WHERE n < 2400 OR a < 2 OR b < 2 OR c < 2""")
def anova_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return av.skipped(daily_panel(spark, sf_dir), "qtot", 2400)


_PAIRS = """
a AS (SELECT CAST(s_nationkey AS BIGINT) AS BASIN_ID, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS x, avg(l_quantity * (1 - l_discount)) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE))"""
_MEASURES = """count(*) AS n, round(corr(x, y), 6) AS r, round(avg(abs(x - y) / abs(x)), 6) AS mean_relative, round(max(abs(x - y) / abs(x)), 6) AS max_relative, round(median(abs(x)), 6) AS median_scale, round((max(y) - min(y)) / (max(x) - min(x)), 6) AS range_ratio"""


def _two_methods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    rows = lines.join(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    keyed = rows.select(F.col("s_nationkey").cast("long").alias("BASIN_ID"), F.to_date("l_shipdate").alias("date"), "l_quantity", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"))
    one = lambda c: keyed.groupBy("BASIN_ID", "date").agg(F.avg(c).alias("value"))
    return one("l_quantity"), one("net")


_LENGTHS = {**rolling.MONTHLY, **{f"{n}d": n for n in rolling.DAILY.values()}}


_LONG = """
a AS (SELECT CAST(l_linenumber % 3 AS BIGINT) AS series, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS step, sum(l_extendedprice) AS x FROM lineitem GROUP BY l_linenumber % 3, l_orderkey * 8 + l_linenumber)"""


@_query(f"WITH {_LONG} SELECT series, step, " + ", ".join(f"round(CASE WHEN count(x) OVER w_{name} = {n} THEN avg(x) OVER w_{name} END, 6) AS x_{name}" for name, n in _LENGTHS.items())
        + " FROM a WINDOW " + ", ".join(f"w_{name} AS (PARTITION BY series ORDER BY step ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for name, n in _LENGTHS.items()))
def rolling_default_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default lengths, monthly and daily, on series of many thousand steps."""
    step = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    lines = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).cast("long").alias("series"), step.alias("date")).agg(F.sum("l_extendedprice").alias("x"))
    out = rolling.rolling_means(lines, "x", _LENGTHS, ("series",)).withColumnRenamed("date", "step").drop("x")
    return _round(out, *[f"x_{name}" for name in _LENGTHS])


@_query(f"WITH {_PAIRS} SELECT {_MEASURES} FROM a")
def agreement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_methods(spark, sf_dir)
    return _round(compare.agreement_metrics(a, b, ("BASIN_ID", "date"), "value"), "r", "mean_relative", "max_relative", "median_scale", "range_ratio")


@_query(f"WITH {_PAIRS} SELECT BASIN_ID, {_MEASURES} FROM a GROUP BY BASIN_ID")
def agreement_by_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_methods(spark, sf_dir)
    return _round(compare.agreement_by_basin(a, b, ("BASIN_ID", "date"), "value"), "r", "mean_relative", "max_relative", "median_scale", "range_ratio")


# Grid -------------------------------------------------------------------------------------------

_RECT = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
#: A rectangle, a triangle that overlaps it, a ring with a hole, and one that holds no cell centre.
_SHAPES = {1: [_RECT(-4.0, -4.0, 0.0, 0.0)], 2: [[(-1.2, -3.1), (3.2, -3.1), (1.1, 3.3), (-1.2, -3.1)]], 3: [_RECT(0.2, 0.2, 3.9, 3.9), _RECT(1.2, 1.2, 2.8, 2.8)], 4: [_RECT(0.1, 0.1, 0.3, 0.3)]}

_EDGES = ", ".join(f"({b}, {x1}, {y1}, {x2}, {y2})" for b, rings in _SHAPES.items() for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:]))
_GRID = f"""
cells AS (SELECT CAST(i // 8 AS INTEGER) AS lat_idx, CAST(i % 8 AS INTEGER) AS lon_idx, 3.5 - (i // 8) AS lat, (i % 8) - 3.5 AS lon, i FROM range(64) t(i)),
edges AS (SELECT * FROM (VALUES {_EDGES}) e(BASIN_ID, x1, y1, x2, y2)),
mapped AS (SELECT CAST(BASIN_ID AS BIGINT) AS BASIN_ID, lat_idx, lon_idx FROM cells JOIN edges ON ((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY BASIN_ID, lat_idx, lon_idx HAVING count(*) % 2 = 1),
grid AS (SELECT CAST(vec_id AS INTEGER) AS time_idx, make_date(2000 + CAST(vec_id // 12 AS INTEGER) % 100, CAST(vec_id % 12 AS INTEGER) + 1, 15) AS date, lat_idx, lon_idx, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, cells)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    months = F.make_date((2000 + F.floor(F.col("vec_id") / 12) % 100).cast("int"), (F.col("vec_id") % 12 + 1).cast("int"), F.lit(15))
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    return rows.select(F.col("vec_id").cast("int").alias("time_idx"), months.alias("date"), y.alias("lat_idx"), x.alias("lon_idx"), (3.5 - y).cast("double").alias("lat"), (x - 3.5).cast("double").alias("lon"), F.col("v").cast("double").alias("value"))


def basins(spark: SparkSession) -> DataFrame:
    point = lambda p: F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y"))
    return literals(spark, [{"BASIN_ID": F.lit(b).cast("long"), "rings": F.array(*[F.array(*map(point, r)) for r in rings])} for b, rings in _SHAPES.items()])


def cells(spark: SparkSession) -> DataFrame:
    y, x = F.floor(F.col("id") / 8).cast("int"), (F.col("id") % 8).cast("int")
    return spark.range(64).select(y.alias("lat_idx"), x.alias("lon_idx"), (3.5 - y).cast("double").alias("lat"), (x - 3.5).cast("double").alias("lon"))


def _map(spark: SparkSession, **options) -> DataFrame:
    return cell_basin(cells(spark), basins(spark), **options)


def _area(spark: SparkSession) -> DataFrame:
    return cells(spark).select("lat_idx", "lon_idx", ((F.col("lat_idx") * 8 + F.col("lon_idx") + 1) * 1e6).alias("area_m2"))


@_query(f"WITH {_GRID} SELECT m.BASIN_ID, m.lat_idx, m.lon_idx, count(g.time_idx) AS steps FROM mapped m JOIN grid g USING (lat_idx, lon_idx) GROUP BY m.BASIN_ID, m.lat_idx, m.lon_idx")
def cell_basin_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).join(_map(spark), ["lat_idx", "lon_idx"]).groupBy("BASIN_ID", "lat_idx", "lon_idx").agg(F.count("time_idx").alias("steps"))


@_query(f"WITH {_GRID}, l AS (SELECT max(BASIN_ID) AS BASIN_ID, lat_idx, lon_idx FROM mapped GROUP BY lat_idx, lon_idx) SELECT BASIN_ID, date, round(sum(value), 6) AS value FROM grid JOIN l USING (lat_idx, lon_idx) GROUP BY BASIN_ID, date", dates=("date",))
def mask_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(zonal.zonal(grid(spark, sf_dir), _map(spark, overlap="last"), "sum"), "value")


def _zonal(method: str) -> Query:
    return lambda spark, sf_dir: _round(zonal.with_basins(basins(spark), zonal.zonal(grid(spark, sf_dir), _map(spark), method)), "value")


for _name, _f in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    _query(f"WITH {_GRID}, z AS (SELECT BASIN_ID, date, round({_f}(value), 6) AS value FROM grid JOIN mapped USING (lat_idx, lon_idx) GROUP BY BASIN_ID, date) SELECT CAST(b AS BIGINT) AS BASIN_ID, date, value FROM (VALUES (1), (2), (3), (4)) t(b) LEFT JOIN z ON z.BASIN_ID = b", f"zonal_{_name}", ("date",))(_zonal(_name))


_YEARLY = {
    "sum": ("coalesce(sum(value), 0)", "sum(c)"), "max": ("max(value)", "max(c)"), "mean": ("avg(value)", "avg(c)"), "quantile": ("quantile_cont(value, 0.1)", "avg(c)"),
    "meansd": ("avg(value) AS m, stddev_pop(value)", "avg(m) + avg(c)"),
}


def _annual_grid(method: str) -> Query:
    return lambda spark, sf_dir: _round(zonal.annual(grid(spark, sf_dir), _map(spark), basins(spark), method), "value")


for _name, (_cell, _basin) in _YEARLY.items():
    _query(f"""WITH {_GRID}, y AS (SELECT lat_idx, lon_idx, CAST(year(date) AS INTEGER) AS year, {_cell} AS c FROM grid GROUP BY lat_idx, lon_idx, year(date)),
f AS (SELECT BASIN_ID, year, {_basin} AS value FROM y JOIN mapped USING (lat_idx, lon_idx) GROUP BY BASIN_ID, year)
SELECT CAST(b AS BIGINT) AS BASIN_ID, n.year, round(coalesce(value, 0), 6) AS value FROM (VALUES (1), (2), (3), (4)) t(b) CROSS JOIN (SELECT DISTINCT year FROM y) n LEFT JOIN f ON f.BASIN_ID = b AND f.year = n.year""", f"annual_{_name}")(_annual_grid(_name))


# The same on a grid with gaps, which count as 0: every seventh cell and step, and all of one year in one cell.
_GAP = "(time_idx + lat_idx * 8 + lon_idx) % 7 = 0 OR (lat_idx = 5 AND lon_idx = 2 AND year(date) = 2001)"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = ((F.col("time_idx") + F.col("lat_idx") * 8 + F.col("lon_idx")) % 7 == 0) | ((F.col("lat_idx") == 5) & (F.col("lon_idx") == 2) & (F.year("date") == 2001))
    return grid(spark, sf_dir).withColumn("value", F.when(~gone, F.col("value")))


def _annual_filled(method: str) -> Query:
    return lambda spark, sf_dir: _round(zonal.annual(_gappy(spark, sf_dir), _map(spark), basins(spark), method, fill=0.0), "value")


for _name in ("mean", "quantile", "meansd"):
    _cell, _basin = _YEARLY[_name]
    _query(f"""WITH {_GRID}, holes AS (SELECT * REPLACE (CASE WHEN {_GAP} THEN 0 ELSE value END AS value) FROM grid),
y AS (SELECT lat_idx, lon_idx, CAST(year(date) AS INTEGER) AS year, {_cell} AS c FROM holes GROUP BY lat_idx, lon_idx, year(date)),
f AS (SELECT BASIN_ID, year, {_basin} AS value FROM y JOIN mapped USING (lat_idx, lon_idx) GROUP BY BASIN_ID, year)
SELECT CAST(b AS BIGINT) AS BASIN_ID, n.year, round(coalesce(value, 0), 6) AS value FROM (VALUES (1), (2), (3), (4)) t(b) CROSS JOIN (SELECT DISTINCT year FROM y) n LEFT JOIN f ON f.BASIN_ID = b AND f.year = n.year""", f"annual_{_name}_filled")(_annual_filled(_name))


@_query(f"""WITH {_GRID} SELECT BASIN_ID, date, round(sum(value * ((lat_idx * 8 + lon_idx + 1) * 1e6 * (365.25 * 86400 * 1e-12))), 9) AS qtot_km3, round(max(value * (365.25 * 86400 * 1e-9)), 9) AS dis_km3
FROM grid JOIN mapped USING (lat_idx, lon_idx) GROUP BY BASIN_ID, date""", dates=("date",))
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).join(with_weights(_map(spark), None), ["lat_idx", "lon_idx"]).join(_area(spark), ["lat_idx", "lon_idx"])
    v = F.col("value")
    return rows.groupBy("BASIN_ID", "date").agg(F.round(F.sum(to_volume(v, "qtot", F.col("area_m2"))), 9).alias("qtot_km3"), F.round(F.max(to_volume(v, "dis")), 9).alias("dis_km3"))


@_query("""WITH t AS (SELECT o_orderkey, (o_orderkey % 2000) + 0.5 AS t, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN 'days since 1661-1-1' WHEN 1 THEN 'hours since 1901-01-01 00:00:00' WHEN 2 THEN 'months since 1850-1-31' WHEN 3 THEN 'years since 1604-2-29' ELSE 'steps' END AS units FROM orders),
n AS (SELECT *, CAST(CASE WHEN CAST(floor(t) AS BIGINT) % 2 = 0 THEN floor(t) ELSE ceil(t) END AS INTEGER) AS k FROM t)
SELECT o_orderkey, units, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN DATE '1661-01-01' + k WHEN 1 THEN DATE '1901-01-01' + CAST(floor(k / 24.0) AS INTEGER) WHEN 2 THEN CAST(DATE '1850-01-31' + to_months(k) AS DATE) WHEN 3 THEN CAST(DATE '1604-02-29' + to_months(12 * k) AS DATE) END AS date FROM n""", dates=("date",))
def time_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.element_at(F.array(*map(F.lit, ("days since 1661-1-1", "hours since 1901-01-01 00:00:00", "months since 1850-1-31", "years since 1604-2-29", "steps"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000 + 0.5).alias("t"), units.alias("units"))
    return rows.select("o_orderkey", "units", decode_time(F.col("t"), F.col("units")).alias("date"))


_DIRTY = "CASE WHEN l_quantity >= 45 THEN 1e20 WHEN l_quantity <= 2 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END"


@_query(f"""WITH d AS (SELECT l_returnflag, {_DIRTY} AS v FROM lineitem), c AS (SELECT l_returnflag, CASE WHEN isnan(v) OR abs(v) >= 1e15 THEN NULL ELSE v END AS c, CASE WHEN isnan(v) THEN 1.0 ELSE 0.0 END AS gone FROM d)
SELECT l_returnflag, count(*) AS n, count(c) AS n_values, sum(c) AS total, round(avg(coalesce(c, 0)), 6) AS mean_filled, round(avg(gone), 6) AS missing_share FROM c GROUP BY l_returnflag""")
def mask_fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    v = F.when(q >= 45, 1e20).when(q <= 2, float("nan")).otherwise(q)
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", v.alias("v"))
    c = clean(F.col("v"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(c).alias("n_values"), F.sum(c).alias("total"), F.round(F.avg(zero_if_missing(c)), 6).alias("mean_filled"), F.round(missing_share(F.col("v")), 6).alias("missing_share"))


_OUTLETS = _GRID + """,
outlets AS (SELECT BASIN_ID, time_idx, lat_idx, lon_idx, value FROM (SELECT *, row_number() OVER (PARTITION BY BASIN_ID, time_idx ORDER BY value DESC, lat_idx, lon_idx) AS k FROM grid JOIN mapped USING (lat_idx, lon_idx)) WHERE k = 1),
places AS (SELECT BASIN_ID, string_agg(p, ',' ORDER BY p) AS unique_locations, count(*) AS n FROM (SELECT DISTINCT BASIN_ID, lat_idx || ':' || lon_idx AS p FROM outlets) GROUP BY BASIN_ID),
seen AS (SELECT BASIN_ID, min(value) AS min_value, max(value) AS max_value, count(*) AS n_observations FROM outlets GROUP BY BASIN_ID),
report AS (SELECT CAST(b AS BIGINT) AS BASIN_ID, CASE WHEN n IS NULL THEN 'empty' WHEN n = 1 THEN 'fixed' ELSE 'moving' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS n_unique_locations, unique_locations, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, coalesce(n_observations, 0) AS n_observations
  FROM (VALUES (1), (2), (3), (4)) t(b) LEFT JOIN places p ON p.BASIN_ID = b LEFT JOIN seen s ON s.BASIN_ID = b)"""


@_query(f"WITH {_GRID} SELECT BASIN_ID, time_idx, round(max(value), 6) AS value FROM grid JOIN mapped USING (lat_idx, lon_idx) WHERE time_idx < 100 AND time_idx % 5 = 0 GROUP BY BASIN_ID, time_idx")
def step_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = zonal.sample_steps(grid(spark, sf_dir), 5, 100)
    return _round(zonal.zonal(sampled, _map(spark), "max", keys=("time_idx",)), "value")


@_query(f"WITH {_OUTLETS} SELECT BASIN_ID, time_idx, lat_idx, lon_idx, round(value, 6) AS value FROM outlets")
def outlet_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(outlet.outlets(grid(spark, sf_dir), _map(spark)), "value")


def _report(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return outlet.stability(outlet.outlets(grid(spark, sf_dir), _map(spark, **options)), basins(spark))


@_query(f"WITH {_OUTLETS} SELECT * FROM report")
def outlet_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.transform("unique_locations", lambda p: F.concat_ws(":", p["lat_idx"].cast("string"), p["lon_idx"].cast("string")))
    return _round(_report(spark, sf_dir).withColumn("unique_locations", F.array_join(place, ",")), "min_value", "max_value")


@_query(f"WITH {_OUTLETS} SELECT 'centre' AS method, count(*) AS total_basins, count(*) FILTER (WHERE status = 'fixed') AS fixed_basins, count(*) FILTER (WHERE status = 'moving') AS moving_basins, count(*) FILTER (WHERE status = 'empty') AS empty_basins, 100.0::DOUBLE * count(*) FILTER (WHERE status = 'fixed') / count(*) AS fixed_pct, 100.0::DOUBLE * count(*) FILTER (WHERE status = 'moving') / count(*) AS moving_pct FROM report")
def outlet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlet.stability_summary(_report(spark, sf_dir), "centre")


@_query(f"""WITH {_OUTLETS}, l AS (SELECT max(BASIN_ID) AS BASIN_ID, lat_idx, lon_idx FROM mapped GROUP BY lat_idx, lon_idx),
o2 AS (SELECT BASIN_ID, lat_idx, lon_idx FROM (SELECT *, row_number() OVER (PARTITION BY BASIN_ID, time_idx ORDER BY value DESC, lat_idx, lon_idx) AS k FROM grid JOIN l USING (lat_idx, lon_idx)) WHERE k = 1),
p2 AS (SELECT BASIN_ID, string_agg(p, ',' ORDER BY p) AS places FROM (SELECT DISTINCT BASIN_ID, lat_idx || ':' || lon_idx AS p FROM o2) GROUP BY BASIN_ID)
SELECT CAST(b AS BIGINT) AS BASIN_ID, coalesce(p.unique_locations, '') = coalesce(p2.places, '') AS agree FROM (VALUES (1), (2), (3), (4)) t(b) LEFT JOIN places p ON p.BASIN_ID = b LEFT JOIN p2 ON p2.BASIN_ID = b""")
def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlet.agreement(_report(spark, sf_dir), _report(spark, sf_dir, overlap="last"))


_HALF = 0.5
_SIDES = [f"((x2 - x1) * (lat + {b * _HALF} - y1) - (y2 - y1) * (lon + {a * _HALF} - x1))" for a in (-1, 1) for b in (-1, 1)]


@_query(f"""WITH {_GRID}, touched AS (SELECT DISTINCT CAST(BASIN_ID AS BIGINT) AS BASIN_ID, lat_idx, lon_idx FROM cells JOIN edges
  ON least(x1, x2) <= lon + {_HALF} AND greatest(x1, x2) >= lon - {_HALF} AND least(y1, y2) <= lat + {_HALF} AND greatest(y1, y2) >= lat - {_HALF} AND least({", ".join(_SIDES)}) <= 0 AND greatest({", ".join(_SIDES)}) >= 0),
both_ AS (SELECT BASIN_ID, lat_idx, lon_idx, max(contained) AS contained FROM (SELECT *, 1 AS contained FROM mapped UNION ALL SELECT *, 0 FROM touched) GROUP BY BASIN_ID, lat_idx, lon_idx),
o AS (SELECT BASIN_ID, time_idx, lat_idx, lon_idx FROM (SELECT *, row_number() OVER (PARTITION BY BASIN_ID, time_idx ORDER BY value DESC, contained DESC, lat_idx, lon_idx) AS k FROM grid JOIN both_ USING (lat_idx, lon_idx)) WHERE k = 1),
r AS (SELECT BASIN_ID, count(DISTINCT lat_idx || ':' || lon_idx) AS n, count(*) AS seen FROM o GROUP BY BASIN_ID)
SELECT CAST(b AS BIGINT) AS BASIN_ID, CASE WHEN n IS NULL THEN 'empty' WHEN n = 1 THEN 'fixed' ELSE 'moving' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS n_unique_locations, coalesce(seen, 0) AS n_observations
FROM (VALUES (1), (2), (3), (4)) t(b) LEFT JOIN r ON r.BASIN_ID = b""")
def outlet_all_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _map(spark, all_touched=True, half=_HALF, mark_contained=True)
    report = outlet.stability(outlet.outlets(grid(spark, sf_dir), mapped), basins(spark))
    return report.select("BASIN_ID", "status", "n_unique_locations", "n_observations")


# Runs -------------------------------------------------------------------------------------------


@_query("""SELECT h AS hydro_model, c AS climate_model, s AS scenario, v AS variable FROM (SELECT DISTINCT l_returnflag AS h FROM lineitem) CROSS JOIN (SELECT DISTINCT o_orderpriority AS c FROM orders)
CROSS JOIN (SELECT DISTINCT l_linestatus AS s FROM lineitem) CROSS JOIN (VALUES ('qtot'), ('qr')) t(v)""")
def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    variables = literals(spark, [{"variable": F.lit("qtot")}, {"variable": F.lit("qr")}])
    return jobs.matrix_of({"hydro_model": lines.select("l_returnflag"), "climate_model": orders.select("o_orderpriority"), "scenario": lines.select("l_linestatus"), "variable": variables})


@_query("SELECT o_orderstatus AS scenario, count(*) AS jobs FROM orders GROUP BY o_orderstatus")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_counts(_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scenario")), "scenario")


@_query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed, round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS success_pct FROM orders")
def job_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return _round(jobs.success_rates(report), "success_pct")


_FILES = """CASE CAST(s_suppkey % 5 AS INTEGER) WHEN 0 THEN 'out/qtot_monthly_H' || s_suppkey || '_gfdl-esm4_ssp126_future.csv' WHEN 1 THEN 'qr_daily_Water_GAP' || s_suppkey || '_UKESM1-0-LL_historical_historical.csv'
WHEN 2 THEN '/a/b_c/dis_monthly_MIROC-INTEG-LAND_mri-esm2-0_ssp585_extra_future.csv' WHEN 3 THEN 'qtot_monthly_H08_gfdl-esm4_ssp126_future.txt' ELSE 'qtot_monthly_H08_other-model_ssp126_future.csv' END"""
_PATTERN = r"^([^_]+)_([^_]+)_(.+?)_((?i:gfdl-esm4|ipsl-cm6a-lr|mpi-esm1-2-hr|mri-esm2-0|ukesm1-0-ll))_([^_]+)_(?:.*_)?([^_]+)\.csv$"


@_query(rf"""WITH f AS (SELECT s_suppkey, regexp_extract({_FILES}, '([^/]+)$', 1) AS name FROM supplier), m AS (SELECT *, regexp_matches(name, '{_PATTERN}') AS ok FROM f)
SELECT s_suppkey, """ + ", ".join(f"CASE WHEN ok THEN {'replace(' if n == 'hydro_model' else ''}regexp_extract(name, '{_PATTERN}', {k}){', chr(95), chr(45))' if n == 'hydro_model' else ''} END AS {n}" for k, n in enumerate(("variable", "frequency", "hydro_model", "climate_model", "scenario", "time_period"), 1)) + " FROM m")
def run_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("out/qtot_monthly_H"), key, F.lit("_gfdl-esm4_ssp126_future.csv")))
        .when(key % 5 == 1, F.concat(F.lit("qr_daily_Water_GAP"), key, F.lit("_UKESM1-0-LL_historical_historical.csv")))
        .when(key % 5 == 2, F.lit("/a/b_c/dis_monthly_MIROC-INTEG-LAND_mri-esm2-0_ssp585_extra_future.csv"))
        .when(key % 5 == 3, F.lit("qtot_monthly_H08_gfdl-esm4_ssp126_future.txt"))
        .otherwise(F.lit("qtot_monthly_H08_other-model_ssp126_future.csv"))
    )
    return _table(spark, sf_dir, "supplier").select("s_suppkey", parse_run_file(name).alias("r")).select("s_suppkey", "r.*")


@_query("SELECT o_orderkey, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month(o_orderdate)] AS month_name, make_date(year(o_orderdate), month(o_orderdate), 15) AS mid FROM orders", dates=("mid",))
def representative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    from .functions.dates import mid_month

    return _table(spark, sf_dir, "orders").select("o_orderkey", month_name(F.month(day)).alias("month_name"), mid_month(F.year(day), F.month(day)).alias("mid"))
