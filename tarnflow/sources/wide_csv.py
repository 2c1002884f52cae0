"""Wide basin tables (one column per date) and long tables as files."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month, year
from ..functions.naming import parse_run_file, run_file
from ..operators.panel import date_columns
from ..schema import CLIMATE_MODELS, METADATA, RUN, panel_schema
from . import files

log = logging.getLogger(__name__)

def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is; every column is text, so that no pass infers types."""
    return spark.read.option("header", True).option("maxColumns", 200_000).csv(path)


_DAY = r"\d{4}-\d{2}-\d{2}"
#: Id columns that a wide file may have before its dates.
_MOST_IDS = 16


def lines_to_long(rows: DataFrame, value: str, ids: tuple[str, ...] = METADATA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (header, line, *keep) of wide tables -> keep, ids, date, value, year, month; cells without a number go.

    Each row has its table's own header: id columns, then dates, then others.
    Ids are parsed as CSV, with quotes; the rest never holds a comma.  An id that a
    header lacks is NULL.  No column is made of a date.
    """
    names = F.split(F.replace("header", F.lit('"'), F.lit("")), ",")
    is_day = lambda c: c.rlike(f"^{_DAY}$")
    first = F.array_position(F.transform("_h", is_day), True)
    days = F.filter("_h", is_day)
    cells = F.split("line", ",")
    rows = rows.select(*keep, names.alias("_h"), cells.alias("_cells")).withColumns({"_first": first, "_days": days})
    rows = rows.where("_first > 0").withColumn("_tail", F.size("_h") - F.col("_first") + 1).where("size(_cells) >= _tail")  # the dates and what follows
    about = F.array_join(F.slice("_cells", F.lit(1), F.size("_cells") - F.col("_tail")), ",")
    parsed = F.from_csv(about, ", ".join(f"_{k} string" for k in range(_MOST_IDS)))
    rows = rows.withColumns({"_m": parsed, "_v": F.slice("_cells", F.size("_cells") - F.col("_tail") + 1, F.size("_days"))})
    fields = F.array(*[F.col(f"_m._{k}") for k in range(_MOST_IDS)])
    own = lambda c: F.get(fields, F.nullif(F.array_position(F.slice("_h", F.lit(1), F.col("_first") - 1), c), F.lit(0)) - 1)
    named = rows.select(*keep, *(own(c).alias(c) for c in ids), F.arrays_zip(F.col("_days").alias("day"), F.col("_v").alias("v")).alias("_z"))
    long = named.select(*keep, *ids, F.inline("_z")).select(*keep, *ids, F.to_date("day").alias("date"), F.col("v").try_cast("double").alias(value))
    return _typed(long.dropna(subset=[value]).withColumns({"year": year(F.col("date")), "month": month(F.col("date"))}))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, header, line of every line of any number of wide files: one plan, whatever their number.

    A header ends in, or holds, a date; data lines hold none in their last cells.
    Headers meet their files' lines by an equi-join, broadcast if they are small.
    """
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    is_header = F.col("line").rlike(f',"?{_DAY}"?(,[A-Za-z][^,]*)*$')
    heads = text.where(is_header).groupBy("file").agg(F.min("line").alias("header"))
    return text.where(~is_header & (F.col("line") != "")).join(heads, "file")


def read_long(spark: SparkSession, path: str, value: str) -> DataFrame:
    """METADATA, date, value, year, month of one wide table (a file or a folder of parts), however many dates it has."""
    columns = [c.strip('"') for c in spark.read.text(path).limit(1).collect()[0][0].split(",")]
    if not date_columns(columns):
        raise ValueError(f"{path} has no column named by a date")
    ids = tuple(c for c in METADATA if c in columns)
    return lines_to_long(read_lines(spark, path), value, ids)


def _typed(df: DataFrame) -> DataFrame:
    casts = {c: F.col(c).try_cast(t) for c, t in (("BASIN_ID", "double"), ("area_km2", "double")) if c in df.columns}
    df = df.withColumns(casts)
    return df.withColumn("BASIN_ID", F.col("BASIN_ID").cast("long")) if "BASIN_ID" in df.columns else df


def _run_name() -> Column:
    """The run's file name in `file`: of the file, or of the folder whose part it is."""
    name = F.regexp_extract("file", r"([^/\\=]+\.csv)(?:/[^/\\]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_runs(spark: SparkSession, paths: str | list[str], value: str, ids: tuple[str, ...] = METADATA, climate_models: tuple[str, ...] = CLIMATE_MODELS) -> DataFrame:
    """Long panel of all run files below the paths, with RUN columns from their names; files named otherwise are left out.

    A run's table may be one file or a folder of parts of that name.
    """
    run = parse_run_file(_run_name(), climate_models)
    rows = read_lines(spark, paths).withColumn("_run", run).where("_run IS NOT NULL")
    tagged = rows.select("header", "line", F.col("_run.hydro_model").alias("hydro_model"), F.col("_run.climate_model").alias("climate_model"), F.col("_run.scenario").alias("ssp_scenario"))
    return lines_to_long(tagged, value, ids, RUN)


def load_runs(spark: SparkSession, folder: str, variable: str, frequency: str, hydro_models: list[str], climate_models: list[str], scenarios: list[str], period: str) -> DataFrame:
    """Long panel of every run that has a file; missing files are logged, none at all is an error.

    All files are read by one scan, and their lines tagged by the file's name.
    """
    wanted = {run_file(variable, frequency, h, c, s, period): (h, c, s) for h in hydro_models for c in climate_models for s in scenarios}
    there = {name: path for path in files.listed(folder) if (name := path.rstrip("/").rpartition("/")[2]) in wanted}
    for name in wanted.keys() - there.keys():
        log.warning("no file %s in %s", name, folder)
    if not there:
        raise FileNotFoundError(f"no run of {variable} {frequency} in {folder}")
    runs = spark.createDataFrame([(n, *wanted[n]) for n in there], "_name string, hydro_model string, climate_model string, ssp_scenario string")  # one row a run
    rows = read_lines(spark, list(there.values())).withColumn("_name", _run_name()).join(F.broadcast(runs), "_name")
    return lines_to_long(rows, variable, METADATA, RUN)


def read_panel(spark: SparkSession, path: str, value: str, fmt: str = "parquet") -> DataFrame:
    """A long panel of the canonical schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(panel_schema(value)).option("header", True).csv(path)
