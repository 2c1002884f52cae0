"""Finding the files of model runs."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import parse_run_file
from . import files


def run_directory(base: str, hydro_model: str, climate_model: str, scenario: str, data_period: str) -> str:
    """base / hydro model / (historical or the scenario) / CLIMATE MODEL."""
    return "/".join((base.rstrip("/"), hydro_model, "historical" if data_period == "historical" else scenario, climate_model.upper()))


def find_cubes(base: str, hydro_model: str, climate_model: str, scenario: str, data_period: str, variable: str, resolution: str, test_file: str = "") -> list[str]:
    """Sorted .nc files whose own name holds the variable and the resolution; `test_file` bypasses the search."""
    if test_file:
        if not files.exists(test_file):
            raise FileNotFoundError(test_file)
        return [test_file]
    folder = run_directory(base, hydro_model, climate_model, scenario, data_period)
    named = ((p, p.rpartition("/")[2]) for p in files.listed(folder, "*.nc"))
    found = [p for p, name in named if variable in name and resolution in name]
    if not found:
        raise FileNotFoundError(f"no {variable} {resolution} file in {folder}")
    return found


def glob_cubes(folder: str, model: str, scenario: str, variable: str, resolution: str = "monthly") -> list[str]:
    """Files named *model*scenario*variable*resolution*.nc; none is no error."""
    pattern = f"*{model}*{scenario}*{variable}*{resolution}*.nc".lower()
    return [p for p in files.listed(folder, "*.[nN][cC]") if fnmatch.fnmatchcase(p.rpartition("/")[2].lower(), pattern)]


def run_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path and the parsed parts of every run file in a folder, by Spark's own listing; other files are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return listed.withColumn("run", parse_run_file(F.col("path"))).where("run IS NOT NULL").select("path", "run.*")


def available_models(files: DataFrame, variable: str, frequency: str) -> DataFrame:
    """One row: sorted hydro_models and climate_models that have files of the variable and frequency."""
    own = files.where((F.col("variable") == variable) & (F.col("frequency") == frequency))
    return own.agg(F.array_sort(F.collect_set("hydro_model")).alias("hydro_models"), F.array_sort(F.collect_set("climate_model")).alias("climate_models"))
