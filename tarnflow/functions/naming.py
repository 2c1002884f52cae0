"""File names of runs: {variable}_{frequency}_{hydro model}_{climate model}_{scenario}_{period}.csv."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLIMATE_MODELS


def run_file(variable: str, frequency: str, hydro_model: str, climate_model: str, scenario: str, period: str) -> str:
    return f"{variable}_{frequency}_{hydro_model}_{climate_model}_{scenario}_{period}.csv"


def parse_run_file(path: Column, climate_models: tuple[str, ...] = CLIMATE_MODELS) -> Column:
    """STRUCT of the six parts; NULL for other suffixes, too few parts or an unknown climate model.

    The climate model, matched without regard to case, tells where the hydro
    model ends, which may hold underscores itself (they become hyphens).  The
    scenario is the part after it, whatever its name; the period is the last.
    """
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    models = "|".join(m.replace("-", r"\-") for m in climate_models)
    pattern = rf"^([^_]+)_([^_]+)_(.+?)_((?i:{models}))_([^_]+)_(?:.*_)?([^_]+)\.csv$"
    part = lambda n: F.regexp_extract(name, pattern, n)
    fields = F.struct(
        part(1).alias("variable"), part(2).alias("frequency"), F.replace(part(3), F.lit("_"), F.lit("-")).alias("hydro_model"),
        part(4).alias("climate_model"), part(5).alias("scenario"), part(6).alias("time_period"),
    )
    return F.when(name.rlike(pattern), fields)
