"""Column names and schemas of the data model.

Grid:    time_idx, date, lat_idx, lon_idx, lat, lon, value
Area:    lat_idx, lon_idx, area_m2
Basins:  BASIN_ID, BCU_name, NAME, REGION, area_km2, rings
Panel:   BASIN_ID, BCU_name, NAME, REGION, area_km2, hydro_model, climate_model, ssp_scenario, date, <value>, year, month

A missing number is NULL everywhere; readers turn NaN and fill flags into it.
"""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = ("BASIN_ID", "BCU_name", "NAME", "REGION", "area_km2")
RUN = ("hydro_model", "climate_model", "ssp_scenario")
SERIES = ("BASIN_ID", *RUN)

GRID = T.StructType().add("time_idx", "integer").add("date", "date").add("lat_idx", "integer").add("lon_idx", "integer").add("lat", "double").add("lon", "double").add("value", "double")
AREA = T.StructType().add("lat_idx", "integer").add("lon_idx", "integer").add("area_m2", "double")
POINT = T.StructType().add("x", "double").add("y", "double")
BASINS = T.StructType().add("BASIN_ID", "long").add("BCU_name", "string").add("NAME", "string").add("REGION", "string").add("area_km2", "double").add("rings", T.ArrayType(T.ArrayType(POINT)))


def panel_schema(value: str) -> T.StructType:
    """The canonical long table of one variable."""
    s = T.StructType().add("BASIN_ID", "long").add("BCU_name", "string").add("NAME", "string").add("REGION", "string").add("area_km2", "double")
    for name in RUN:
        s = s.add(name, "string")
    return s.add("date", "date").add(value, "double").add("year", "integer").add("month", "integer")


# Model runs' names, as the ensembles use them.
HYDRO_MODELS = ("H08", "CWatM", "JULES-W2", "MIROC-INTEG-LAND", "WaterGAP2-2e")
CLIMATE_MODELS = ("gfdl-esm4", "ipsl-cm6a-lr", "mpi-esm1-2-hr", "mri-esm2-0", "ukesm1-0-ll")
SCENARIOS = ("ssp126", "ssp370", "ssp585")
VARIABLES = ("qtot", "qr")
