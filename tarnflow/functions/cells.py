"""Cell values: fill flags, missing values, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes from here on are fill flags, not data.
FILL = 1e15


def clean(value: Column, fill: float = FILL) -> Column:
    """NULL for NaN and for fill flags."""
    return F.when(F.isnan(value) | (F.abs(value) >= fill), None).otherwise(value)


def zero_if_missing(value: Column) -> Column:
    """0 for NULL and NaN."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def missing_share(value: Column) -> Column:
    """Aggregate: share of rows that are NULL or NaN."""
    return F.avg(F.when(value.isNull() | F.isnan(value), 1.0).otherwise(0.0))


def unit_factor(variable: str, days_per_year: float = 365.25) -> tuple[float, bool]:
    """Factor to km3 per year, and whether the value must be multiplied by the cell's area.

    dis is m3/s.  qtot and qr are kg/m2/s; a kilogram of water is a litre.
    """
    if variable == "dis":
        return days_per_year * 86400 * 1e-9, False
    if variable in ("qtot", "qr"):
        return days_per_year * 86400 * 1e-12, True
    raise ValueError(f"no unit conversion for variable {variable!r}")


def to_volume(value: Column, variable: str, area: Column | None = None, days_per_year: float = 365.25) -> Column:
    """value in km3 per year; area in m2, where the variable needs it."""
    factor, needs_area = unit_factor(variable, days_per_year)
    if not needs_area:
        return value * F.lit(factor)
    if area is None:
        raise ValueError(f"{variable} needs cell areas")
    return value * area * F.lit(factor)


def depth_mm_per_day(discharge: Column, area_m2: Column) -> Column:
    """Discharge (m3/s) over an area as millimetres of water a day; NULL for no area."""
    return F.when(area_m2 > 0, discharge * 86400.0 / area_m2 * 1000.0)
