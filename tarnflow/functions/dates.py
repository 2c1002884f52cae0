"""Time axes and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = r"^\s*(second|minute|hour|day|month|year)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})"
#: Units of a fixed length, as days.
_DAYS = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}


def decode_time(value: Column, units: Column) -> Column:
    """DATE of a number in "<unit> since Y-M-D"; NULL where the units can't be read.

    Numbers are rounded half to even in their unit; times of day are dropped.
    Months and years keep the day, or take the month's last.
    """
    part = lambda n: F.regexp_extract(units, _UNITS, n)
    known = units.rlike(_UNITS)
    ref = F.when(known, F.make_date(part(2).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("int")))
    whole = F.bround(value.cast("double"))
    unit = part(1)
    seconds = F.when(unit == "hour", whole * 3600).when(unit == "minute", whole * 60).when(unit == "second", whole)
    return (
        F.when(unit == "day", F.date_add(ref, whole.cast("int")))
        .when(unit == "month", F.add_months(ref, whole.cast("int")))
        .when(unit == "year", F.add_months(ref, (whole * 12).cast("int")))
        .when(seconds.isNotNull(), F.date_add(ref, F.floor(seconds / 86400).cast("int")))
    )


def year(date: Column) -> Column:
    return F.year(date).cast("int")


def month(date: Column) -> Column:
    return F.month(date).cast("int")


def mid_month(y: Column, m: Column) -> Column:
    """The month's representative date, its 15th."""
    return F.make_date(y, m, F.lit(15))


def month_name(m: Column) -> Column:
    """Jan .. Dec."""
    return F.date_format(F.make_date(F.lit(2001), m, F.lit(1)), "MMM")


def decade(y: Column) -> Column:
    return (F.floor(y / 10) * 10).cast("int")


def in_period(y: Column, first: int, last: int) -> Column:
    """Both ends count."""
    return y.between(first, last)
