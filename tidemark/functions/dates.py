"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def month_label(day: Column, padded: bool = True) -> Column:
    """``2018-01``, which sorts by time; ``2018-1`` with ``padded=False``."""
    if padded:
        return F.date_format(day, "yyyy-MM")
    return F.concat(F.year(day), F.lit("-"), F.month(day))


def date_parts(day: Column) -> dict[str, Column]:
    """The six calendar features. Day 1 of the week is Sunday; weeks are ISO weeks."""
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": F.dayofweek(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
    }


DATE_PART_NAMES = ("year", "month", "day_of_month", "day_of_week", "day_of_year", "week_of_year")


def years_open(opened_year: str, as_of_year: int | Column) -> Column:
    return F.lit(as_of_year) - F.col(opened_year)


def period_number(at: Column, unit: str) -> Column:
    """A whole number that grows by one with each month or day."""
    if unit == "month":
        return F.year(at) * 12 + F.month(at)
    if unit == "day":
        return F.unix_date(at)
    raise ValueError(f"unit must be 'month' or 'day', not {unit!r}")


def period_step(unit: str) -> Column:
    return F.expr({"month": "interval 1 month", "day": "interval 1 day"}[unit])
