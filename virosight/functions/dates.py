"""Column functions on dates and decimal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = 365.25


def parse_date(text: Column) -> Column:
    """Date of ``YYYY-MM-DD`` whose unknown parts, written XX, count as 01; null if it is none."""
    return F.try_to_date(F.replace(text, F.lit("XX"), F.lit("01")), "yyyy-MM-dd")


def decimal_year(date: Column) -> Column:
    """Year plus days since its first over 365.25."""
    return F.year(date) + (F.dayofyear(date) - 1) / F.lit(DAYS)


def calendar_date(x: Column) -> Column:
    """First of the year plus the rounded share of 365.25 days."""
    year = F.floor(x).cast("int")
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.round((x - F.floor(x)) * F.lit(DAYS)).cast("int"))


def year_difference(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS)


def add_years(date: Column, years: Column | float) -> Column:
    """Date moved by the rounded number of days in ``years``."""
    years = F.lit(years) if isinstance(years, (int, float)) else years
    return F.date_add(date, F.round(years * F.lit(DAYS)).cast("int"))


def ordinal(date: Column) -> Column:
    """Proleptic ordinal: 1 January of year 1 is day 1."""
    return F.unix_date(date) + 719163


def repaired_date(text: Column, key: Column, spec: str = "year") -> Column:
    """Dates kept by a collection-date rule: ``full`` needs a whole date, ``year`` a year at least.

    A year without a whole date gets a month drawn from a hash of ``key`` and
    the first day.  Null otherwise.
    """
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    if spec == "full":
        return whole
    month = (F.pmod(F.xxhash64(key), F.lit(12)) + 1).cast("int")
    year = F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4).try_cast("int"))
    return F.coalesce(whole, F.make_date(year, month, F.lit(1)))


def is_current(date: Column, now: Column, window_years: float) -> Column:
    """Is the age in years above 0 and below the window?"""
    age = year_difference(now, date)
    return (age > 0) & (age < window_years)
