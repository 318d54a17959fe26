"""Dates, ages and month arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def parse_compact_date(col: Column) -> Column:
    """``yyyyMMdd`` text to date; bad or empty text gives null."""
    return F.try_to_date(col, "yyyyMMdd")


def age_at(when: Column, born: Column) -> Column:
    """Age in years as a double."""
    return F.datediff(when, born) / F.lit(DAYS_PER_YEAR)


def days_to_age(age: float) -> int:
    """Days after birth on which ``age_at`` first reaches ``age``."""
    return math.ceil(age * DAYS_PER_YEAR)


def month_of(day: Column) -> Column:
    """Month number of a date: year * 12 + month - 1."""
    return F.year(day) * 12 + F.month(day) - 1


def month_start(number: Column) -> Column:
    return F.make_date(
        F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)
    )


def year_month(number: Column) -> tuple[Column, Column]:
    """Year and month of a month number."""
    return F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int")


def month_label(year: Column, month: Column) -> Column:
    """``Jan 2021``."""
    return F.date_format(F.make_date(year, month, F.lit(1)), "MMM yyyy")
