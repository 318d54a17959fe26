"""Row predicates of the study population and of the checks."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv


def day(value: date | str | None) -> Column:
    """A date literal from a date or ISO text."""
    return F.lit(value).cast("date")


def alive_on(died: Column, when: Column) -> Column:
    """Died on the day or later, or not at all."""
    return died.isNull() | (died >= when)


def absent_or_from(when: Column, floor: date | str) -> Column:
    """No date, or a date not before the floor (the date is evaluated once)."""
    return F.coalesce(when >= day(floor), F.lit(True))


def age_window(age: Column, low: float | None = None, high: float | None = None) -> Column | None:
    """``low <= age < high`` with either bound optional; None when both are."""
    bounds = []
    if low is not None:
        bounds.append(age >= low)
    if high is not None:
        bounds.append(age < high)
    return reduce(and_, bounds) if bounds else None


def country_of(region_code: Column) -> Column:
    return F.substring(region_code, 1, 1)


def linked(flags: Iterable[str] = fv.LINK_FLAGS) -> Column:
    return reduce(and_, [F.col(f) == 1 for f in flags])


def linked_in_country(
    flags: Iterable[str] = fv.LINK_FLAGS,
    region_code: str = "rgn_derived",
    prefix: str = fv.COUNTRY_PREFIX,
) -> Column:
    """All link flags set and the region code starts with the country letter."""
    return linked(flags) & (country_of(F.col(region_code)) == prefix)


def given_by(when: Column, cutoff: date | str | None) -> Column:
    """1 when a date is present and (with a cut-off) not after it, else 0."""
    hit = when.isNotNull() if cutoff is None else when.isNotNull() & (when <= day(cutoff))
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))
