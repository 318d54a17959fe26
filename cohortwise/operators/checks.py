"""Checks of the linked table: deaths, dose trends, rates by age, missing values."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.functions import predicates as p
from cohortwise.functions.bands import REPORT_BANDS, assign_band
from cohortwise.functions.dates import age_at
from cohortwise.functions.semantics import sum_or_zero, text_slice

Day = date | str | None


def nulls_last(*names: str) -> list:
    return [F.col(n).asc_nulls_last() for n in names]


def death_cells(df: DataFrame) -> DataFrame:
    """People by registration text, text year and month of death, and date of death.

    One pass over the persons; the four death reports are made of these rows, of
    which there are a few per calendar day.
    """
    return df.groupBy("dor", "dodyr", "dodmt", "dod").agg(F.count("*").alias("n"))


def _people() -> Column:
    return F.sum("n").alias("n")


def registrations_by_month(cells: DataFrame) -> DataFrame:
    """People by year and month written in the registration text; null is a group."""
    year = text_slice(F.col("dor"), 1, 4).try_cast("double")
    month = text_slice(F.col("dor"), 5, 6).try_cast("double")
    return cells.groupBy(year.alias("doryr"), month.alias("dormt")).agg(_people())


def registrations_by_day(cells: DataFrame, floor: str = fv.DEATH_REPORT_FLOOR) -> DataFrame:
    """People by registration text from the floor on, compared as text."""
    return cells.filter(F.col("dor") >= floor).groupBy("dor").agg(_people())


def deaths_by_month(cells: DataFrame) -> DataFrame:
    keys = [F.col(c).try_cast("double").alias(c) for c in ("dodyr", "dodmt")]
    return cells.groupBy(*keys).agg(_people())


def deaths_by_day(cells: DataFrame, floor: str = fv.DEATH_REPORT_FLOOR) -> DataFrame:
    return cells.filter(F.col("dod") >= p.day(floor)).groupBy("dod").agg(_people())


def death_reports(cells: DataFrame) -> dict[str, DataFrame]:
    """The four death reports in display order, by name, from (written) ``death_cells``."""
    return {
        "registrations_by_month": registrations_by_month(cells).orderBy(
            *nulls_last("doryr", "dormt")
        ),
        "registrations_by_day": registrations_by_day(cells).orderBy(*nulls_last("dor")),
        "deaths_by_month": deaths_by_month(cells).orderBy(*nulls_last("dodyr", "dodmt")),
        "deaths_by_day": deaths_by_day(cells).orderBy(*nulls_last("dod")),
    }


def death_counts(df: DataFrame) -> dict[str, DataFrame]:
    """The four death reports of persons; each is a plan over the persons of its own."""
    return death_reports(death_cells(df))


def check_population(
    df: DataFrame,
    death_date: Day = None,
    age_date: Day = None,
    min_age: float | None = None,
    max_age: float | None = None,
) -> DataFrame:
    """Linked residents alive on ``death_date`` and within the ages on ``age_date``.

    Adds ``country`` and ``age``.  Without ``age_date`` the age is null, so an
    age bound then drops everyone.
    """
    out = df.filter(p.linked_in_country())
    if death_date is not None:
        out = out.filter(p.alive_on(F.col("dod"), p.day(death_date)))
    out = out.withColumns(
        {
            "country": p.country_of(F.col("rgn_derived")),
            "age": age_at(p.day(age_date), F.col("dob")),
        }
    )
    window = p.age_window(F.col("age"), min_age, max_age)
    return out if window is None else out.filter(window)


def dose_trend(
    df: DataFrame,
    doses: Sequence[str] = ("first", "second"),
    death_date: Day = None,
    age_date: Day = None,
    min_age: float | None = None,
    max_age: float | None = None,
) -> DataFrame:
    """Doses by day with running totals, for several doses in one pass.

    Rows are in display order: by dose as asked for, then by day; people without
    the dose are the last row of the dose (null date).  The running total orders
    the days of a dose, one row per calendar day.
    """
    people = check_population(df, death_date, age_date, min_age, max_age)
    columns = {f"{d}_vacc_date": d for d in doses}
    daily = (
        people.select(*[F.col(c).cast("date").alias(d) for c, d in columns.items()])
        .unpivot([], list(columns.values()), "dose", "vacc_date")
        .groupBy("dose", "vacc_date")
        .agg(F.count("*").alias("n"))
    )
    upto = (
        Window.partitionBy("dose")
        .orderBy(F.col("vacc_date").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    place = F.array_position(F.array(*[F.lit(d) for d in doses]), F.col("dose"))
    return daily.withColumn("n_cum", F.sum("n").over(upto)).orderBy(
        place, *nulls_last("vacc_date")
    )


def rate_by_age(
    df: DataFrame,
    death_date: Day,
    age_date: Day,
    vacc_date: Day = None,
    min_age: float | None = None,
    max_age: float | None = None,
    doses: Sequence[str] = ("first", "second"),
) -> DataFrame:
    """People and share with each dose by age band, in order of its label, unknown age last."""
    people = check_population(df, death_date, age_date, min_age, max_age)
    bands = people.groupBy(assign_band(F.col("age"), REPORT_BANDS).alias("age_group")).agg(
        F.count("*").alias("n"),
        *[
            F.avg(p.given_by(F.col(f"{d}_vacc_date"), vacc_date)).alias(f"{d}_rate")
            for d in doses
        ],
    )
    return bands.orderBy(*nulls_last("age_group"))


def missing_profile(
    df: DataFrame,
    death_date: Day,
    age_date: Day = None,
    min_age: float | None = None,
    max_age: float | None = None,
) -> DataFrame:
    """Nulls per column, ``country`` and ``age`` included: one pass, one row per column.

    Rows are ordered by the number missing, then by name.
    """
    people = check_population(df, death_date, age_date, min_age, max_age)
    nulls = people.agg(
        *[sum_or_zero(F.col(c).isNull().cast("long")).alias(c) for c in people.columns]
    )
    return nulls.unpivot([], nulls.columns, "variable", "missing").orderBy("missing", "variable")
