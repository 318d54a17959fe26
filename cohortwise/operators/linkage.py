"""How many vaccinations link to the study population, by age and sex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions import predicates as p
from cohortwise.functions.bands import REPORT_BANDS, assign_band
from cohortwise.functions.semantics import if_else
from cohortwise.operators.checks import Day, nulls_last

LINKED, NOT_LINKED = "Linked", "Not linked"
# A person with a null flag is neither; wide reports give them columns of their own.
UNKNOWN = "NA"


def linkage_cells(
    df: DataFrame,
    vacc_date: Day,
    death_date: Day,
    dose: str,
    min_age: float | None = None,
    max_age: float | None = None,
) -> DataFrame:
    """Vaccinated people by link status, age band and sex.

    A few dozen rows from one pass over the persons; every report is made of
    them.  Carries the sum and the number of known ages for the mean.
    """
    age = F.col("age_when_eligible_years")
    people = df.filter(p.alive_on(F.col("dod"), p.day(death_date))).filter(
        p.given_by(F.col(f"{dose}_vacc_date"), vacc_date) == 1
    )
    window = p.age_window(age, min_age, max_age)
    people = people if window is None else people.filter(window)
    return people.groupBy(
        if_else(p.linked_in_country(), F.lit(LINKED), F.lit(NOT_LINKED)).alias("linked"),
        assign_band(age, REPORT_BANDS).alias("age_group"),
        F.coalesce("gender_vacc", F.lit("Unknown")).alias("sex"),
    ).agg(
        F.count("*").alias("n"), F.sum(age).alias("age_sum"), F.count(age).alias("age_n")
    )


def _share(df: DataFrame, *within: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*within))
    return df.withColumn("proportion", F.col("n") / total * 100)


def linkage_overall(cells: DataFrame) -> DataFrame:
    """Vaccinations by link status and their share of all."""
    return _share(cells.groupBy("linked").agg(F.sum("n").alias("n")))


def linkage_mean_age(cells: DataFrame) -> DataFrame:
    mean = F.try_divide(F.sum("age_sum"), F.sum("age_n").cast("double"))
    return cells.groupBy("linked").agg(mean.alias("mean_age"))


def linkage_wide(cells: DataFrame, by: str, within: str) -> DataFrame:
    """Number and share per link status, side by side, one row per value of ``by``.

    Shares add to 100 within each value of ``within``: ``by`` itself for how
    many link, ``linked`` for how the linked are distributed.
    """
    counts = _share(cells.groupBy("linked", by).agg(F.sum("n").alias("n")), within)
    status = F.coalesce("linked", F.lit(UNKNOWN))
    states = (LINKED, NOT_LINKED, UNKNOWN)
    wide = (
        counts.withColumn("linked", status)
        .groupBy(by)
        .pivot("linked", list(states))
        .agg(F.first("n").alias("n"), F.first("proportion").alias("proportion"))
    )
    return wide.select(
        by, *[F.col(f"{s}_{v}").alias(f"{v}_{s}") for v in ("n", "proportion") for s in states]
    )


def linkage_reports(cells: DataFrame) -> dict[str, DataFrame]:
    """The six linkage reports in display order, by name, from (written) ``linkage_cells``."""
    return {
        "overall": linkage_overall(cells),
        "linked_by_age": linkage_wide(cells, "age_group", "age_group").orderBy(
            *nulls_last("age_group")
        ),
        "linked_by_sex": linkage_wide(cells, "sex", "sex").orderBy(*nulls_last("sex")),
        "mean_age": linkage_mean_age(cells),
        "ages_of_linked": linkage_wide(cells, "age_group", "linked").orderBy(
            *nulls_last("age_group")
        ),
        "sexes_of_linked": linkage_wide(cells, "sex", "linked").orderBy(*nulls_last("sex")),
    }


def linkage_report(
    df: DataFrame,
    vacc_date: Day,
    death_date: Day,
    dose: str,
    min_age: float | None = None,
    max_age: float | None = None,
) -> dict[str, DataFrame]:
    """The six linkage reports of persons; each is a plan over the persons of its own."""
    return linkage_reports(linkage_cells(df, vacc_date, death_date, dose, min_age, max_age))
