"""Study population: loading, static filters, person-months."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.config import RunConfig
from cohortwise.functions import predicates as p
from cohortwise.functions.dates import parse_compact_date


def load_person(raw: DataFrame) -> DataFrame:
    """Select, rename and type the columns of the linked person table."""
    dates = {f"{dose}_vacc_date" for dose in fv.DOSES}
    return raw.select(
        *[
            (parse_compact_date(F.col(old)) if new in dates else F.col(old)).alias(new)
            for old, new in fv.PERSON_COLUMNS.items()
        ]
    )


def static_filters(df: DataFrame, dose_floors: Mapping[str, str] = fv.DOSE_FLOORS) -> DataFrame:
    """Linked usual residents of the country without implausibly early doses."""
    keep = p.linked_in_country() & (F.col("uresindpuk11_census") == 1)
    for dose, floor in dose_floors.items():
        keep = keep & p.absent_or_from(F.col(f"{dose}_vacc_date"), floor)
    return df.filter(keep)


def expand_months(df: DataFrame, run: RunConfig) -> DataFrame:
    """One row per input row and month of the run, with year and month."""
    months = F.sequence(
        p.day(run.first_day), p.day(run.last_month_start), F.expr("interval 1 month")
    )
    return (
        df.withColumn("month_start", F.explode(months))
        .withColumns({"year": F.year("month_start"), "month": F.month("month_start")})
        .drop("month_start")
    )
