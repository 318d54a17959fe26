"""Long form, labels, published dataset, metadata and the period calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.config import PublicationText, RunConfig
from cohortwise.fixed_values import AXIS_TEXT, INDICATOR_TEXT
from cohortwise.functions.bands import GROUP_BANDS
from cohortwise.functions.dates import month_label
from cohortwise.functions.predicates import day
from cohortwise.functions.semantics import capitalise, lookup_label, not_in_keep_null

STATS = ("rate", "lower_ci", "upper_ci")
RATE_TYPES = ("crude", "age_standardised")
LONG_COLUMNS = [
    "vaccine_number", "rate_type", "year", "month", "exposure", "group", "SubCategory", "Sex",
    "population", "vaccinated", *STATS,
]
DATASET_COLUMNS = [
    "Theme", "ChartTitle", "IndDropdown", "TimePeriodLabel", "CategoryType", "Category",
    "SubCategory", "Sex", "Count", "Denominator", "Value", "LCI", "UCI",
]
METADATA_COLUMNS = ["ChartTitle", "yAxisLabel", "Footnote", "Source"]
PUBLISHED_COLUMNS = [
    "Theme", "ChartTitle", "IndDropdown", "TimePeriod", "TimePeriodLabel", "CategoryType",
    "Category", "SubCategory", "Sex", "Count", "Denominator", "Value", "LCI", "UCI",
    "yAxisLabel", "ValueNote", "Footnote", "Source",
]


def rates_long(df: DataFrame) -> DataFrame:
    """One row per rate type; age-standardised rows only where ages are not split."""
    one_per_type = F.array(
        *[
            F.struct(
                F.lit(kind).alias("rate_type"), *[F.col(f"{kind}_{s}").alias(s) for s in STATS]
            )
            for kind in RATE_TYPES
        ]
    )
    keep = [c for c in LONG_COLUMNS if c not in ("rate_type", *STATS)]
    not_by_age = (F.col("exposure").isNull() | (F.col("exposure") != "age_group")) & (
        not_in_keep_null(F.col("SubCategory"), GROUP_BANDS.labels[1:])
    )
    return (
        df.select(*keep, F.inline(one_per_type))
        .filter((F.col("rate_type") == "crude") | not_by_age)
        .select(*LONG_COLUMNS)
    )


def _footnote(title: Column, run: RunConfig, text: PublicationText) -> Column:
    general = text.general_footnote.format(period_end=f"{run.period_end:%d %B %Y}")
    later = {
        text.titles.get(e, e): text.age_footnote.format(min_age=a)
        for e, a in text.exposure_min_age.items()
        if run.min_age < a
    }
    default_age = F.lit(text.age_footnote.format(min_age=run.min_age))
    age = lookup_label(title, later, default_age) if later else default_age
    before, after = text.census_footnote.split("{title}")
    census = F.concat(F.lit(before), title, F.lit(after))
    exposure = F.when(title.isNull(), F.lit("")).otherwise(
        lookup_label(title, text.exposure_footnotes, census)
    )
    return F.concat_ws("\n", F.lit(general), age, exposure, F.lit(text.area_footnote))


def _dose_text(template: str, run: RunConfig, text: PublicationText, rate_type: Column) -> Column:
    before, after = template.split("{rate_type}")
    after_by_dose = {
        dose: after.format(min_age=run.min_age, phrase=phrase)
        for dose, phrase in text.dose_phrases.items()
    }
    return F.concat(F.lit(before), rate_type, lookup_label(F.col("vaccine_number"), after_by_dose))


def publish(df: DataFrame, run: RunConfig, text: PublicationText) -> DataFrame:
    """Labelled rows of the publication from the long form."""
    rate_type = F.translate("rate_type", "_", "-")
    title = lookup_label(F.col("exposure"), text.titles, F.col("exposure"))
    indicator = F.col("IndDropdown")
    return (
        df.withColumns({"rate_type": rate_type, "CategoryType": title})
        .withColumns(
            {
                "Theme": F.lit(text.theme),
                "IndDropdown": _dose_text(INDICATOR_TEXT, run, text, F.col("rate_type")),
                "yAxisLabel": _dose_text(AXIS_TEXT, run, text, capitalise(F.col("rate_type"))),
                "TimePeriod": month_label(F.col("year"), F.col("month")),
                "ValueNote": F.lit(text.value_note),
                "Footnote": _footnote(F.col("CategoryType"), run, text),
                "Source": F.lit(text.source),
            }
        )
        .withColumns(
            {
                "ChartTitle": F.when(F.col("CategoryType").isNull(), indicator).otherwise(
                    F.concat(indicator, F.lit(", by "), F.col("CategoryType"))
                ),
                "TimePeriodLabel": F.col("TimePeriod"),
            }
        )
        .withColumnsRenamed(
            {
                "group": "Category", "vaccinated": "Count", "population": "Denominator",
                "rate": "Value", "lower_ci": "LCI", "upper_ci": "UCI",
            }
        )
        .select(*PUBLISHED_COLUMNS)
    )


def dataset(published: DataFrame) -> DataFrame:
    return published.select(*DATASET_COLUMNS)


def metadata(published: DataFrame) -> DataFrame:
    return published.select(*METADATA_COLUMNS).distinct()


def period_calendar(spark: SparkSession, run: RunConfig) -> DataFrame:
    """Periods of the run in order: ``position, year, month, TimePeriodLabel``."""
    months = F.sequence(day(run.first_day), day(run.last_month_start), F.expr("interval 1 month"))
    return (
        spark.range(1)
        .select(F.posexplode(months).alias("position", "start"))
        .select(
            (F.col("position") + 1).alias("position"),
            F.year("start").alias("year"),
            F.month("start").alias("month"),
            F.date_format("start", "MMM yyyy").alias("TimePeriodLabel"),
        )
    )
