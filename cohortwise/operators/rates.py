"""Crude and directly age-standardised rates with confidence limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.functions.bands import band_limits
from cohortwise.functions.semantics import (
    clamp_high,
    clamp_low,
    if_else,
    round_to_base,
    sum_or_zero,
)
from cohortwise.sources.lookups import lookup_join

Z95 = 1.96
PER = 100_000.0
MISSING_WEIGHTS = "Missing population weights. Check the labels of the age groups"
RATE_COLUMNS = [
    f"{kind}_{stat}" for kind in ("crude", "age_standardised")
    for stat in ("rate", "lower_ci", "upper_ci")
]


def adapt_standard_population(standard: DataFrame) -> DataFrame:
    """Adult bands of the standard population, with the youngest one cut at 18."""
    band = F.col("agegroup")
    share = F.when(band == fv.SPLIT_BAND, F.lit(fv.SPLIT_SHARE)).otherwise(F.lit(1.0))
    merged = F.when(band.isin(*fv.YOUNG_ADULT_BANDS), F.lit(fv.YOUNG_ADULT_BAND)).otherwise(band)
    return (
        standard.filter(F.coalesce(~band.isin(*fv.CHILD_BANDS), F.lit(True)))
        .groupBy(merged.alias("age_group_esp"))
        .agg(sum_or_zero(F.col("ESP") * share).alias("ESP"))
    )


def complement_first_dose(df: DataFrame) -> DataFrame:
    """First-dose figures are published for people without a dose."""
    return df.withColumn(
        "vaccinated",
        if_else(
            F.col("vaccine_number") == "first",
            F.col("population") - F.col("vaccinated"),
            F.col("vaccinated"),
        ),
    )


def round_counts(df: DataFrame, base: int = 5) -> DataFrame:
    return df.withColumns({c: round_to_base(F.col(c), base) for c in ("population", "vaccinated")})


def require_weights(weight: Column, message: str = MISSING_WEIGHTS) -> Column:
    """The weight, raising an error in the task that meets a missing one."""
    return F.coalesce(weight, F.raise_error(F.lit(message)).cast("double"))


def in_age_range(label: Column, min_age: float, max_age: float) -> Column:
    """Band lies within the ages of the run."""
    lower, upper = band_limits(label)
    return (lower >= min_age) & (upper <= max_age)


def _crude(df: DataFrame) -> DataFrame:
    rate = F.try_divide(F.col("vaccinated").cast("double"), F.col("population").cast("double"))
    margin = Z95 * F.sqrt(F.try_divide(F.col("_r") * (1 - F.col("_r")), F.col("population")))
    return (
        df.withColumn("_r", rate)
        .withColumn("_m", margin)
        .withColumns(
            {
                "crude_rate": F.col("_r") * 100,
                "crude_lower_ci": clamp_low((F.col("_r") - F.col("_m")) * 100),
                "crude_upper_ci": clamp_high((F.col("_r") + F.col("_m")) * 100),
            }
        )
        .drop("_r", "_m")
    )


def _band_terms(df: DataFrame, weights: DataFrame, min_age: float, max_age: float) -> DataFrame:
    """Per band: the weight, the weighted rate and its variance.

    Input rows flagged ``standardise`` are kept within the age range and must
    have a weight; other rows pass through with empty terms.
    """
    standardise = F.col("standardise")
    within = in_age_range(F.col("age_group_esp"), min_age, max_age)
    weighted = lookup_join(df.filter(~standardise | within), weights, "age_group_esp")
    rate = F.try_divide(F.col("vaccinated") * PER, F.col("population").cast("double"))
    rounded = round_counts(weighted).withColumn(
        "ESP", F.when(standardise, require_weights(F.col("ESP")))
    )
    return rounded.withColumn("_rate", rate).withColumns(
        {
            "_expected": F.col("_rate") * F.col("ESP"),
            "_variance": F.try_divide(F.col("_rate") * F.col("_rate"), F.col("vaccinated"))
            * F.col("ESP") * F.col("ESP"),
        }
    )


def _standardised(df: DataFrame, poisson: DataFrame) -> DataFrame:
    """Rate and limits from the sums over bands.

    Limits are normal for counts of 100 and more (and for zero); below that the
    Poisson limits of the count are scaled to the variance of the rate.
    """
    limits = poisson.select(F.col("Deaths").cast("long").alias("vaccinated"), "L", "U")
    count = F.col("vaccinated")
    variance = F.try_divide(F.col("_variance"), F.col("ESP") * F.col("ESP"))
    normal = (count >= 100) | (count == 0)
    per_case = F.sqrt(F.try_divide(F.col("_var"), count))

    def limit(sign: int, ratio: str) -> Column:
        return F.when(normal, F.col("_asr") + sign * Z95 * F.sqrt("_var")).when(
            ~normal, F.col("_asr") + (F.col(ratio) * count - count) * per_case
        )

    return (
        lookup_join(df, limits, "vaccinated")
        .withColumns({"_asr": F.try_divide(F.col("_expected"), F.col("ESP")), "_var": variance})
        .withColumns(
            {
                "age_standardised_rate": F.col("_asr") / 1000,
                "age_standardised_lower_ci": clamp_low(limit(-1, "L") / 1000),
                "age_standardised_upper_ci": clamp_high(limit(1, "U") / 1000),
            }
        )
    )


def crude_rates(df: DataFrame, group_vars: Sequence[str]) -> DataFrame:
    """Crude percentage and normal limits per group; standardised columns are null."""
    summed = (
        round_counts(df)
        .groupBy(*group_vars)
        .agg(*[sum_or_zero(F.col(c)).alias(c) for c in ("population", "vaccinated")])
    )
    empty = {c: F.lit(None).cast("double") for c in RATE_COLUMNS if c.startswith("age_")}
    return _crude(summed).withColumns(empty).select(
        *group_vars, "population", "vaccinated", *RATE_COLUMNS
    )


def mixed_rates(
    df: DataFrame,
    weights: DataFrame,
    poisson: DataFrame,
    min_age: float,
    max_age: float,
    group_vars: Sequence[str],
) -> DataFrame:
    """Rates of groups of which some are standardised and some are crude only.

    ``weights`` have one row per band (``adapt_standard_population`` sums them) and ``poisson`` one per
    count (its readers see to that).  ``standardise`` says which, and is part of the group.  Both kinds go through
    the same aggregation, so the input is computed once.
    """
    keys = list(dict.fromkeys([*group_vars, "standardise"]))
    sums = ["population", "vaccinated", "_expected", "_variance", "ESP"]
    summed = (
        _band_terms(df, weights, min_age, max_age)
        .groupBy(*keys)
        .agg(*[sum_or_zero(F.col(c)).alias(c) for c in sums])
    )
    return _standardised(_crude(summed), poisson).select(
        *group_vars, "population", "vaccinated", *RATE_COLUMNS
    )


def age_standardised_rates(
    df: DataFrame,
    weights: DataFrame,
    poisson: DataFrame,
    min_age: float,
    max_age: float,
    group_vars: Sequence[str],
) -> DataFrame:
    """Crude and directly standardised percentages with limits per group.

    ``df`` has one row per group and ``age_group_esp``.  A band without cases
    keeps its weight in the denominator; a band absent from the group has none.
    """
    return mixed_rates(
        df.withColumn("standardise", F.lit(True)), weights, poisson, min_age, max_age, group_vars
    )
