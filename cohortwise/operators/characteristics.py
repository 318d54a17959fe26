"""Socio-demographic characteristics from coded census answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.functions.semantics import if_else, label_codes


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _doubles(labels: dict) -> dict:
    return {label: [float(c) for c in codes] for label, codes in labels.items()}


def ethnicity() -> Column:
    code = _number("ethpuk11_census")
    return F.when(code > fv.ETHNICITY_OTHER_ABOVE, F.lit(fv.ETHNICITY_OTHER)).otherwise(
        label_codes(code, _doubles(fv.ETHNICITY_LABELS))
    )


def country_of_birth() -> Column:
    return if_else(F.col("cob_census").isin(*fv.UK_BIRTH_CODES), F.lit("UK"), F.lit("Non-UK"))


def occupation() -> Column:
    code = _number("nsshuk11_census")
    low, high = fv.OCCUPATION_UNCLASSIFIED
    by_whole_number = {label: range(lo, hi) for lo, hi, label in fv.OCCUPATION_RANGES}
    return F.when(code.isNull() | code.between(low, high), F.lit(fv.NOT_CLASSIFIED)).otherwise(
        label_codes(F.floor(code).cast("int"), by_whole_number)
    )


def tenure() -> Column:
    code = F.col("tenhuk11_census")
    return F.when(code.isNull(), F.lit(fv.NOT_CLASSIFIED)).otherwise(
        label_codes(code, fv.TENURE_LABELS)
    )


def characteristic_columns() -> dict[str, Column]:
    """Every derived characteristic, as an expression over the person columns."""
    return {
        "sex": if_else(F.col("sex_census") == "1", F.lit("Male"), F.lit("Female")),
        "ethnicity": ethnicity(),
        "religion": label_codes(_number("relpuk11_census"), _doubles(fv.RELIGION_LABELS)),
        "country_of_birth": country_of_birth(),
        "language": label_codes(F.col("mainlangprf11_census"), fv.LANGUAGE_LABELS),
        "education": label_codes(F.col("hlqpuk11_census"), fv.EDUCATION_LABELS),
        "disability": label_codes(F.col("disability_census"), fv.DISABILITY_LABELS),
        "care_home": F.when(F.col("care_home_pr19").isNull(), F.lit("No")).otherwise(F.lit("Yes")),
        "nssec_agg": occupation(),
        "tenure": tenure(),
        "rural_urban": label_codes(F.col("rural_urban_derived"), fv.RURAL_URBAN_LABELS),
        "region": label_codes(F.col("rgn_derived"), fv.REGION_LABELS),
    }


def characteristic_values() -> dict[str, list[str]]:
    """The labels that each derived characteristic can have (null apart)."""
    occupations = [label for *_, label in fv.OCCUPATION_RANGES]
    return {
        "sex": ["Male", "Female"],
        "ethnicity": [*fv.ETHNICITY_LABELS, fv.ETHNICITY_OTHER],
        "religion": [*fv.RELIGION_LABELS],
        "country_of_birth": ["UK", "Non-UK"],
        "language": [*fv.LANGUAGE_LABELS],
        "education": [*fv.EDUCATION_LABELS],
        "disability": [*fv.DISABILITY_LABELS],
        "care_home": ["No", "Yes"],
        "nssec_agg": [fv.NOT_CLASSIFIED, *occupations],
        "tenure": [fv.NOT_CLASSIFIED, *fv.TENURE_LABELS],
        "rural_urban": [*fv.RURAL_URBAN_LABELS],
        "region": [*fv.REGION_LABELS],
    }


def derive_characteristics(df: DataFrame, recodes: dict[str, Column] | None = None) -> DataFrame:
    """Add the derived characteristics (all of them unless ``recodes`` is given)."""
    return df.withColumns(characteristic_columns() if recodes is None else recodes)
