"""Declared schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

from cohortwise.fixed_values import PERSON_COLUMNS

_INT = {"cen_pr_flag", "present_in_census", "present_in_gpes", "uresindpuk11_census"}
_DATE = {"dob_census", "dod_deaths"}
_DOUBLE = {"age_at_rollout_years_vacc"}


def _person_type(name: str) -> T.DataType:
    if name in _INT:
        return T.IntegerType()
    if name in _DATE:
        return T.DateType()
    if name in _DOUBLE:
        return T.DoubleType()
    return T.StringType()


def raw_person_schema() -> T.StructType:
    return T.StructType([T.StructField(n, _person_type(n)) for n in PERSON_COLUMNS])


IMD = T.StructType(
    [
        T.StructField("LSOA11CD", T.StringType()),
        T.StructField("IMD_RANK", T.IntegerType()),
        T.StructField("IMD_QUINTILE", T.IntegerType()),
    ]
)
AREA_NAMES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ltla22cd", "utla22cd", "utla22nm")]
)
STANDARD_POPULATION = T.StructType(
    [T.StructField("agegroup", T.StringType()), T.StructField("ESP", T.DoubleType())]
)
POISSON = T.StructType(
    [
        T.StructField("Deaths", T.LongType()),
        T.StructField("L", T.DoubleType()),
        T.StructField("U", T.DoubleType()),
    ]
)
