"""Disclosure reports and suppression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.config import SuppressionRule
from cohortwise.functions.semantics import is_true
from cohortwise.operators.rates import RATE_COLUMNS

LISTING_ORDER = ["vaccine_number", "year", "month", "exposure", "group", "SubCategory"]
CHECKS = ("vaccinated", "not_vaccinated")


def _low(check: str, limit: int) -> Column:
    if check == "vaccinated":
        return F.col("vaccinated") < limit
    return F.col("population") - F.col("vaccinated") < limit


def disclosure_counts(df: DataFrame, limit: int = fv.DISCLOSURE_LIMIT) -> DataFrame:
    """Number of rows, and of rows with few or nearly all vaccinated, in one pass."""
    return df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_low(check, limit)).alias(f"low_{check}") for check in CHECKS],
    )


def disclosure_by_month(
    df: DataFrame, limit: int = fv.DISCLOSURE_LIMIT, checks: Sequence[str] = CHECKS
) -> DataFrame:
    """Low rows per check and month, all checks in one pass; empty months are absent."""
    failed = F.array_compact(F.array(*[F.when(_low(c, limit), F.lit(c)) for c in checks]))
    return (
        df.select("year", "month", F.explode(failed).alias("check"))
        .groupBy("check", "year", "month")
        .agg(F.count("*").alias("n"))
    )


def disclosure_listing(
    df: DataFrame, check: str = "vaccinated", limit: int = fv.DISCLOSURE_LIMIT
) -> DataFrame:
    """The low rows themselves, ordered; nulls last."""
    rows = df if check == "vaccinated" else df.withColumn(
        "not_vaccinated", F.col("population") - F.col("vaccinated")
    )
    return rows.filter(_low(check, limit)).orderBy(
        *[F.col(c).asc_nulls_last() for c in LISTING_ORDER]
    )


def disclosure_report(df: DataFrame, limit: int = fv.DISCLOSURE_LIMIT) -> dict[str, DataFrame]:
    """The seven reports of a disclosure check, by name."""
    report = {"rows": df.agg(F.count("*").alias("n"))}
    for check in CHECKS:
        report[f"{check}_below"] = df.filter(_low(check, limit)).agg(F.count("*").alias("n"))
        report[f"{check}_below_by_month"] = disclosure_by_month(df, limit, [check]).drop("check")
        report[f"{check}_below_rows"] = disclosure_listing(df, check, limit)
    return report


def rule_condition(rule: SuppressionRule) -> Column:
    """Rows a rule matches; a field left open matches every value."""
    parts = []
    if rule.doses is not None:
        parts.append(F.col("vaccine_number").isin(*rule.doses))
    if rule.periods is not None:
        parts.append((F.col("year") * 100 + F.col("month")).isin(*[y * 100 + m for y, m in rule.periods]))
    for column, value in (("exposure", rule.exposure), ("Sex", rule.sex)):
        if value is not None:
            parts.append(F.col(column) == value)
    for column, values in (("group", rule.groups), ("SubCategory", rule.areas)):
        if values is not None:
            parts.append(F.col(column).isin(*values))
    return reduce(and_, parts) if parts else F.lit(True)


def disclosive(rules: Sequence[SuppressionRule], limit: int = fv.DISCLOSURE_LIMIT) -> Column:
    """Few vaccinated, few not vaccinated, or listed by a rule."""
    tests = [_low(check, limit) for check in CHECKS] + [rule_condition(r) for r in rules]
    return is_true(reduce(or_, [is_true(t) for t in tests]))


def suppress(
    df: DataFrame, rules: Sequence[SuppressionRule] = (), limit: int = fv.DISCLOSURE_LIMIT
) -> DataFrame:
    """Withhold the count and all rates of disclosive rows; the population stays."""
    flagged = df.withColumn("_withhold", disclosive(rules, limit))
    blank = {
        c: F.when(~F.col("_withhold"), F.col(c)) for c in ("vaccinated", *RATE_COLUMNS)
    }
    return flagged.withColumns(blank).drop("_withhold")
