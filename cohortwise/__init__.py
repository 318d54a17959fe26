"""Cohort uptake statistics on Spark."""

from cohortwise.config import (
    CountSpec,
    PublicationText,
    RunConfig,
    SuppressionRule,
    standard_rules,
    standard_specs,
)

__all__ = [
    "CountSpec",
    "PublicationText",
    "RunConfig",
    "SuppressionRule",
    "standard_rules",
    "standard_specs",
]
