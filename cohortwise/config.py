"""Run parameters and the specifications the operators are driven by."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date

from cohortwise import fixed_values as fv


def month_number(year: int, month: int) -> int:
    """Months since year 0, the integer every calendar comparison uses."""
    return year * 12 + month - 1


@dataclass(frozen=True)
class RunConfig:
    """One monthly run: everything from ``first_period`` to the run month."""

    run_year: int
    run_month: int
    min_age: int = 18
    max_age: int = 1000
    first_period: tuple[int, int] = fv.FIRST_PERIOD
    dataset_version: str = ""
    run_data_checks: bool = True
    run_linkage: bool = True
    run_counts: bool = True
    run_disclosure_checks: bool = True

    @property
    def period_end(self) -> date:
        return date(
            self.run_year, self.run_month, calendar.monthrange(self.run_year, self.run_month)[1]
        )

    @property
    def first_day(self) -> date:
        return date(*self.first_period, 1)

    @property
    def last_month_start(self) -> date:
        return date(self.run_year, self.run_month, 1)

    @property
    def month_range(self) -> tuple[int, int]:
        """First and last month of the run as month numbers, both included."""
        return month_number(*self.first_period), month_number(self.run_year, self.run_month)

    def require_standard_age(self) -> None:
        """Publication tables exist for runs from age 18 and from age 50 only."""
        if self.min_age not in (18, 50):
            raise ValueError(f"Non-standard minimum age given: {self.min_age}")

    @property
    def age_specific(self) -> bool:
        return self.min_age == 18


@dataclass(frozen=True)
class CountSpec:
    """One counting call: a set of exposures broken down by one area-like column."""

    name: str
    exposures: tuple[str, ...]
    area: str
    first_period: tuple[int, int] | None = None


def standard_specs(run: RunConfig) -> tuple[CountSpec, CountSpec, CountSpec]:
    """The region, local-authority and sex calls of a standard run."""
    run.require_standard_age()
    dropped = () if run.min_age == 18 else fv.AREA_EXPOSURES_18_ONLY
    area_exposures = tuple(e for e in fv.AREA_EXPOSURES if e not in dropped)
    return (
        CountSpec("region", fv.REGION_EXPOSURES, "region"),
        CountSpec("la", area_exposures, "la_derived", fv.AREA_FIRST_PERIOD),
        CountSpec("sex", fv.SEX_EXPOSURES, "sex"),
    )


@dataclass(frozen=True)
class SuppressionRule:
    """Rows to withhold; ``None`` in a field matches any value, even null."""

    doses: tuple[str, ...] | None = None
    periods: tuple[tuple[int, int], ...] | None = None
    exposure: str | None = None
    groups: tuple[str, ...] | None = None
    areas: tuple[str, ...] | None = None
    sex: str | None = fv.SUPPRESSION_SEX


def standard_rules(min_age: int) -> tuple[SuppressionRule, ...]:
    if min_age not in fv.SUPPRESSION_RULES:
        raise ValueError(f"Non-standard minimum age given: {min_age}")
    return tuple(SuppressionRule(*line) for line in fv.SUPPRESSION_RULES[min_age])


@dataclass(frozen=True)
class PublicationText:
    """Texts of the published files.  ``source`` names the data owner's sources."""

    source: str
    theme: str = fv.THEME
    titles: dict[str, str] = field(default_factory=lambda: dict(fv.EXPOSURE_TITLES))
    exposure_footnotes: dict[str, str] = field(default_factory=lambda: dict(fv.EXPOSURE_FOOTNOTES))
    dose_phrases: dict[str, str] = field(default_factory=lambda: dict(fv.DOSE_PHRASES))
    exposure_min_age: dict[str, int] = field(default_factory=lambda: dict(fv.EXPOSURE_MIN_AGE))
    general_footnote: str = fv.GENERAL_FOOTNOTE
    age_footnote: str = fv.AGE_FOOTNOTE
    census_footnote: str = fv.CENSUS_FOOTNOTE
    area_footnote: str = fv.AREA_FOOTNOTE
    value_note: str = fv.VALUE_NOTE
