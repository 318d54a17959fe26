"""A monthly run from the linked person table to the published files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.config import PublicationText, RunConfig, standard_rules, standard_specs
from cohortwise.operators import publication
from cohortwise.operators.areas import attach_areas, merge_small_areas
from cohortwise.operators.characteristics import characteristic_values, derive_characteristics
from cohortwise.operators.check_cells import (
    CheckVariant,
    LinkageVariant,
    check_cells,
    death_cells_of,
    dose_trend_of,
    linkage_cells_of,
    missing_of,
    rate_by_age_of,
)
from cohortwise.operators.checks import death_reports
from cohortwise.operators.counts import monthly_counts_all
from cohortwise.operators.disclosure import disclosure_report, suppress
from cohortwise.operators.linkage import linkage_reports
from cohortwise.operators.population import load_person, static_filters
from cohortwise.operators.rates import adapt_standard_population
from cohortwise.operators.tables import rate_tables
from cohortwise.sources.staging import read_or_compute
from cohortwise.sources.writers import output_name, write_csv, write_periods


def study_population(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Filtered persons with every characteristic and area column."""
    persons = derive_characteristics(static_filters(load_person(raw)))
    return merge_small_areas(attach_areas(persons, lookup))


AREA_COLUMNS = ["imd_quintile", "imd_quintile_la", "imd_quintile_region", "la_derived"]
MOST_AREA_VALUES = 1_000  # of all area columns; each value lengthens the search of a person's code


def study_values(lookup: DataFrame) -> dict[str, list[str]]:
    """The texts that the columns of the study population can have, as ``count_cells`` takes them.

    Those of the area columns are read off the (written) lookup; if it has very many they are left out, and
    counts are then by text.
    """
    texts = merge_small_areas(lookup.select(AREA_COLUMNS)).select(
        *[F.col(c).cast("string").alias(c) for c in AREA_COLUMNS])
    pairs = texts.unpivot([], AREA_COLUMNS, "name", "value").filter("value IS NOT NULL").distinct()
    found = sorted(tuple(r) for r in pairs.limit(MOST_AREA_VALUES + 1).collect())
    if len(found) > MOST_AREA_VALUES:
        return characteristic_values()
    return characteristic_values() | {c: [v for name, v in found if name == c] for c in AREA_COLUMNS}


def all_counts(
    persons: DataFrame, run: RunConfig, values: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    return monthly_counts_all(persons, run, standard_specs(run), values)


def all_rates(
    counts: DataFrame, standard: DataFrame, poisson: DataFrame, run: RunConfig
) -> DataFrame:
    return rate_tables(counts, adapt_standard_population(standard), poisson, run)


def published_rows(rates: DataFrame, run: RunConfig, text: PublicationText) -> DataFrame:
    """Suppressed, long and labelled rows."""
    safe = suppress(rates, standard_rules(run.min_age))
    return publication.publish(publication.rates_long(safe), run, text)


def check_variants(run: RunConfig) -> tuple[CheckVariant, CheckVariant]:
    """Persons alive at the end of the run: of any age, and within the ages of the run."""
    end = run.period_end
    return (
        CheckVariant("all", death_date=end, reports=("dose_trend", "missing")),
        CheckVariant("run", end, end, end, run.min_age),
    )


def run_check_cells(persons: DataFrame, run: RunConfig) -> DataFrame:
    """The cells of every report on persons, from one scan of them."""
    end = run.period_end
    linked = LinkageVariant(end, end, "first", run.min_age) if run.run_linkage else None
    by_age = CheckVariant("known_age", end, end, reports=("rate_by_age",))
    return check_cells(persons, (*check_variants(run), by_age), linked)


def data_checks(cells: DataFrame, run: RunConfig, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Check reports without and with the period-end and age filters, from (written) cells."""
    reports = death_reports(death_cells_of(cells))
    for v in check_variants(run):
        reports[f"dose_trend_{v.name}"] = dose_trend_of(cells, v.name)
        # Without an age filter ages are still those of the end of the run.
        by_age = "known_age" if v.age_date is None else v.name
        reports[f"rate_by_age_{v.name}"] = rate_by_age_of(cells, by_age)
        reports[f"missing_{v.name}"] = missing_of(cells, v.name, columns)
    return reports


@dataclass(frozen=True)
class Lookups:
    """Reference tables of a run; ``areas`` is the table of ``area_lookup``."""

    areas: DataFrame
    standard_population: DataFrame
    poisson: DataFrame


def run_month(
    raw: DataFrame,
    lookups: Lookups,
    run: RunConfig,
    text: PublicationText,
    folder: str,
    report: Callable[[str, DataFrame], None] | None = None,
) -> dict[str, str]:
    """Carry out a run and write its files below ``folder``; returns their paths.

    Counts and rates are written first and read back by what follows, so an
    interrupted run resumes from them (``run_counts=False``).  Their names hold
    the run month, the minimum age and the version of the data, so a run never
    reads what another month has left.  ``report`` is handed every check report
    as a DataFrame, to show or to store; all of them are read off cells that come
    from one scan of the persons and are written below ``folder`` as well.
    """
    spark = raw.sparkSession
    run.require_standard_age()
    base = folder.rstrip("/")
    paths = {
        "counts": f"{base}/{output_name('rates_exposures', run)}",
        "rates": f"{base}/{output_name('df_agg', run)}",
        "dataset": f"{base}/{output_name('monthly_vaccination_rates', run)}",
        "metadata": f"{base}/{output_name('vaccination_metadata_lookup', run)}",
        "periods": f"{base}/{output_name('periods', run)}",
    }

    if report is not None and (run.run_data_checks or run.run_linkage):
        persons = load_person(raw)
        path = f"{base}/{output_name('check_cells', run)}"
        cells = read_or_compute(spark, path, lambda: run_check_cells(persons, run))
        if run.run_data_checks:
            for name, df in data_checks(cells, run, persons.columns).items():
                report(name, df)
        if run.run_linkage:
            for name, df in linkage_reports(linkage_cells_of(cells)).items():
                report(f"linkage_{name}", df)

    def counted() -> DataFrame:
        # Written first: the size of the lookup is then known, and persons needn't be shuffled to it.
        stored = read_or_compute(
            spark, f"{base}/{output_name('areas', run)}", lambda: lookups.areas)
        return all_counts(study_population(raw, stored), run, study_values(stored))

    counts = read_or_compute(
        spark,
        paths["counts"],
        counted,
        recompute=run.run_counts,
        partition_by=("call",),
    )
    rates = read_or_compute(
        spark,
        paths["rates"],
        lambda: all_rates(counts, lookups.standard_population, lookups.poisson, run),
    )
    if report is not None and run.run_disclosure_checks:
        for name, df in disclosure_report(rates).items():
            report(f"disclosure_{name}", df)
    published = published_rows(rates, run, text)
    write_periods(publication.dataset(published), paths["dataset"])
    write_csv(publication.metadata(published), paths["metadata"])
    write_csv(publication.period_calendar(spark, run), paths["periods"])
    return paths
