"""Registered queries against their SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
import check_queries
from cohortwise.config import CountSpec, standard_rules, standard_specs
from cohortwise.operators import counts, disclosure
from cohortwise.operators.tables import RATE_TABLES, rate_tables
from cohortwise.sources.readers import default_poisson_limits
from driver_queries import mapping, oracle, spark_queries
from tests.conftest import SF

# The rest are compared by check_queries.py; these cover every operator module.
NAMES = [
    "monthly_total", "band_age_esp", "recode_not_in_null", "static_filter_nulls", "dose_trend_all",
    "missing_profile", "linkage_by_band_wide", "area_quintile_la", "lookup_left_join_fanout",
    "monthly_counts_min_age_exposure", "asr_by_exposure", "crude_region_age", "suppress_rules",
    "publish_metadata", "published_files", "csv_header_order", "resumed_stage", "person_table_scan",
    "asr_care_home", "missing_profile_order", "rate_by_age_order", "dose_trend_order",
    "shared_deaths_by_month", "shared_dose_trend", "shared_rate_by_age", "shared_missing_profile",
    "shared_linkage_by_band", "incremental_month", "rate_guards", "fingerprinted_stage",
    "poisson_limits_exact", "csv_good_rows", "csv_refused_lines", "bounded_period_files",
    "person_full_scan", "output_names",
]


@pytest.fixture(scope="module")
def db():
    return check_queries.connect(SF)


#: These write a table on purpose and read it back.
SINKS = {"published_files", "csv_header_order", "resumed_stage", "incremental_month", "rate_guards",
         "fingerprinted_stage", "csv_good_rows", "csv_refused_lines", "bounded_period_files", "output_names"}


def test_every_query_has_sql():
    assert set(spark_queries.queries()) == set(oracle.oracle_sql())


def test_nothing_runs_before_the_action(spark, monkeypatch):
    """Apart from reading the schema of the driver tables, which is done here beforehand."""
    tables = {t: mapping.read(spark, SF, t) for t in ("lineitem", "part", "nation")}
    monkeypatch.setattr(mapping, "read", lambda spark, sf_dir, table: tables[table])
    spark_queries.study(spark, SF)  # the inputs of a run are stored once
    context = spark.sparkContext
    context.setJobGroup("planning", "plans of all queries")
    try:
        for name, query in spark_queries.queries().items():
            if name not in SINKS:
                query(spark, SF)
                assert not context.statusTracker().getJobIdsForGroup("planning"), name
    finally:
        context.setJobGroup("tests", "tests")


@pytest.mark.parametrize("min_age", [18, 50])
def test_every_rule_withholds_rows_that_the_thresholds_leave(spark, min_age):
    run = spark_queries.RUN if min_age == 18 else spark_queries.RUN_50
    sf = "/root/testdata/sf0.01"
    named = {"region": ("ethnicity", "religion", "tenure"), "la": ("nssec_agg", "language")}
    specs = [
        CountSpec(s.name, tuple(e for e in s.exposures if e in named[s.name]), s.area, s.first_period)
        for s in standard_specs(run) if s.name in named
    ]
    counted = counts.monthly_counts_all(spark_queries.study(spark, sf), run, specs)
    tables = [t for t in RATE_TABLES if t.name in ("exposure_region", "la_exposure")]
    rates = rate_tables(counted, spark_queries.weights(spark), default_poisson_limits(spark), run,
                        tables).checkpoint()
    left = disclosure.suppress(rates).where("vaccinated is not null")
    withheld = [left.where(disclosure.rule_condition(rule)).count() for rule in standard_rules(min_age)]
    assert all(withheld), withheld


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    outcome = check_queries.compare(spark, db, name, SF)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 66 and "age_standardised_rate" in df.columns
