"""Plans that must stay as they are: scans, shuffles, sizes of generated code."""

import re

import pytest

from cohortwise.operators.check_cells import check_cells
from cohortwise.plans.monthly_run import check_variants, run_check_cells, study_values
from driver_queries import spark_queries as q
from tests.conftest import SF
from tests.plans import largest_method, plan_of

HEADLINES = ["monthly_total", "missing_profile", "rate_by_age", "monthly_counts_all", "full_run_18",
             "publish_dataset", "shared_dose_trend", "incremental_month", "asr_deprivation", "la_total"]


@pytest.fixture
def plain(spark):
    """Without adaptive execution the whole plan is there before it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", HEADLINES)
def test_generated_methods_are_compiled(plain, name):
    assert 0 < largest_method(q.queries()[name](plain, SF)) <= 8000


@pytest.mark.parametrize("name", ["study_population_areas", "asr_deprivation", "la_total"])
def test_persons_are_not_shuffled(plain, name):
    """Persons meet the lookup in their scan task; the first exchange carries partial sums."""
    plan = plan_of(q.queries()[name](plain, SF))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Exchange (hash|range)partitioning", line):
            below = re.sub(r"[^\w]*(\*?\(\d+\))?\s*", "", lines[i + 1], count=1)
            assert "Aggregate" in below or "Sort" in below or "Window" in below, lines[i + 1]


def test_one_scan_for_all_reports(plain):
    """The reports of a run, linkage and deaths included, are cells of one aggregation over one scan."""
    plan = plan_of(run_check_cells(q.persons(plain, SF), q.RUN))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_too_many_columns_are_refused(spark):
    people = q.persons(spark, SF)
    wide = people.selectExpr("*", *[f"1 AS x{i}" for i in range(200)])
    with pytest.raises(ValueError, match="columns"):
        check_cells(wide, check_variants(q.RUN))


@pytest.mark.parametrize("name", ["full_run_18", "full_run_18_rows", "published_run_18", "monthly_counts_all"])
def test_run_counts_cells_by_number(plain, name):
    """The persons' changes reach the aggregation with one number as key, in order of age and month."""
    plan = plan_of(q.queries()[name](plain, SF))
    above, below = plan[:plan.rindex("Expand")], plan[plan.rindex("Expand"):]
    assert "Sort [place" in below and "Generate explode" in below
    sums = [line for line in above.splitlines() if "partial_sum(population" in line][-1]
    assert re.search(r"keys=\[[^,\]]+\]", sums), sums


def test_values_of_the_study_are_all_listed(spark):
    people = q.study(spark, SF)
    for name, values in study_values(q.lookup(spark, SF)).items():
        found = {r[0] for r in people.select(name).distinct().collect()} - {None}
        assert found <= set(values) and found, name
