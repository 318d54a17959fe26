"""A whole run on the smallest driver tables, and the files it leaves."""

import os

import pytest
from pyspark.sql import functions as F

from cohortwise import PublicationText, RunConfig
from cohortwise.operators.areas import area_lookup
from cohortwise.plans.monthly_run import Lookups, run_month
from cohortwise.sources import readers, staging, writers
from driver_queries import mapping
from tests.conftest import SF

RUN = RunConfig(2021, 6)
HEADER = ("Theme,ChartTitle,IndDropdown,TimePeriodLabel,CategoryType,Category,SubCategory,Sex,"
          "Count,Denominator,Value,LCI,UCI")


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    areas = area_lookup(
        mapping.imd(spark, SF), mapping.postcodes(spark, SF), mapping.area_names(spark, SF)
    )
    lookups = Lookups(
        areas, readers.default_standard_population(spark), readers.default_poisson_limits(spark)
    )
    raw = mapping.raw_persons(spark, SF)
    reports = {}
    text = PublicationText(source="Register")
    paths = run_month(raw, lookups, RUN, text, folder, lambda n, df: reports.update({n: df.count()}))
    return raw, lookups, text, folder, paths, reports


def test_files(spark, finished):
    *_, paths, reports = finished
    assert os.path.basename(paths["dataset"]) == "monthly_vaccination_rates_2021_06_18+"
    periods = spark.read.option("header", True).csv(paths["periods"]).orderBy(
        F.col("position").cast("int")
    )
    labels = [r["TimePeriodLabel"] for r in periods.collect()]
    assert labels[0] == "Dec 2020" and labels[-1] == "Jun 2021"
    folders = {d.split("=")[1].replace("%20", " "): os.path.join(paths["dataset"], d)
               for d in os.listdir(paths["dataset"]) if d.startswith("period=")}
    assert set(folders) == set(labels)
    for folder_ in folders.values():
        for name in os.listdir(folder_):
            if name.startswith("part-"):
                with open(os.path.join(folder_, name)) as file:
                    assert file.readline().rstrip() == HEADER
    dataset = writers.read_periods(spark, paths["dataset"])
    one = writers.read_periods(spark, paths["dataset"], "Jun 2021")
    assert {r[0] for r in one.select("TimePeriodLabel").distinct().collect()} == {"Jun 2021"}
    small = dataset.filter("cast(Count as int) < 10 or cast(Denominator as int) - cast(Count as int) < 10")
    assert small.count() == 0
    metadata = spark.read.option("header", True).option("multiLine", True).csv(paths["metadata"])
    charts = dataset.select("ChartTitle").distinct()
    assert charts.join(metadata, "ChartTitle", "left_anti").count() == 0
    assert len([n for n in reports if n.startswith("disclosure_")]) == 7
    assert len([n for n in reports if n.startswith("linkage_")]) == 6
    assert {"dose_trend_all", "rate_by_age_run", "missing_all", "deaths_by_day"} <= set(reports)


def test_resume_reads_the_counts_on_disk(spark, finished):
    raw, lookups, text, folder, paths, _ = finished
    before = sorted(os.listdir(paths["counts"]))
    again = RunConfig(2021, 6, run_counts=False, run_data_checks=False, run_linkage=False)
    assert run_month(raw.limit(0), lookups, again, text, folder) == paths
    assert sorted(os.listdir(paths["counts"])) == before
    assert spark.read.parquet(paths["rates"]).count() > 0


def test_nonstandard_age_is_refused(finished):
    raw, lookups, text, folder, *_ = finished
    with pytest.raises(ValueError, match="Non-standard"):
        run_month(raw, lookups, RunConfig(2021, 6, min_age=40), text, folder)


def test_read_or_compute(spark, tmp_path):
    path = str(tmp_path / "t")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for recompute in (False, False, True):
        assert staging.read_or_compute(spark, path, compute, recompute).count() == 3
    assert len(calls) == 2


def test_counts_of_another_month_or_version_are_not_reused(spark, finished):
    raw, lookups, text, folder, paths, _ = finished
    for run in (RunConfig(2021, 5, run_counts=False), RunConfig(2021, 6, dataset_version="v2",
                                                                run_counts=False)):
        other = run_month(raw, lookups, run, text, folder)
        assert not set(other.values()) & set(paths.values())
        months = spark.read.parquet(other["counts"]).agg(F.max(F.col("year") * 100 + F.col("month")))
        assert months.first()[0] == 202100 + run.run_month


def test_csv_sources_match_by_header(spark, tmp_path):
    path = str(tmp_path / "imd.csv")
    with open(path, "w") as f:
        f.write("IMD_QUINTILE,extra,LSOA11CD,IMD_RANK\n2,x,E01,17\n1,y,E02,bad\n")
    assert sorted(map(tuple, readers.read_imd(spark, path).collect())) == [
        ("E01", 17, 2), ("E02", None, 1),
    ]
    limits = str(tmp_path / "poisson")
    writers.write_csv(readers.default_poisson_limits(spark), limits)
    assert readers.read_poisson_limits(spark, limits).filter("Deaths = 50").first()["L"] == 0.742219
    esp = str(tmp_path / "esp")
    writers.write_csv(readers.default_standard_population(spark), esp)
    assert readers.read_standard_population(spark, esp).agg(F.sum("ESP")).first()[0] == 100_000


def test_person_table_reads_only_its_columns(spark):
    raw = mapping.raw_persons(spark, SF).withColumn("unused", F.lit(1))
    raw.write.mode("overwrite").saveAsTable("persons_v1")
    table = readers.read_person_table(spark, "persons", "_v1")
    assert len(table.columns) == 27 and table.count() == raw.count()
    assert "unused" in readers.read_table(spark, "persons_v1").columns
    spark.sql("DROP TABLE persons_v1")


def test_names():
    run = RunConfig(2023, 1)
    assert writers.output_name("x", run) == "x_2023_01_18+"
    assert writers.output_name("x", RunConfig(2023, 1, 50, dataset_version="v7")) == "x_2023_01_50+_v7"


def test_filters_reach_the_scan(spark, tmp_path):
    from cohortwise.operators.population import load_person, static_filters

    path = str(tmp_path / "persons")
    mapping.raw_persons(spark, SF).write.parquet(path)
    df = static_filters(load_person(spark.read.parquet(path))).select("sex_census")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters:"):]
    assert "EqualTo(cen_pr_flag,1)" in pushed and "EqualTo(uresindpuk11_census,1)" in pushed
    assert "hlqpuk11_census" not in plan
