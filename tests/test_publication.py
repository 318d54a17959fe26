from datetime import date

from cohortwise import PublicationText, RunConfig
from cohortwise.operators import publication
from tests.test_disclosure import row, table

RUN = RunConfig(2023, 1)
TEXT = PublicationText(source="Register")


def test_run_dates():
    assert RUN.period_end == date(2023, 1, 31) and RunConfig(2024, 2).period_end == date(2024, 2, 29)
    assert RUN.month_range[1] - RUN.month_range[0] == 25


def test_long_form(spark):
    df = table(
        spark,
        row(exposure="age_group", group="18-29"), row(area="80+"), row(area="London"),
        row(area=None), row(exposure=None), row(exposure="age_group", area="18-29"),
    )
    out = publication.rates_long(df)
    assert out.columns == publication.LONG_COLUMNS
    kinds = {}
    for r in out.collect():
        kinds.setdefault((r["exposure"], r["SubCategory"]), []).append(r["rate_type"])
        assert (r["rate"], r["lower_ci"], r["upper_ci"]) == (1.5, 1.5, 1.5)
    both = ["age_standardised", "crude"]
    assert {k: sorted(v) for k, v in kinds.items()} == {
        ("age_group", "London"): ["crude"], ("ethnicity", "80+"): ["crude"],
        ("ethnicity", "London"): both, ("ethnicity", None): both, (None, "London"): both,
        ("age_group", "18-29"): ["crude"],
    }


def published(spark, run=RUN, **fields):
    df = publication.publish(publication.rates_long(table(spark, row(**fields))), run, TEXT)
    return {("age" if "age-standardised" in r["IndDropdown"] else "crude"): r for r in df.collect()}


def test_labels(spark):
    rows = published(spark, dose="first", exposure="ethnicity", month=3)
    r = rows["age"]
    assert r["IndDropdown"] == (
        "Cumulative age-standardised percentage of people aged 18+ who have not received a vaccination"
    )
    assert r["ChartTitle"] == r["IndDropdown"] + ", by Ethnic group"
    assert r["yAxisLabel"] == (
        "Age-standardised percentage of people aged 18+ who have not received a vaccination (%)"
    )
    assert rows["crude"]["yAxisLabel"].startswith("Crude percentage of people")
    assert (r["TimePeriod"], r["TimePeriodLabel"]) == ("Mar 2021", "Mar 2021")
    assert (r["Theme"], r["ValueNote"], r["Source"]) == ("Vaccinations", "NA", "Register")
    assert (r["Count"], r["Denominator"], r["Value"]) == (50, 100, 1.5)
    lines = r["Footnote"].split("\n")
    assert [line[0] for line in lines] == list("12345")
    assert "between 08 December 2020 and 31 January 2023 for residents" in lines[0]
    assert lines[2] == "3. These data only cover adults aged 18+"
    assert lines[3] == "4. Ethnic group was derived from the 2011 Census"


def footnotes(spark, **fields):
    return published(spark, **fields)["crude"]["Footnote"].split("\n")


def test_footnotes_by_exposure(spark):
    assert footnotes(spark, exposure="education")[2] == "3. These data only cover adults aged 30+"
    old = RunConfig(2023, 1, min_age=50)
    assert footnotes(spark, exposure="education", run=old)[2].endswith("aged 50+")
    assert "Index of Multiple Deprivation" in footnotes(spark, exposure="imd_quintile_la")[3]
    assert "communal establishments at the time" in footnotes(spark, exposure="tenure")[3]
    assert "full-time students" in footnotes(spark, exposure="nssec_agg")[3]
    # The title is written with a small u, so the census footnote applies.
    assert footnotes(spark, exposure="rural_urban")[3] == "4. Rural-urban was derived from the 2011 Census"
    assert footnotes(spark, exposure="Total")[3] == "4. Total was derived from the 2011 Census"
    missing = published(spark, exposure=None)["crude"]
    assert missing["Footnote"].split("\n")[3] == "" and missing["ChartTitle"] == missing["IndDropdown"]


def test_dataset_and_metadata(spark):
    df = publication.publish(
        publication.rates_long(table(spark, row(), row(month=2), row(area="East"))), RUN, TEXT
    )
    assert publication.dataset(df).columns == publication.DATASET_COLUMNS and df.count() == 6
    meta = publication.metadata(df)
    assert meta.columns == publication.METADATA_COLUMNS and meta.count() == 2


def test_calendar(spark):
    rows = [tuple(r) for r in publication.period_calendar(spark, RUN).orderBy("position").collect()]
    assert len(rows) == 26
    assert rows[0] == (1, 2020, 12, "Dec 2020") and rows[-1] == (26, 2023, 1, "Jan 2023")
