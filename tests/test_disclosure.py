import pytest

from cohortwise import SuppressionRule, standard_rules
from cohortwise.operators import disclosure
from cohortwise.operators.rates import RATE_COLUMNS
from cohortwise.operators.tables import AGG_COLUMNS

SCHEMA = (
    "vaccine_number string, year int, month int, exposure string, group string, "
    "SubCategory string, Sex string, population long, vaccinated long, "
    + ", ".join(f"{c} double" for c in RATE_COLUMNS)
)


def row(population=100, vaccinated=50, dose="second", year=2021, month=1, exposure="ethnicity",
        group="Bangladeshi", area="London", sex="Persons"):
    return (dose, year, month, exposure, group, area, sex, population, vaccinated, *[1.5] * 6)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def withheld(spark, rows, rules=(), limit=10):
    out = disclosure.suppress(table(spark, *rows), rules, limit).collect()
    for r in out:
        blank = r["vaccinated"] is None
        assert all((r[c] is None) == blank for c in RATE_COLUMNS) and r["population"] is not None
    return [r["vaccinated"] is None for r in out]


def test_thresholds_on_both_sides(spark):
    rows = [row(100, v) for v in (0, 5, 9, 10, 50, 90, 91, 95, 100)]
    assert withheld(spark, rows) == [True, True, True, False, False, False, True, True, True]


def test_rules_of_a_run_from_18(spark):
    rules = standard_rules(18)
    rows = [
        row(area="North East"), row(area="East Midlands", month=2), row(area="South West"),
        row(area="North East", month=3), row(area="North East", sex="Male"),
        row(area="North East", dose="first", year=2020, month=12),
        row(area="North East", dose="first", year=2021, month=12),
        row(area="North East", exposure="religion", group="Jewish"),
        row(area="North East", exposure="religion", group="Sikh"),
        row(area=None), row(area="North East", group=None), row(area="North East", sex=None),
    ]
    assert withheld(spark, rows, rules) == [
        True, True, False, False, False, True, False, True, False, False, False, False,
    ]


def test_rules_of_a_run_from_50_leave_fields_open(spark):
    rules = standard_rules(50)
    rows = [
        row(area="Rutland", exposure="nssec_agg", group="Not classified", year=2022, month=7),
        row(area="Derby", exposure="nssec_agg", group="7 Routine occupations"),
        row(area="Derby", exposure="language", group=None, month=8),
        row(area="Derby", exposure="language", group="Main language", month=9),
        row(area="South West"), row(area="North East", exposure="tenure", group="Other"),
        row(area="North East", exposure="tenure", group="Other", month=2),
    ]
    assert withheld(spark, rows, rules) == [True, False, True, False, True, True, False]


def test_overlapping_rules_keep_one_row_and_suppression_is_idempotent(spark):
    rules = [SuppressionRule(exposure="ethnicity"), SuppressionRule(groups=("Bangladeshi",))]
    df = table(spark, row(), row(group="Mixed"), row(exposure="tenure", group="Owned"))
    once = disclosure.suppress(df, rules)
    assert once.count() == 3 and once.columns == AGG_COLUMNS
    assert disclosure.suppress(once, rules).collect() == once.collect()


def test_unknown_age_has_no_rules():
    with pytest.raises(ValueError, match="Non-standard"):
        standard_rules(30)


def test_report(spark):
    rows = [row(100, 5), row(100, 95, month=2), row(100, 50), row(20, 8, month=2), row(12, 6)]
    df = table(spark, *rows)
    assert tuple(disclosure.disclosure_counts(df).first()) == (5, 3, 2)
    report = disclosure.disclosure_report(df)
    assert len(report) == 7
    assert report["rows"].first()[0] == 5 and report["vaccinated_below"].first()[0] == 3
    assert report["not_vaccinated_below"].first()[0] == 2
    months = sorted(tuple(r) for r in report["vaccinated_below_by_month"].collect())
    assert months == [(2021, 1, 2), (2021, 2, 1)]
    listing = report["not_vaccinated_below_rows"].collect()
    assert [(r["month"], r["not_vaccinated"]) for r in listing] == [(1, 6), (2, 5)]


def test_listing_has_nulls_last(spark):
    df = table(spark, row(100, 1, group=None), row(100, 2, group="Mixed"))
    assert [r["group"] for r in disclosure.disclosure_listing(df).collect()] == ["Mixed", None]


RULED = {
    18: """
second 2021 1 ethnicity Black Caribbean/Bangladeshi North East/East Midlands
second 2021 2 ethnicity Black Caribbean/Bangladeshi North East/East Midlands
second 2021 1 religion Jewish/Buddhist North East/East Midlands
second 2021 2 religion Jewish/Buddhist North East/East Midlands
first 2020 12 ethnicity Black Caribbean/Bangladeshi North East/East Midlands
""",
    50: """
second 2021 1 ethnicity Black Caribbean/Bangladeshi North East/East Midlands/South West
second 2021 2 ethnicity Black Caribbean/Bangladeshi North East/East Midlands/South West
second 2021 1 religion Jewish/Buddhist North East/East Midlands
second 2021 2 religion Jewish/Buddhist North East/East Midlands
second 2021 1 tenure Not classified/Other North East/East Midlands
first 2020 12 ethnicity Black Caribbean/Bangladeshi North East/East Midlands
""",
}
GROUPS = {"ethnicity": ("Black Caribbean", "Bangladeshi", "Chinese"),
          "religion": ("Jewish", "Buddhist", "Sikh"), "tenure": ("Not classified", "Other", "Owned"),
          "nssec_agg": ("Not classified", "8 Never worked and long-term unemployed", "7 Routine"),
          "language": ("Main language", "Not well")}
AREAS = ("North East", "East Midlands", "South West", "London", "Rutland", "Derby")
OPEN = {("nssec_agg", "Not classified"), ("nssec_agg", "8 Never worked and long-term unemployed")}


def listed(min_age, dose, year, month, exposure, group, area):
    """Whether the published list of a run withholds a row, written out line by line."""
    for line in RULED[min_age].strip().splitlines():
        d, y, m, e, rest = line.split(" ", 4)
        groups = next(g for g in ("Black Caribbean/Bangladeshi", "Jewish/Buddhist",
                                  "Not classified/Other") if rest.startswith(g))
        areas = rest[len(groups) + 1 :].split("/")
        if (d, int(y), int(m), e) == (dose, year, month, exposure) and (
                group in groups.split("/") and area in areas):
            return True
    if min_age == 50 and area in ("Rutland", "Derby"):
        if (exposure, group) in OPEN:
            return True
        return (exposure, dose, year, month) == ("language", "second", 2021, 8)
    return False


@pytest.mark.parametrize("min_age", [18, 50])
def test_rules_equal_the_written_out_list(spark, min_age):
    cases = [
        (dose, year, month, exposure, group, area)
        for dose in ("first", "second", "third")
        for year, month in ((2020, 12), (2021, 1), (2021, 2), (2021, 3), (2021, 8), (2022, 1))
        for exposure, groups in GROUPS.items() for group in groups for area in AREAS
    ]
    rows = [row(dose=d, year=y, month=m, exposure=e, group=g, area=a) for d, y, m, e, g, a in cases]
    assert withheld(spark, rows, standard_rules(min_age)) == [listed(min_age, *c) for c in cases]
