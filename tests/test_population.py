from datetime import date

from pyspark.sql import functions as F

from cohortwise import RunConfig
from cohortwise.operators.characteristics import derive_characteristics
from cohortwise.operators.population import expand_months, load_person, static_filters

FIRST = "vaccine_number_1_vaccination_date_vacc"
SECOND = "vaccine_number_2_vaccination_date_vacc"
THIRD = "vaccine_number_3_vaccination_date_vacc"


def kept(people, *differences):
    rows = [{**d, "lsoa_derived": str(i)} for i, d in enumerate(differences)]
    out = static_filters(load_person(people(*rows)))
    return sorted(int(r["lsoa_derived"]) for r in out.collect())


def test_flags_must_be_one(people):
    names = ("cen_pr_flag", "present_in_census", "present_in_gpes", "uresindpuk11_census")
    differences = [{}] + [{n: v} for n in names for v in (0, None)]
    assert kept(people, *differences) == [0]


def test_country(people):
    codes = ["E12000001", "E99", "W92000004", None, ""]
    assert kept(people, *[{"rgn_derived": c} for c in codes]) == [0, 1]


def test_dose_floors(people):
    assert kept(
        people,
        {FIRST: "20201207"}, {FIRST: "20201208"}, {FIRST: "bad"}, {FIRST: ""},
        {SECOND: "20201207"}, {SECOND: "20201208"},
        {THIRD: "20210915"}, {THIRD: "20210916"},
    ) == [1, 2, 3, 5, 7]


def test_month_expansion(people):
    out = expand_months(load_person(people({}, {})), RunConfig(2021, 2))
    months = [tuple(r) for r in out.select("year", "month").distinct().orderBy("year", "month").collect()]
    assert months == [(2020, 12), (2021, 1), (2021, 2)] and out.count() == 6
    assert expand_months(load_person(people({})), RunConfig(2023, 1)).count() == 26


def labels(people, raw, derived, codes):
    df = derive_characteristics(load_person(people(*[{raw: c} for c in codes])))
    rows = {r[raw]: r[derived] for r in df.select(raw, derived).collect()}
    return [rows[c] for c in codes]


def test_recodes(people):
    assert labels(people, "sex_census", "sex", ["1", "2", "9", None]) == [
        "Male", "Female", "Female", None,
    ]
    assert labels(
        people, "ethpuk11_census", "ethnicity",
        ["1", "2", "4", "5", "8", "9", "10", "11", "12", "13", "14", "15", "16", "99", "2.5", "XX", None],
    ) == [
        "White British", "White other", "White other", "Mixed", "Mixed", "Indian", "Pakistani",
        "Bangladeshi", "Chinese", "Other", "Black African", "Black Caribbean", "Other", "Other",
        None, None, None,
    ]
    assert labels(people, "relpuk11_census", "religion", ["1", "9", "X", "10", None]) == [
        "No religion", "Religion Not Stated", None, None, None,
    ]
    assert labels(people, "cob_census", "country_of_birth", ["921", "926", "927", "", None]) == [
        "UK", "UK", "Non-UK", "Non-UK", None,
    ]
    assert labels(people, "mainlangprf11_census", "language", ["1", "2", "5", "X", "6", None]) == [
        "Main language", "Not main language", "Not main language", "Not classified", None, None,
    ]
    assert labels(people, "hlqpuk11_census", "education", ["10", "16", "XX", "17", None]) == [
        "No qualification", "Other", "Not classified", None, None,
    ]
    assert labels(people, "disability_census", "disability", ["1", "2", "3", "4"]) == [
        "Limited a lot", "Limited a little", "Not Limited", None,
    ]
    assert labels(people, "care_home_pr19", "care_home", ["x", None]) == ["Yes", "No"]
    assert labels(people, "tenhuk11_census", "tenure", ["0", "2", "3", "8", "9", "10", None]) == [
        "Owned", "Other", "Social rented", "Private rented", "Other", None, "Not classified",
    ]
    assert labels(people, "rural_urban_derived", "rural_urban", ["C2", "D1", "Z1", None]) == [
        "Urban", "Rural", None, None,
    ]
    assert labels(people, "rgn_derived", "region", ["E12000001", "E12000009", "E12000010", None]) == [
        "North East", "South West", None, None,
    ]


def test_occupation_ranges(people):
    codes = ["0.5", "1", "3.9", "4", "7", "7.5", "8", "9.9", "10", "12", "13", "14", "14.9", "15",
             "17", "17.5", "18", "-1", "XX", None]
    got = labels(people, "nsshuk11_census", "nssec_agg", codes)
    assert [g and g[0] for g in got] == [
        None, "1", "1", "2", "3", "3", "4", "4", "5", "6", "7", "8", "8", "N", "N", None, None, None,
        "N", "N",
    ]


def test_load_types(people):
    df = load_person(people({FIRST: "20210105", "dob_census": None, "dod_deaths": date(2022, 1, 1)}))
    types = dict(df.dtypes)
    assert types["first_vacc_date"] == types["dob"] == types["dod"] == "date"
    assert df.select(F.col("first_vacc_date")).first()[0] == date(2021, 1, 5)
    assert len(df.columns) == 27
