from datetime import date

import pytest

from cohortwise.operators import checks, linkage
from cohortwise.operators.population import load_person

FIRST = "vaccine_number_1_vaccination_date_vacc"
SECOND = "vaccine_number_2_vaccination_date_vacc"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_deaths(people):
    df = load_person(people(
        {"dor_deaths": "20210305", "dodyr_deaths": "2021", "dodmt_deaths": "03",
         "dod_deaths": date(2021, 3, 1)},
        {"dor_deaths": "20201231", "dodyr_deaths": "XX", "dodmt_deaths": None,
         "dod_deaths": date(2020, 12, 31)},
        {},
    ))
    report = checks.death_counts(df)
    assert rows(report["registrations_by_month"]) == [(2020, 12, 1), (2021, 3, 1), (None, None, 1)]
    assert rows(report["registrations_by_day"]) == [("20210305", 1)]
    assert rows(report["deaths_by_month"]) == [(2021, 3, 1), (None, None, 2)]
    assert rows(report["deaths_by_day"]) == [(date(2021, 3, 1), 1)]


def test_dose_trend_runs_to_the_null_row(people):
    df = load_person(people(
        {FIRST: "20210102"}, {FIRST: "20210101"}, {FIRST: "20210102", SECOND: "20210301"}, {},
        {FIRST: "20210101", "dod_deaths": date(2021, 1, 5)}, {FIRST: "20210101", "cen_pr_flag": 0},
        {FIRST: "20210101", "rgn_derived": "W1"},
    ))
    out = checks.dose_trend(df, death_date="2021-01-31")
    first = sorted((r for r in rows(out) if r[0] == "first"), key=lambda r: r[3])
    assert first == [
        ("first", date(2021, 1, 1), 1, 1), ("first", date(2021, 1, 2), 2, 3), ("first", None, 1, 4),
    ]
    assert checks.dose_trend(df).filter("dose = 'second'").agg({"n": "sum"}).first()[0] == 5


def test_age_bound_without_date_drops_everyone(people):
    df = load_person(people({}))
    assert checks.dose_trend(df, min_age=18).count() == 0
    assert checks.dose_trend(df, age_date="2023-01-31", min_age=18).count() == 2


def test_rate_by_age(people):
    df = load_person(people(
        {FIRST: "20210105"}, {FIRST: "20220201"}, {}, {"dob_census": None, FIRST: "20210105"},
    ))
    out = checks.rate_by_age(df, "2022-01-31", "2022-01-31", vacc_date="2022-01-31")
    got = {r["age_group"]: (r["n"], r["first_rate"], r["second_rate"]) for r in out.collect()}
    assert got["40-49"] == (3, pytest.approx(1 / 3), 0.0) and got[None] == (1, 1.0, 0.0)
    anyway = checks.rate_by_age(df, "2022-01-31", "2022-01-31", min_age=18)
    assert rows(anyway) == [("40-49", 3, pytest.approx(2 / 3), 0.0)]


def test_missing_profile(people):
    df = load_person(people({}, {"dob_census": None, "sex_census": None}))
    out = dict(rows(checks.missing_profile(df, "2023-01-31", age_date="2023-01-31")))
    assert len(out) == 29
    assert (out["dob"], out["age"], out["country"], out["sex_census"], out["dod"]) == (1, 1, 0, 1, 2)
    empty = checks.missing_profile(df.limit(0), "2023-01-31")
    assert {r["missing"] for r in empty.collect()} == {0}


def test_linkage(people):
    given = {FIRST: "20210105", "age_at_rollout_years_vacc": 40.0, "vaccine_number_1_gender_vacc": "F"}
    df = load_person(people(
        given, {**given, "age_at_rollout_years_vacc": 60.0}, {**given, "cen_pr_flag": 0},
        {**given, "present_in_gpes": None}, {**given, "vaccine_number_1_gender_vacc": None},
        {**given, "age_at_rollout_years_vacc": 17.9}, {**given, FIRST: "20230201"}, {},
        {**given, "dod_deaths": date(2023, 1, 30)}, {**given, "present_in_gpes": None, "cen_pr_flag": 0},
    ))
    report = linkage.linkage_report(df, "2023-01-31", "2023-01-31", "first", min_age=18)
    assert len(report) == 6
    assert sorted(rows(report["overall"]), key=str) == [
        ("Linked", 3, 50.0), ("Not linked", 2, pytest.approx(100 / 3)), (None, 1, pytest.approx(100 / 6)),
    ]
    by_age = report["linked_by_age"]
    assert by_age.columns == [
        "age_group", "n_Linked", "n_Not linked", "n_NA", "proportion_Linked",
        "proportion_Not linked", "proportion_NA",
    ]
    assert rows(by_age) == [
        ("40-49", 2, 2, 1, 40.0, 40.0, 20.0), ("50-59", None, None, None, None, None, None),
    ][:1] + [("60-69", 1, None, None, 100.0, None, None)]
    assert dict(rows(report["mean_age"])) == {"Linked": pytest.approx(140 / 3), "Not linked": 40.0,
                                              None: 40.0}
    ages = {r["age_group"]: r["proportion_Linked"] for r in report["ages_of_linked"].collect()}
    assert ages == {"40-49": pytest.approx(200 / 3), "60-69": pytest.approx(100 / 3)}
    sexes = {r["sex"]: r["proportion_Linked"] for r in report["sexes_of_linked"].collect()}
    assert sexes == {"F": pytest.approx(200 / 3), "Unknown": pytest.approx(100 / 3)}
    by_sex = {r["sex"]: r["n_Linked"] for r in report["linked_by_sex"].collect()}
    assert by_sex == {"F": 2, "Unknown": 1}
