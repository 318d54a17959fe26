import random
from calendar import monthrange
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortwise import CountSpec, RunConfig
from cohortwise.functions.bands import GROUP_BANDS, STANDARD_BANDS
from cohortwise.operators import counts

SCHEMA = (
    "dob date, dod date, first_vacc_date date, second_vacc_date date, third_vacc_date date, "
    "sex string, education string, region string, imd int"
)
BANDS = {"age_group": GROUP_BANDS, "age_group_esp": STANDARD_BANDS}


def random_people(n, seed):
    rng = random.Random(seed)

    def day(lo, hi, null=0.0):
        if rng.random() < null:
            return None
        return lo + timedelta(days=rng.randrange((hi - lo).days))

    people = []
    for _ in range(n):
        start, end = date(2020, 12, 1), date(2022, 6, 30)
        # A third of all people share one region and value: a hot cell.
        hot = rng.random() < 1 / 3
        people.append(
            (
                day(date(1925, 1, 1), date(2006, 1, 1), 0.05),
                day(start, end, 0.8),
                day(start, end, 0.3),
                day(start, end, 0.5),
                day(start, end, 0.6),
                "Male" if hot else rng.choice(["Male", "Female", None]),
                "L1" if hot else rng.choice(["L1", "L2", None]),
                "North" if hot else rng.choice(["North", "South", None]),
                rng.choice([1, 2, None]),
            )
        )
    # Edges: died on the last and first day of a month, birthday at a month end, dose at one.
    me = date(2021, 3, 31)
    people += [
        (date(1980, 1, 1), me, None, None, None, "Male", "L1", "North", 1),
        (date(1980, 1, 1), date(2021, 4, 1), None, None, None, "Male", "L1", "North", 1),
        (date(1980, 1, 1), date(2020, 11, 30), None, None, None, "Male", "L1", "North", 1),
        (date(1980, 1, 1), date(2020, 12, 31), None, None, None, "Male", "L1", "North", 1),
        (me - timedelta(days=6575), None, me, me, me, "Female", "L2", "South", 2),
        (me - timedelta(days=6574), None, None, None, None, "Female", "L2", "South", 2),
        (date(1991, 3, 31), None, date(2021, 4, 1), None, None, "Female", "L2", "South", 2),
        (date(2021, 1, 1), None, None, None, None, "Female", "L2", "South", 2),
    ]
    return people


def brute_force(people, run, exposures, group_vars):
    """One person and one month at a time."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    population, vaccinated = Counter(), Counter()
    y, m = run.first_period
    while (y, m) <= (run.run_year, run.run_month):
        end = date(y, m, monthrange(y, m)[1])
        for row in people:
            person = dict(zip(names, row))
            if person["dob"] is None or (person["dod"] and person["dod"] <= end):
                continue
            age = (end - person["dob"]).days / 365.25
            for exposure in exposures:
                if age < (max(30, run.min_age) if exposure == "education" else run.min_age):
                    continue
                place = tuple(
                    BANDS[g].label_of(age) if g in BANDS else person[g] for g in group_vars
                )
                value = person[exposure]
                group = None if value is None else str(value)
                for dose in ("first", "second", "third"):
                    given = person[f"{dose}_vacc_date"]
                    key = (dose, y, m, exposure, *place, group)
                    population[key] += 1
                    vaccinated[key] += given is not None and given <= end
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return {(*k, population[k], vaccinated[k]) for k in population}


@pytest.fixture(scope="module")
def people():
    return random_people(400, 11)


@pytest.mark.parametrize(
    "min_age, exposures, group_vars",
    [
        (18, ["sex", "education", "imd"], ["age_group", "age_group_esp", "region"]),
        (50, ["sex", "education"], ["age_group_esp", "region"]),
        (18, ["education"], ["age_group"]),
        (18, ["education", "imd"], []),
        (0, ["sex", "education"], ["age_group", "region", "sex"]),
        (23, ["education"], ["region"]),
    ],
)
def test_equal_to_one_person_one_month_at_a_time(spark, people, min_age, exposures, group_vars):
    run = RunConfig(2022, 3, min_age=min_age)
    df = spark.createDataFrame(people, SCHEMA)
    got = counts.monthly_counts(df, run, exposures, group_vars)
    assert got.columns == [
        "vaccine_number", "year", "month", "exposure", *group_vars, "group", "population",
        "vaccinated",
    ]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_force(people, run, exposures, group_vars)


def test_long_calendar_crosses_many_bands(spark, people):
    run = RunConfig(2034, 12)
    df = spark.createDataFrame(people[:60], SCHEMA)
    got = {tuple(r) for r in counts.monthly_counts(df, run, ["sex"], ["age_group_esp"]).collect()}
    assert got == brute_force(people[:60], run, ["sex"], ["age_group_esp"])


def test_all_calls_equal_single_calls(spark, people):
    run = RunConfig(2022, 3)
    df = spark.createDataFrame(people, SCHEMA)
    specs = [
        CountSpec("region", ("sex", "education"), "region"),
        CountSpec("la", ("imd",), "region", (2021, 4)),
        CountSpec("sex", ("education",), "sex"),
    ]
    every = counts.monthly_counts_all(df, run, specs)
    for spec in specs:
        single = counts.monthly_counts(
            df, run, spec.exposures, ["age_group", "age_group_esp", spec.area]
        )
        single = counts.period_exclusions(counts.from_period(single, spec.first_period))
        mine = every.filter(F.col("call") == spec.name).drop("call")
        assert {tuple(r) for r in mine.collect()} == {tuple(r) for r in single.collect()}


def test_exposures_share_one_population(spark, people):
    """Groups of any exposure (null included) add up to the same population."""
    df = spark.createDataFrame(people, SCHEMA)
    out = counts.monthly_counts(df, RunConfig(2022, 3), ["sex", "imd"], ["age_group", "region"])
    keys = ["vaccine_number", "year", "month", "age_group", "region"]
    totals = out.groupBy(*keys, "exposure").agg(F.sum("population").alias("n"))
    spread = totals.groupBy(*keys).agg(F.countDistinct("n").alias("k"), F.count("*").alias("e"))
    assert spread.filter("k <> 1 or e <> 2").count() == 0


def test_period_exclusions(spark):
    rows = [(d, y, m) for d in ("first", "second", "third")
            for y, m in [(2020, 12), (2021, 1), (2021, 10), (2021, 11), (2022, 1)]]
    df = spark.createDataFrame(rows, "vaccine_number string, year int, month int")
    out = sorted(tuple(r) for r in counts.period_exclusions(df).collect())
    assert out == sorted(
        [("first", y, m) for _, y, m in rows[:5]]
        + [("second", y, m) for _, y, m in rows[1:5]]
        + [("third", y, m) for _, y, m in rows[3:5]]
    )


def test_plan_shuffles_only_aggregated_cells(spark, people):
    df = spark.createDataFrame(people, SCHEMA)
    run = RunConfig(2022, 3)
    out = counts.monthly_counts(df, run, ["sex", "education", "imd"], ["age_group_esp", "region"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 2, plan
    below = plan[plan.rindex("Exchange"):]
    assert "partial_sum" in below and "Expand" in below
    assert "Python" not in plan and "Join" not in plan


VALUES = {"sex": ["Male", "Female"], "education": ["L1", "L2"], "region": ["North", "South"], "imd": ["1", "2"]}


@pytest.mark.parametrize("specs, bands, first, last, min_age", [
    ([("a", ("sex", "education", "imd"), ("region",)), ("b", ("education",), ("sex",))], BANDS, (2020, 12), (2022, 3), 18),
    ([("a", ("education", "imd"), ()), ("b", ("sex",), ("education", "imd"))], {}, (2020, 12), (2022, 3), 23),
    ([("a", ("education", "sex"), ("region", "sex"))], BANDS, (2021, 6), (2021, 6), 0),
])
def test_cells_by_number_are_cells_by_text(spark, people, specs, bands, first, last, min_age):
    """Nulls, exposures of a later age, areas of unequal number and a run of one month included."""
    run = RunConfig(*last, min_age=min_age, first_period=first)
    df = spark.createDataFrame(people * 2, SCHEMA)
    by_text = counts.count_cells(df, run, specs, bands)
    by_number = counts.count_cells(df, run, specs, bands, values=VALUES)
    assert by_number.dtypes == by_text.dtypes
    rows = sorted(map(str, by_text.collect()))
    assert rows and sorted(map(str, by_number.collect())) == rows


def test_many_values_fill_several_words(spark, people):
    values = {c: [*v, *[f"{c}{i}" for i in range(2**17)]] for c, v in VALUES.items()}
    run, specs = RunConfig(2021, 3), [("a", ("sex", "education", "imd"), ("region",))]
    columns = ["sex", "education", "imd", "region"]
    codes = counts._Codes(values, columns, [("a", e, ("region",)) for e in columns[:3]], 1, 15, run)
    assert codes.words == ["word_0", "word_1"] and codes.fits
    assert not counts._Codes(values, columns, [("a", e, ("region",) * 3) for e in columns], 3, 15, run).fits
    few = {c: [*v, *[f"{c}{i}" for i in range(300)]] for c, v in VALUES.items()}
    df = spark.createDataFrame(people, SCHEMA)
    got, want = (counts.count_cells(df, run, specs, BANDS, values=v) for v in (few, None))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_text_that_was_not_listed_is_an_error(spark, people):
    df = spark.createDataFrame(people, SCHEMA)
    run, specs = RunConfig(2021, 3), [("a", ("sex",), ("region",))]
    with pytest.raises(Exception, match="not among the values given for region: South"):
        counts.count_cells(df, run, specs, BANDS, values=VALUES | {"region": ["North"]}).collect()
