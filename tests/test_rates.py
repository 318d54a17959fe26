import math
import random

import pytest
from pyspark.sql import functions as F

from cohortwise import RunConfig
from cohortwise import fixed_values as fv
from cohortwise.operators import rates
from cohortwise.operators.tables import (
    RATE_TABLES,
    embed_sex,
    rate_tables,
    standard_tables,
    union_tables,
)
from cohortwise.sources.readers import default_poisson_limits, default_standard_population

LIMITS = {d: (lo, hi) for d, lo, hi in fv.POISSON_LIMITS}


@pytest.fixture(scope="module")
def weights(spark):
    return rates.adapt_standard_population(default_standard_population(spark))


@pytest.fixture(scope="module")
def poisson(spark):
    return default_poisson_limits(spark)


def bands(spark, rows):
    return spark.createDataFrame(
        rows, "g string, age_group_esp string, population long, vaccinated long"
    )


def test_standard_population(weights):
    got = {r[0]: r[1] for r in weights.collect()}
    assert len(got) == 15 and got["18-24"] == 8200.0 and got["90+"] == 1000.0
    assert "15-19" not in got and "20-24" not in got and "10-14" not in got


def test_worked_example(spark, weights, poisson):
    df = bands(spark, [("a", "18-24", 203, 52), ("a", "25-29", 98, 0)])
    row = rates.age_standardised_rates(df, weights, poisson, 18, 1000, ["g"]).first()
    assert (row["population"], row["vaccinated"]) == (305, 50)
    expected = {
        "crude_rate": 16.393443, "crude_lower_ci": 12.238535, "crude_upper_ci": 20.548351,
        "age_standardised_rate": 14.084507, "age_standardised_lower_ci": 10.453788,
        "age_standardised_upper_ci": 18.568662,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-6)


def by_hand(rows, weight):
    """Rates of one group from (band, population, vaccinated) rows."""
    def five(n):
        return 5 * math.floor(n / 5 + 0.5)

    p = v = std = var = w = 0
    for band, population, vaccinated in rows:
        bp, bv = five(population), five(vaccinated)
        p, v, w = p + bp, v + bv, w + weight[band]
        if bp:
            rate = bv / bp * 100000
            std += rate * weight[band]
            if bv:
                var += rate**2 / bv * weight[band] ** 2
    out = [p, v]
    if p:
        r = v / p
        m = 1.96 * math.sqrt(r * (1 - r) / p)
        out += [r * 100, max(0, (r - m) * 100), min(100, (r + m) * 100)]
    else:
        out += [None] * 3
    asr, avar = std / w, var / w**2
    if v >= 100 or v == 0:
        lo, hi = asr - 1.96 * math.sqrt(avar), asr + 1.96 * math.sqrt(avar)
    elif v in LIMITS:
        k = math.sqrt(avar / v)
        lo, hi = asr + (LIMITS[v][0] * v - v) * k, asr + (LIMITS[v][1] * v - v) * k
    else:
        lo = hi = None
    out += [asr / 1000, None if lo is None else max(0, lo / 1000),
            None if hi is None else min(100, hi / 1000)]
    return out


def test_against_hand_computation(spark, weights, poisson):
    weight = {r[0]: r[1] for r in weights.collect()}
    rng = random.Random(5)
    groups = {}
    for i in range(60):
        scale = rng.choice([2, 12, 60, 900])
        chosen = rng.sample(list(weight), rng.randint(1, 15))
        groups[f"g{i}"] = [(b, n, rng.randint(0, n)) for b in chosen for n in [rng.randint(0, scale)]]
    groups["none"] = [("18-24", 2, 1)]
    groups["all"] = [("18-24", 100, 100), ("25-29", 5, 5)]
    df = bands(spark, [(g, *r) for g, rows in groups.items() for r in rows])
    got = rates.age_standardised_rates(df, weights, poisson, 18, 1000, ["g"]).collect()
    assert len(got) == len(groups)
    for row in got:
        expected = by_hand(groups[row["g"]], weight)
        for value, want in zip(row[1:], expected):
            assert value == (None if want is None else pytest.approx(want, abs=1e-9)), row
        for kind in ("crude", "age_standardised"):
            low, mid, high = (row[f"{kind}_{s}"] for s in ("lower_ci", "rate", "upper_ci"))
            if None not in (low, mid, high):
                assert 0 <= low <= mid + 1e-9 and mid <= high + 1e-9 and high <= 100


def test_age_range_filters_bands(spark, weights, poisson):
    df = bands(spark, [("a", "45-49", 100, 50), ("a", "50-54", 100, 20), ("a", "90+", 10, 5)])
    row = rates.age_standardised_rates(df, weights, poisson, 50, 1000, ["g"]).first()
    assert (row["population"], row["vaccinated"]) == (110, 25)
    row = rates.age_standardised_rates(df, weights, poisson, 50, 90, ["g"]).first()
    assert (row["population"], row["vaccinated"]) == (100, 20)


def test_missing_weight_raises_unless_filtered_out(spark, weights, poisson):
    df = bands(spark, [("a", "18-24", 100, 50), ("a", "10-14", 100, 50)])
    assert rates.age_standardised_rates(df, weights, poisson, 18, 1000, ["g"]).count() == 1
    with pytest.raises(Exception, match="Missing population weights"):
        rates.age_standardised_rates(df, weights, poisson, 0, 1000, ["g"]).collect()


def test_missing_poisson_limit_gives_no_interval(spark, weights, poisson):
    df = bands(spark, [("a", "18-24", 100, 50)])
    few = poisson.filter("Deaths < 50")
    row = rates.age_standardised_rates(df, weights, few, 18, 1000, ["g"]).first()
    assert row["age_standardised_rate"] == pytest.approx(50) and row["age_standardised_lower_ci"] is None


def test_crude_rates_leave_standardised_null(spark):
    df = bands(spark, [("a", "x", 98, 12), ("b", "x", 2, 1), (None, "x", 10, 10)])
    got = {r["g"]: r for r in rates.crude_rates(df, ["g"]).collect()}
    assert got["a"]["population"] == 100 and got["a"]["crude_rate"] == pytest.approx(10)
    assert got["b"]["crude_rate"] is None and got[None]["crude_upper_ci"] == 100
    assert all(r["age_standardised_rate"] is None for r in got.values())


def test_complement(spark):
    df = spark.createDataFrame(
        [("first", 10, 3), ("second", 10, 3)], "vaccine_number string, population int, vaccinated int"
    )
    got = {r[0]: r[2] for r in rates.complement_first_dose(df).collect()}
    assert got == {"first": 7, "second": 3}


def test_tables_of_a_run():
    assert len(standard_tables(RunConfig(2023, 1))) == 11
    assert len(standard_tables(RunConfig(2023, 1, min_age=50))) == 8
    with pytest.raises(ValueError, match="Non-standard"):
        standard_tables(RunConfig(2023, 1, min_age=30))


def test_rate_tables_equal_the_operators_one_by_one(spark, weights, poisson):
    run = RunConfig(2023, 1)
    rng = random.Random(8)
    rows = []
    for call, exposures, areas in (
        ("region", ("sex", "imd_quintile", "imd_quintile_region"), ("North", "South", None)),
        ("la", ("sex", "tenure"), ("Derby", "Hackney")),
        ("sex", ("tenure",), ("Male", "Female")),
    ):
        for exposure in exposures:
            for group in ("Male", "Female", None):
                for area in areas:
                    for band, esp in (("18-29", "18-24"), ("18-29", "25-29"), ("80+", "90+")):
                        for dose in ("first", "second"):
                            n = rng.randint(1, 200)
                            rows.append((call, dose, 2022, 1, exposure, band, esp, area, group, n,
                                         rng.randint(0, n)))
    df = spark.createDataFrame(
        rows, "call string, vaccine_number string, year int, month int, exposure string, "
        "age_group string, age_group_esp string, area string, group string, population long, "
        "vaccinated long",
    )
    got = rate_tables(df, weights, poisson, run, keep_name=True)
    when = ["vaccine_number", "year", "month"]
    for table in RATE_TABLES:
        source = df.filter(F.col("call") == table.call)
        if table.only:
            source = source.filter(F.col("exposure") == table.only)
        if table.without:
            source = source.filter(F.col("exposure") != table.without)
        labels = [table.exposure, table.group, table.sub_category]
        keys = when + [c[1:] for c in labels if c.startswith("$")]
        keys += ["area"] if table.name == "sex" else []
        band = ["age_group_esp"] if table.standardise else []
        summed = rates.complement_first_dose(
            source.groupBy(*keys, *band).agg(
                F.sum("population").alias("population"), F.sum("vaccinated").alias("vaccinated")
            )
        )
        if table.standardise:
            single = rates.age_standardised_rates(summed, weights, poisson, 18, 1000, keys)
        else:
            single = rates.crude_rates(summed, keys)
        def figures(d):
            return sorted(
                tuple("" if v is None else round(v, 9) for v in r)
                for r in d.select("population", "vaccinated", *rates.RATE_COLUMNS).collect()
            )
        mine = got.filter(F.col("table") == table.name)
        assert [list(map(str, r)) for r in figures(mine)] == [
            list(map(str, r)) for r in figures(single)
        ], table.name
    keys = ["vaccine_number", "year", "month", "exposure", "group", "SubCategory", "Sex"]
    twice = got.filter(F.col("SubCategory").isNotNull()).groupBy(*keys).count().filter("count > 1")
    assert twice.count() == 0


def test_embed_sex(spark):
    df = spark.createDataFrame(
        [("sex", "Male"), ("sex", None), ("tenure", "Owned"), (None, "x"), ("Total", "Total")],
        "exposure string, group string",
    )
    got = [tuple(r) for r in embed_sex(df).select("exposure", "group", "Sex").collect()]
    assert got == [
        ("Total", "Total", "Male"), ("Total", "Total", None), ("tenure", "Owned", "Persons"),
        (None, None, "Persons"), ("Total", "Total", "Persons"),
    ]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert sorted(map(tuple, union_tables(a, b, b).collect()), key=str) == [
        (1, 2), (3, None), (3, None),
    ]
