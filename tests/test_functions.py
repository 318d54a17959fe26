import math
from datetime import date

from pyspark.sql import functions as F

from cohortwise.functions import predicates as p
from cohortwise.functions import semantics as s
from cohortwise.functions.bands import (
    GROUP_BANDS,
    REPORT_BANDS,
    STANDARD_BANDS,
    assign_band,
    band_limits,
)
from cohortwise.functions.dates import (
    age_at,
    days_to_age,
    month_label,
    month_of,
    month_start,
    parse_compact_date,
    year_month,
)


def test_if_else_keeps_null(column):
    x = F.col("x")
    assert column([1, 2, None], "int", s.if_else(x == 1, F.lit("a"), F.lit("b"))) == ["a", "b", None]


def test_not_in_keeps_null(column):
    x = F.col("x")
    assert column(["a", "b", None], "string", s.not_in_keep_null(x, ["a"])) == [False, True, True]


def test_clamps_leave_null(column):
    x = F.col("x")
    assert column([-1.0, 5.0, None], "double", s.clamp_low(x)) == [0.0, 5.0, None]
    assert column([101.0, 5.0, None], "double", s.clamp_high(x)) == [100.0, 5.0, None]


def test_round_to_base_matches_integer_arithmetic(spark):
    df = spark.range(100_001).select("id", s.round_to_base(F.col("id")).alias("r"))
    assert df.filter(F.col("r") != F.expr("(id + 2) div 5 * 5")).count() == 0


def test_round_half_away_follows_stored_value(column):
    x = F.col("x")
    assert column([2.5, -2.5, 0.4, None], "double", s.round_half_away(x)) == [3.0, -3.0, 0.0, None]
    # 1.005 is stored below the tie, so the formula gives 1.0 (decimal rounding gives 1.01).
    assert column([1.005], "double", s.round_half_away(x, 2)) == [1.0]


def test_sum_or_zero(spark):
    x = F.col("x")
    df = spark.createDataFrame([(None,), (None,)], "x int")
    assert df.agg(s.sum_or_zero(x)).first()[0] == 0


def test_text_helpers(column):
    x = F.col("x")
    assert column(["20210305"], "string", s.text_slice(x, 5, 6)) == ["03"]
    assert column(["age-standardised", "c", None], "string", s.capitalise(x)) == [
        "Age-standardised", "C", None,
    ]


def test_lookup_label(column):
    x = F.col("x")
    titles = {"a": "A"}
    assert column(["a", "b", None], "string", s.lookup_label(x, titles)) == ["A", None, None]
    assert column(["a", "b", None], "string", s.lookup_label(x, titles, x)) == ["A", "b", None]


def test_compact_dates(column):
    x = F.col("x")
    texts = ["20201208", "", "unknown", "20210230", None]
    assert column(texts, "string", parse_compact_date(x)) == [
        date(2020, 12, 8), None, None, None, None,
    ]


def test_bands_by_brute_force(column):
    x = F.col("x")
    for scheme in (REPORT_BANDS, GROUP_BANDS, STANDARD_BANDS):
        ages = [c + d for c in scheme.cuts for d in (-0.01, 0.0, 0.01)] + [None]
        expected = [None if a is None else scheme.label_of(a) for a in ages]
        assert column(ages, "double", assign_band(x, scheme)) == expected


def test_band_labels():
    assert GROUP_BANDS.labels[:2] == ("<18", "18-29") and GROUP_BANDS.labels[-1] == "80+"
    assert STANDARD_BANDS.labels[1] == "18-24" and STANDARD_BANDS.labels[-1] == "90+"


def test_band_limits(column):
    x = F.col("x")
    labels = ["25-29", "90+", "<1", "<18", None]
    assert column(labels, "string", band_limits(x)[0]) == [25, 90, 0, 18, None]
    assert column(labels, "string", band_limits(x)[1]) == [30, 91, 1, 19, None]


def test_days_to_age_is_the_first_day_of_the_age(spark):
    """No day is put in the wrong band by the division in doubles."""
    cuts = range(1, 111)
    rows = [(c, days_to_age(c)) for c in cuts]
    df = spark.createDataFrame(rows, "c int, d int")
    born = F.lit("1900-01-01").cast("date")
    at, before = F.date_add(born, F.col("d")), F.date_add(born, F.col("d") - 1)
    wrong = df.filter((age_at(at, born) < F.col("c")) | (age_at(before, born) >= F.col("c")))
    assert wrong.count() == 0
    assert days_to_age(18) == math.ceil(18 * 365.25)


def test_month_arithmetic(column):
    x = F.col("x")
    days = [date(2020, 12, 31), date(2021, 1, 1)]
    assert column(days, "date", month_of(x)) == [24251, 24252]
    assert column([24251, 24252], "int", month_start(x)) == [date(2020, 12, 1), date(2021, 1, 1)]
    assert column([24251], "int", year_month(x)[0]) == [2020]
    assert column([24251], "int", year_month(x)[1]) == [12]
    assert column([1, 12], "int", month_label(F.lit(2021), x)) == ["Jan 2021", "Dec 2021"]


def test_alive_on_a_day(column):
    x = F.col("x")
    day = p.day("2022-01-31")
    days = [date(2022, 1, 30), date(2022, 1, 31), date(2022, 2, 1), None]
    assert column(days, "date", p.alive_on(x, day)) == [False, True, True, True]


def test_age_window(column):
    x = F.col("x")
    ages = [17.9, 18.0, 49.9, 50.0, None]
    assert p.age_window(x) is None
    assert column(ages, "double", p.age_window(x, 18, 50)) == [False, True, True, False, None]
    assert column(ages, "double", p.age_window(x, low=18)) == [False, True, True, True, None]
    assert column(ages, "double", p.age_window(x, high=18)) == [True, False, False, False, None]


def test_given_by(column):
    x = F.col("x")
    days = [date(2022, 1, 31), date(2022, 2, 1), None]
    assert column(days, "date", p.given_by(x, "2022-01-31")) == [1, 0, 0]
    assert column(days, "date", p.given_by(x, None)) == [1, 1, 0]
