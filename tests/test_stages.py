"""Stages with a manifest, observed guards, refused lines, bounded files, months from a state."""

import math
import os

import pytest
from pyspark.sql import functions as F

from cohortwise import RunConfig
from cohortwise.operators import areas, counts, guards
from cohortwise.operators.poisson import poisson_limits
from cohortwise.schemas import IMD
from cohortwise.sources import readers, staging, writers
from cohortwise import fixed_values as fv
from driver_queries import mapping
from driver_queries import spark_queries as q
from tests.conftest import SF
from tests.plans import plan_of


def test_a_stage_is_reused_until_what_it_is_made_of_changes(spark, tmp_path):
    path, source = str(tmp_path / "stage"), str(tmp_path / "in.parquet")
    spark.range(3).write.parquet(source)
    runs = []

    def stage(spec, rows=3):
        def compute():
            runs.append(spec)
            return spark.range(rows)
        return staging.fingerprinted(spark, path, compute, spec, [source]).count()

    assert stage({"a": 1}) == 3
    assert stage({"a": 1}, rows=9) == 3            # the same: what is written counts
    assert stage({"a": 2}, rows=4) == 4            # another parameter
    assert stage({"a": 2}, rows=5) == 4
    spark.range(7).write.mode("append").parquet(source)
    assert stage({"a": 2}, rows=5) == 5            # another state of the input
    changed = staging.fingerprinted(
        spark, path, lambda: spark.range(2).withColumn("more", F.lit(1)), {"a": 2}, [source])
    assert changed.columns == ["id", "more"] and changed.count() == 2  # another schema


def test_a_half_written_stage_is_never_read(spark, tmp_path):
    path = str(tmp_path / "stage")
    first = staging.fingerprinted(spark, path, lambda: spark.range(3), {})
    data = staging.read_manifest(spark, path)["data"]
    os.remove(f"{path}/{data}/_SUCCESS")
    assert staging.fingerprinted(spark, path, lambda: spark.range(5), {}).count() == 5
    assert first.count() == 3  # who reads the former table goes on with it
    with open(f"{path}/_manifest.json", "w") as f:
        f.write("{half")
    crc = f"{path}/._manifest.json.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert staging.fingerprinted(spark, path, lambda: spark.range(6), {}).count() == 6


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        staging.shared_folder(Session())


def test_guard_counts_in_the_pass(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    lookup = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, w double")
    guard = guards.Guard()
    joined = guards.watched_lookup_join(guard, rows, lookup, "k", "w", "w", needed=F.col("v") < 4)
    assert joined.count() == 6
    found = guard.metrics()
    assert found == {"w_in.rows": 4, "w_out.rows": 6, "w_out.missing": 1}
    assert guards.fan_out(found, "w") == 2
    with pytest.raises(ValueError, match="w_out.missing = 1"):
        guard.require_none(["missing"])
    guard.require_none(["other"])


def test_refused_lines(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    with open(path, "w") as f:
        f.write('IMD_QUINTILE,extra,LSOA11CD,IMD_RANK\n2,"x,y",E01,17\n1,,E02,bad\n,,,\n3,x\n4,x,E03,5,6\nq,x,E04,r\n')
    good, refused = readers.read_csv_checked(spark, path, IMD)
    assert good.columns == IMD.fieldNames()
    assert sorted(map(tuple, good.collect()), key=repr) == [("E01", 17, 2), (None, None, None)]
    assert sorted(map(tuple, refused.collect())) == [
        ("1,,E02,bad", "bad IMD_RANK"), ("3,x", "wrong number of fields"),
        ("4,x,E03,5,6", "wrong number of fields"), ("q,x,E04,r", "bad IMD_RANK, bad IMD_QUINTILE")]
    with pytest.raises(ValueError, match="IMD_RANK"):
        with open(path, "w") as f:
            f.write("LSOA11CD,IMD_QUINTILE\n")
        readers.read_csv_checked(spark, path, IMD)


def test_bounded_files_of_a_hot_period(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 10)).alias("TimePeriodLabel"),
        F.lpad(F.pmod(F.col("id") * 7919, F.lit(1000)).cast("string"), 4, "0").alias("place"))
    writers.write_bounded_periods(rows, path, ["place"], 90)
    found = []
    folder = f"{path}/period=hot"
    files = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    for name in files:
        with open(f"{folder}/{name}") as f:
            lines = f.read().splitlines()[1:]
        assert 0 < len(lines) <= 90
        found += lines
    assert len(files) >= 9 and found == sorted(found) and len(found) == 800
    assert writers.read_periods(spark, path).count() == 1000


@pytest.mark.parametrize("year, month", [(2021, 1), (2021, 12), (2023, 1)])
def test_month_from_state_and_changes(spark, year, month):
    """A month's counts from the state before are those of the whole run, and the states go on."""
    specs = [("all", ("education", "sex"), ("region",))]
    people = q.study_without_areas(spark, SF)
    run = RunConfig(year, month)
    before = RunConfig(year - (month == 1), (month - 2) % 12 + 1)
    state = counts.month_state(people, before, specs, counts.BANDS)
    now = counts.next_state(state, people, run, specs, counts.BANDS)
    got = counts.state_counts(now, run, specs, counts.BANDS)
    whole = counts.count_cells(people, run, specs, counts.BANDS).where(
        (F.col("year") == year) & (F.col("month") == month))
    assert got.columns == whole.columns
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0 and got.count() > 0
    straight = counts.month_state(people, run, specs, counts.BANDS)
    assert now.where("population <> 0").exceptAll(straight).count() == 0


def test_only_the_month_reaches_the_aggregation(spark):
    specs = [("all", ("sex",), ("region",))]
    people = q.study_without_areas(spark, SF)
    plan = counts._Plan(RunConfig(2023, 1), specs, counts.BANDS, {})
    one = plan.changes(people, F.col("month") == 2023 * 12)
    assert {r[0] for r in one.select("month").distinct().collect()} == {2023 * 12}


def root(k, target):
    """The mean at which the distribution function of k is ``target``, by bisection."""
    low, high = 1e-9, 2.0 * k + 50
    for _ in range(200):
        mean = (low + high) / 2
        if math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1)) > target:
            low = mean
        else:
            high = mean
    return low


def test_poisson_limits(spark):
    """The shipped table to six places, closed forms, and far counts."""
    df = spark.createDataFrame([(k,) for k in [*range(-1, 100), 1000, None]], "Deaths long")
    got = {r["Deaths"]: (r["L"], r["U"]) for r in poisson_limits(df).collect()}
    for k, low, high in fv.POISSON_LIMITS:
        assert got[k] == (pytest.approx(low, abs=6e-7), pytest.approx(high, abs=6e-7))
    assert got[0] == got[-1] == got[None] == (None, None)
    assert got[1][0] == pytest.approx(0.025317807984289897, rel=1e-12)  # -ln 0.975
    assert got[1][1] == pytest.approx(5.571643390938899, rel=1e-9)
    for k in (7, 64, 1000):
        assert got[k] == (pytest.approx(root(k - 1, 0.975) / k, rel=1e-9),
                          pytest.approx(root(k, 0.025) / k, rel=1e-9))
    table = readers.exact_poisson_limits(spark)
    assert table.count() == 99 and table.where("L IS NULL OR U IS NULL").count() == 0


def test_salted_join_equals_the_plain_one(spark):
    """An area with a third of all persons, persons without area, a lookup too large to broadcast."""
    people = spark.range(600).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('a', id % 50) END AS lsoa_derived",
        "date_add(DATE '1950-01-01', CAST(id % 90 AS INT)) AS dob")
    lookup = spark.createDataFrame(
        [("hot", "H"), ("hot", "H2"), *[(f"a{i}", f"A{i}") for i in range(40)]], "lsoa_derived string, la_code string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = areas.attach_areas(people, lookup)
        salted = areas.attach_areas(people, lookup, salts=5)
        assert salted.columns == plain.columns
        assert salted.exceptAll(plain).count() == 0 and plain.count() == salted.count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_scan_with_a_part_for_each_core_is_stored_without_a_shuffle(spark, tmp_path):
    """Only a table too small for that is dealt out, so that what is shuffled doesn't grow with the input."""
    sf_dir = str(tmp_path)
    lines = mapping.read(spark, SF, "lineitem")
    lines.repartition(6).write.parquet(f"{sf_dir}/lineitem.parquet")
    small = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "512m")  # a part for each file
    try:
        spread = mapping.spread_persons(spark, sf_dir, 4)
        assert "Exchange" not in plan_of(spread) and spread.rdd.getNumPartitions() == 6
        stored = mapping.raw_persons(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", small)
    dealt = mapping.spread_persons(spark, sf_dir, 9)
    assert dealt.rdd.getNumPartitions() == 9
    whole = mapping.computed_persons(spark, SF)
    for table in (spread, stored, dealt):
        assert table.count() == whole.count() and table.exceptAll(whole).isEmpty()
