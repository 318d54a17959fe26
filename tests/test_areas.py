import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import areas
from cohortwise.sources.lookups import assert_unique_lookup


def units(spark, rows):
    return spark.createDataFrame(rows, "lsoa_derived string, imd_rank int, la_code string")


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_exact_percentiles_equal_numpy_and_builtin(spark, buckets):
    rng = np.random.default_rng(3)
    # One group holds a third of the rows, one is tiny, one has ties only.
    groups = {"hot": rng.integers(1, 400, 400), "a": rng.integers(1, 400, 395),
              "b": rng.integers(-50, 50, 400), "one": np.array([7]), "ties": np.full(11, 5)}
    rows = [(f"{g}{i}", int(v), g) for g, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("n1", None, "a"), ("n2", None, "empty"), ("n3", 4, None), ("n4", 9, None)]
    df = units(spark, rows)
    points = {"p20": 0.2, "p40": 0.4, "p60": 0.6, "p80": 0.8, "p0": 0.0, "p100": 1.0}
    got = {
        r["la_code"]: r.asDict()
        for r in areas.exact_percentiles(df, "la_code", "imd_rank", points, buckets).collect()
    }
    built_in = df.groupBy("la_code").agg(
        *[F.percentile("imd_rank", p).alias(n) for n, p in points.items()]
    )
    assert got == {r["la_code"]: r.asDict() for r in built_in.collect()}
    for group, values in groups.items():
        for name, p in points.items():
            assert got[group][name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    assert got["empty"]["p20"] is None and got[None]["p0"] == 4.0


def test_wide_and_dense_ranks(spark):
    rng = np.random.default_rng(4)
    groups = {"wide": rng.integers(-10**12, 10**12, 500), "dense": rng.integers(0, 3, 500) / 1e9,
              "outlier": np.append(rng.integers(0, 100, 300), 10**15)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "area string, v double")
    got = areas.exact_percentiles(df, "area", "v", {"p20": 0.2, "p80": 0.8}).collect()
    for r in got:
        assert r["p20"] == pytest.approx(np.quantile(groups[r["area"]], 0.2), rel=1e-12)
        assert r["p80"] == pytest.approx(np.quantile(groups[r["area"]], 0.8), rel=1e-12)
    assert len(got) == 3


def test_quintile_borders_and_nulls(spark):
    rows = [(f"l{i}", i, "a") for i in range(1, 12)] + [("x", None, "a"), ("y", 3, None)]
    out = areas.area_quintile(units(spark, rows), "la_code", "q")
    q = {r["lsoa_derived"]: r["q"] for r in out.collect()}
    # Ranks 1..11 have borders 3, 5, 7, 9; a rank on a border is in the lower quintile.
    assert [q[f"l{i}"] for i in range(1, 12)] == list("11122334455")
    assert q["x"] is None and q["y"] is None


def lookups(spark):
    imd = spark.createDataFrame(
        [("L1", 1, 1), ("L2", 2, 2), ("L3", 3, 3)],
        "LSOA11CD string, IMD_RANK int, IMD_QUINTILE int",
    )
    postcodes = spark.createDataFrame(
        [("L1", "A", "R"), ("L1", "A", "R"), ("L1", "B", "R"), ("L2", "A", "R"), ("L4", "A", "R")],
        "lsoa11 string, laua string, rgn string",
    )
    names = spark.createDataFrame(
        [("A", "UA", "Isles of Scilly"), ("A", "UA", "Isles of Scilly"), ("B", "UB", "Bee")],
        "ltla22cd string, utla22cd string, utla22nm string",
    )
    return imd, postcodes, names


def test_area_lookup_fans_out_and_left_joins(spark):
    table = areas.area_lookup(*lookups(spark))
    found = sorted((r["lsoa_derived"], r["la_code"], r["imd_quintile"]) for r in table.collect()
                   if r["la_code"])
    assert found == [("L1", "A", "1"), ("L1", "B", "1"), ("L2", "A", "2")]
    people = spark.createDataFrame([(1, "L1"), (2, "L3"), (3, "L9"), (4, None)],
                                   "id int, lsoa_derived string")
    joined = areas.merge_small_areas(areas.attach_areas(people, table))
    rows = sorted((r["id"], r["la_derived"] or "") for r in joined.collect())
    assert rows == [(1, "Bee"), (1, "Cornwall"), (2, ""), (3, ""), (4, "")]


def test_persons_without_area_are_dealt_out(spark):
    people = spark.range(400).select("id", F.lit(None).cast("string").alias("lsoa_derived"))
    table = areas.area_lookup(*lookups(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = areas.attach_areas(people, table)
        assert joined.count() == 400 and joined.where("la_code is not null").count() == 0
        assert joined.columns == ["id", "lsoa_derived", *[c for c in table.columns if c != "lsoa_derived"]]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_with_two_rows_for_an_area_is_refused(spark):
    imd, postcodes, names = lookups(spark)
    with pytest.raises(Exception, match="several rows"):
        areas.area_lookup(imd.unionByName(imd), postcodes, names).collect()


def test_assert_unique_lookup(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(assert_unique_lookup(good, "k").collect()) == sorted(good.collect())
    bad = good.union(spark.createDataFrame([("a", 3)], "k string, v int"))
    with pytest.raises(Exception, match="several rows"):
        assert_unique_lookup(bad, "k").collect()
