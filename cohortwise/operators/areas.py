"""Area lookups: names, deprivation quintiles within an area, small-area merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.sources.lookups import assert_unique_lookup

MOST_BUCKETS = 4096
SPREAD = 1024
QUINTILE_POINTS = (0.2, 0.4, 0.6, 0.8)


def exact_percentiles(
    df: DataFrame,
    group: str,
    value: str,
    points: Mapping[str, float],
    most_buckets: int = MOST_BUCKETS,
) -> DataFrame:
    """Exact percentiles (linear interpolation) per group, without gathering a group.

    Values are counted per (group, value); the range of a group is cut into
    equal buckets, as many as it has rows and ``most_buckets`` at most.  The
    counts per bucket say in which bucket each wanted position lies, and only
    those buckets are then ordered.  The largest piece of work for one task is
    one bucket of one group, however large, wide or dense the group is.

    A group whose values are all null is returned with null percentiles, and
    null is a group of its own.
    """
    counted = (
        df.select(F.col(group), F.col(value).cast("double").alias("v"))
        .groupBy(group, "v")
        .agg(F.count("*").alias("n"))
    )
    spans = counted.groupBy(F.col(group).alias("_group")).agg(
        F.min("v").alias("_least"),
        F.max("v").alias("_most"),
        F.least(F.sum("n"), F.lit(most_buckets)).alias("_buckets"),
    )
    width = (F.col("_most") - F.col("_least")) / F.col("_buckets")
    bucket = F.when(
        F.col("v").isNotNull(),
        F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_least"), width)), F.lit(0)),
    )
    freq = (
        counted.join(spans, F.col(group).eqNullSafe(F.col("_group")))
        .select(group, bucket.alias("bucket"), "v", "n")
    )
    in_group = Window.partitionBy(group)
    buckets = (
        freq.groupBy(group, "bucket")
        .agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
        .withColumn("total", F.sum("n").over(in_group))
        .withColumn(
            "before", F.sum("n").over(in_group.orderBy(F.col("bucket").asc_nulls_first())) - F.col("n")
        )
    )
    # Positions wanted: floor and ceiling of (total - 1) * p, counted from zero.
    wanted = buckets.filter(F.col("total") > 0)
    position = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in points.items()}
    low = {name: F.floor(pos) for name, pos in position.items()}
    high = {name: F.ceil(pos) for name, pos in position.items()}
    in_bucket = F.lit(False)
    for name in points:
        for index in (low[name], high[name]):
            in_bucket = in_bucket | (
                (index >= F.col("before")) & (index < F.col("before") + F.col("n"))
            )
    wanted = wanted.filter(in_bucket & (F.col("n") > 0)).select(
        F.col(group).alias("_g"), F.col("bucket").alias("_b"), "before", "total"
    )
    in_order = Window.partitionBy(group, "bucket").orderBy("v")
    ranked = (
        freq.filter(F.col("v").isNotNull())
        .join(wanted, F.col(group).eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b")))
        .withColumn("upto", F.col("before") + F.sum("n").over(in_order))
    )

    def at(index):
        hit = (index >= F.col("upto") - F.col("n")) & (index < F.col("upto"))
        return F.max(F.when(hit, F.col("v")))

    picked = ranked.groupBy(group).agg(
        F.max("total").alias("total"),
        *[at(low[name]).alias(f"{name}_low") for name in points],
        *[at(high[name]).alias(f"{name}_high") for name in points],
    )
    out = {}
    for name in points:
        below, above = F.col(f"{name}_low"), F.col(f"{name}_high")
        between = (high[name] - position[name]) * below + (position[name] - low[name]) * above
        out[name] = F.when(below == above, below).otherwise(between)
    found = picked.select(group, *[expr.alias(name) for name, expr in out.items()])
    empty = buckets.filter(F.col("total") == 0).select(group).distinct()
    return found.unionByName(empty, allowMissingColumns=True)


def _points(rank: str) -> dict[str, float]:
    return {f"{rank}_p{round(p * 100)}": p for p in QUINTILE_POINTS}


def area_percentiles(units: DataFrame, area: str, rank: str = "imd_rank") -> DataFrame:
    """The four quintile borders of the rank within each area."""
    return exact_percentiles(units, area, rank, _points(rank))


def area_quintile(units: DataFrame, area: str, name: str, rank: str = "imd_rank") -> DataFrame:
    """Add the quintile ``"1"``..``"5"`` of the rank within the area.

    A rank equal to a border belongs to the lower quintile; a null rank or a
    null area has no quintile.
    """
    names = list(_points(rank))
    joined = units.join(area_percentiles(units, area, rank), area, "left")
    value = F.col(rank)
    out = F.when(value > F.col(names[-1]), F.lit(str(len(names) + 1)))
    for quintile in range(len(names), 0, -1):
        out = F.when(value <= F.col(names[quintile - 1]), F.lit(str(quintile))).otherwise(out)
    return joined.withColumn(name, out).drop(*names)


def area_names(names: DataFrame) -> DataFrame:
    """Lower-tier code to upper-tier name, one row per distinct pair of codes."""
    return names.select("ltla22cd", "utla22cd", F.col("utla22nm").alias("la_name")).distinct()


def postcode_areas(postcodes: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (small area, local authority code, name) of a postcode lookup.

    Postcodes are reduced to distinct pairs before the join, names are attached
    to the few pairs that are left.
    """
    pairs = postcodes.select("lsoa11", "laua").distinct()
    named = pairs.join(area_names(names).withColumnRenamed("ltla22cd", "laua"), "laua", "left")
    return named.select("lsoa11", F.col("laua").alias("la_code"), "la_name").distinct()


def small_area_units(imd: DataFrame) -> DataFrame:
    return imd.select(F.col("LSOA11CD").alias("lsoa_derived"), F.col("IMD_RANK").alias("imd_rank"))


def local_authority_quintiles(
    imd: DataFrame, postcodes: DataFrame, names: DataFrame
) -> DataFrame:
    """Small area -> local authority code, name and quintile within it."""
    areas = postcode_areas(postcodes, names).withColumnRenamed("lsoa11", "lsoa_derived")
    units = small_area_units(imd).join(areas, "lsoa_derived", "left")
    out = area_quintile(units, "la_code", "imd_quintile_la")
    return out.select("la_code", "la_name", "lsoa_derived", "imd_quintile_la")


def region_quintiles(imd: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Small area -> quintile within its region."""
    areas = postcodes.select(F.col("lsoa11").alias("lsoa_derived"), "rgn").distinct()
    units = small_area_units(imd).join(areas, "lsoa_derived", "left")
    out = area_quintile(units, "rgn", "imd_quintile_region")
    return out.select("lsoa_derived", "imd_quintile_region")


def area_lookup(imd: DataFrame, postcodes: DataFrame, names: DataFrame) -> DataFrame:
    """All area columns by small area.

    The three lookups share their key, so persons are joined once.  A small
    area that lies in several local authorities has several rows here and
    multiplies its persons, as three separate left joins would.  The national
    lookup must have one row per small area.
    """
    national = assert_unique_lookup(
        imd.select(
            F.col("LSOA11CD").alias("lsoa_derived"),
            F.col("IMD_QUINTILE").cast("string").alias("imd_quintile"),
        ),
        "lsoa_derived",
    )
    joined = national.join(
        local_authority_quintiles(imd, postcodes, names), "lsoa_derived", "left"
    ).join(region_quintiles(imd, postcodes), "lsoa_derived", "left")
    return joined.withColumn("la_derived", F.col("la_name"))


def attach_areas(
    df: DataFrame,
    lookup: DataFrame,
    key: str = "lsoa_derived",
    spread_by: Sequence[str] = ("dob",),
    salts: int = 1,
) -> DataFrame:
    """Left join of persons to their area columns.

    ``lookup`` is best a stored table, whose size Spark knows: one within ``autoBroadcastJoinThreshold`` is
    broadcast, and no person is shuffled.  Beyond that persons are shuffled by the key.  Those without one are
    dealt out under keys that no lookup has, by a hash of the columns ``spread_by`` (of those that ``df`` has, or
    else all; with them other columns stay prunable).  With ``salts`` above 1 each area's persons go to so many tasks and
    the lookup's rows are repeated as often, for areas that hold a large share of all persons.
    """
    spread = F.xxhash64(*([c for c in spread_by if c in df.columns] or df.columns))
    nowhere = F.concat(F.lit("\0"), F.pmod(spread, F.lit(SPREAD)).cast("string"))
    named = lookup.withColumnRenamed(key, "_area")
    same = F.coalesce(F.col(key), nowhere) == F.col("_area")
    if salts > 1:
        named = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = same & (F.pmod(spread, F.lit(salts)).cast("int") == F.col("_salt"))
    return df.join(named, same, "left").drop("_area", "_salt")


def merge_small_areas(
    df: DataFrame, mapping: Mapping[str, str] = fv.SMALL_AREAS, column: str = "la_derived"
) -> DataFrame:
    """Publish small areas with a neighbour; null stays null."""
    return df.replace(dict(mapping), subset=[column])
