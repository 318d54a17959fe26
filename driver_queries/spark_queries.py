"""Queries over the driver tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise import schemas
from cohortwise.config import (
    CountSpec,
    PublicationText,
    RunConfig,
    standard_rules,
)
from cohortwise.functions import predicates as p
from cohortwise.functions.bands import (
    GROUP_BANDS,
    REPORT_BANDS,
    STANDARD_BANDS,
    BandScheme,
    assign_band,
)
from cohortwise.functions.dates import age_at
from cohortwise.functions.semantics import round_half_away, round_to_base
from cohortwise.operators import (
    areas,
    check_cells,
    checks,
    counts,
    disclosure,
    guards,
    linkage,
    poisson,
    publication,
    rates,
)
from cohortwise.operators.check_cells import CheckVariant, LinkageVariant
from cohortwise.operators.characteristics import derive_characteristics
from cohortwise.operators.population import expand_months, load_person, static_filters
from cohortwise.operators.tables import (
    AGG_COLUMNS,
    RATE_TABLES,
    embed_sex,
    rate_tables,
    union_tables,
)
from cohortwise.plans.monthly_run import all_counts, published_rows, study_population, study_values
from cohortwise.sources import readers, writers
from cohortwise.sources.readers import default_poisson_limits, default_standard_population
from cohortwise.sources.staging import fingerprinted, read_or_compute, shared_folder
from driver_queries import mapping

Query = Callable[[SparkSession, str], DataFrame]

RUN = RunConfig(2023, 1)
RUN_50 = RunConfig(2023, 1, min_age=50)
END = RUN.period_end
TEXT = PublicationText(source="Linked person register")


# ---------------------------------------------------------------- inputs


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loaded persons of the driver tables."""
    return load_person(mapping.raw_persons(spark, sf_dir))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area lookup, written once for a folder of driver tables."""
    table = areas.area_lookup(
        mapping.imd(spark, sf_dir),
        mapping.postcodes(spark, sf_dir),
        mapping.area_names(spark, sf_dir),
    )
    written = mapping.stored(spark, sf_dir, "areas", table, ["part", "nation"],
                             mapping._area_columns("spark"))
    values_of(written)
    return written


_values: dict[tuple[str, ...], dict[str, list[str]]] = {}


def values_of(written: DataFrame) -> dict[str, list[str]]:
    """``study_values`` of a written lookup, read once: another lookup has other files."""
    files = tuple(sorted(written.inputFiles()))
    if files not in _values:
        _values[files] = study_values(written)
    return _values[files]


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study population with all characteristics and areas."""
    return study_population(mapping.raw_persons(spark, sf_dir), lookup(spark, sf_dir))


def study_counts(spark: SparkSession, sf_dir: str, run: RunConfig) -> DataFrame:
    """The counts of a whole run."""
    areas_of = lookup(spark, sf_dir)
    people = study_population(mapping.raw_persons(spark, sf_dir), areas_of)
    return all_counts(people, run, values_of(areas_of))


def study_without_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_characteristics(static_filters(load_person(mapping.raw_persons(spark, sf_dir))))


def weights(spark: SparkSession) -> DataFrame:
    return rates.adapt_standard_population(default_standard_population(spark))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison of engines."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# ---------------------------------------------------------------- bands, recodes, filters


def _band_query(scheme: BandScheme) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        age = age_at(p.day(END), F.col("dob"))
        return (
            persons(spark, sf_dir)
            .groupBy(assign_band(age, scheme).alias("band"))
            .agg(F.count("*").alias("n"))
        )

    return query


def _recode_query(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (
            derive_characteristics(persons(spark, sf_dir))
            .groupBy(*columns)
            .agg(F.count("*").alias("n"))
        )

    return query


def static_filter_nulls(spark, sf_dir):
    return (
        static_filters(persons(spark, sf_dir))
        .groupBy("rgn_derived")
        .agg(
            F.count("*").alias("n"),
            *[F.count(f"{d}_vacc_date").alias(f"n_{d}") for d in fv.DOSES],
        )
    )


def age_window_counts(spark, sf_dir):
    age = age_at(p.day(END), F.col("dob"))
    windows = {"none": (None, None), "low": (18, None), "high": (None, 50), "both": (18, 50)}

    def inside(bounds) -> Column:
        window = p.age_window(age, *bounds)
        return F.lit(True) if window is None else window

    return (
        persons(spark, sf_dir)
        .groupBy("rgn_derived")
        .agg(*[F.count_if(inside(b)).alias(f"n_{name}") for name, b in windows.items()])
    )


def load_person_dates(spark, sf_dir):
    """Parsed dose dates, bad and empty text included."""
    df = persons(spark, sf_dir)
    return df.groupBy(F.last_day("first_vacc_date").alias("month_end")).agg(
        F.count("*").alias("n"),
        F.min("second_vacc_date").alias("second_from"),
        F.max("third_vacc_date").alias("third_to"),
    )


def month_expansion(spark, sf_dir):
    return (
        expand_months(persons(spark, sf_dir), RUN)
        .groupBy("year", "month")
        .agg(F.count("*").alias("n"), F.count("dob").alias("n_dob"))
    )


# ---------------------------------------------------------------- checks


def _check(function: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(persons(spark, sf_dir)))

    return query


def _in_order(function: Callable[[DataFrame], DataFrame]) -> Query:
    """A report (a few rows) with the place of each row in it."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = rounded(function(persons(spark, sf_dir)))
        numbered = report.withColumn("_at", F.monotonically_increasing_id())
        return numbered.withColumn("position", F.row_number().over(Window.orderBy("_at"))).drop("_at")

    return query


def _deaths(function: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(checks.death_cells(persons(spark, sf_dir)))

    return query


def _linkage(function: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = linkage.linkage_cells(persons(spark, sf_dir), END, END, "first", min_age=18)
        return rounded(function(cells))

    return query


# ---------------------------------------------------------------- areas


def _units(spark, sf_dir):
    pairs = areas.postcode_areas(
        mapping.postcodes(spark, sf_dir), mapping.area_names(spark, sf_dir)
    ).withColumnRenamed("lsoa11", "lsoa_derived")
    return areas.small_area_units(mapping.imd(spark, sf_dir)).join(pairs, "lsoa_derived", "left")


def area_percentiles(spark, sf_dir):
    return rounded(areas.area_percentiles(_units(spark, sf_dir), "la_code"))


def area_quintile_la(spark, sf_dir):
    return areas.local_authority_quintiles(
        mapping.imd(spark, sf_dir), mapping.postcodes(spark, sf_dir),
        mapping.area_names(spark, sf_dir),
    )


def area_quintile_region(spark, sf_dir):
    return areas.region_quintiles(
        mapping.imd(spark, sf_dir), mapping.postcodes(spark, sf_dir)
    )


def distinct_lookup(spark, sf_dir):
    return areas.postcode_areas(
        mapping.split_postcodes(spark, sf_dir), mapping.area_names(spark, sf_dir)
    )


def lookup_left_join_fanout(spark, sf_dir):
    """Small areas in two local authorities multiply their persons."""
    table = areas.area_lookup(
        mapping.imd(spark, sf_dir), mapping.split_postcodes(spark, sf_dir),
        mapping.area_names(spark, sf_dir),
    )
    joined = areas.attach_areas(mapping.raw_persons(spark, sf_dir), table)
    return joined.groupBy("la_code", "imd_quintile", "imd_quintile_la", "imd_quintile_region").agg(
        F.count("*").alias("n")
    )


def study_population_areas(spark, sf_dir):
    return (
        study(spark, sf_dir)
        .groupBy("la_derived", "imd_quintile", "imd_quintile_la", "imd_quintile_region")
        .agg(F.count("*").alias("n"))
    )


def merge_small_areas(spark, sf_dir):
    named = _units(spark, sf_dir).withColumn("la_derived", F.col("la_name"))
    return areas.merge_small_areas(named).groupBy("la_derived").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- counts


def _counts(
    run: RunConfig, exposures: Sequence[str], group_vars: Sequence[str], with_areas: bool = False
) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        people = study(spark, sf_dir) if with_areas else study_without_areas(spark, sf_dir)
        return counts.monthly_counts(people, run, exposures, group_vars)

    return query


def monthly_counts_area(spark, sf_dir):
    df = counts.monthly_counts(
        study(spark, sf_dir), RUN, fv.AREA_EXPOSURES, ["age_group", "la_derived"]
    )
    return counts.period_exclusions(counts.from_period(df, fv.AREA_FIRST_PERIOD))


def period_exclusions(spark, sf_dir):
    df = counts.monthly_counts(study_without_areas(spark, sf_dir), RUN, ["sex"], ["age_group"])
    return counts.period_exclusions(df)


def all_calls(spark, sf_dir):
    """The three calls in one plan, summed over bands and areas."""
    df = study_counts(spark, sf_dir, RUN)
    return df.groupBy("call", "vaccine_number", "year", "month", "exposure", "group").agg(
        F.sum("population").alias("population"), F.sum("vaccinated").alias("vaccinated")
    )


# ---------------------------------------------------------------- rates


def standard_population(spark, sf_dir):
    """Persons of each standard band beside the weight of the band."""
    age = age_at(p.day(END), F.col("dob"))
    bands = persons(spark, sf_dir).groupBy(assign_band(age, STANDARD_BANDS).alias("age_group_esp"))
    return rounded(
        bands.agg(F.count("*").alias("n")).join(weights(spark), "age_group_esp", "left")
    )


def round_base5(spark, sf_dir):
    return (
        mapping.read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.count("*").alias("n"))
        .select("l_suppkey", "n", round_to_base(F.col("n")).alias("n_rounded"))
    )


def round_half_away_prices(spark, sf_dir):
    price = F.col("l_extendedprice") - 50_000
    return mapping.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        round_half_away(price).alias("whole"),
        F.round(round_half_away(price, 1), 6).alias("tenths"),
    )


def _single_rates(call: str, exposures: tuple[str, ...], area: str, tables: Sequence[str],
                  with_areas: bool = False, run: RunConfig = RUN) -> Query:
    """Rates of some tables from the counts they need."""
    start = fv.AREA_FIRST_PERIOD if call == "la" else None
    specs = [CountSpec(call, exposures, area, start)]
    chosen = tuple(t for t in RATE_TABLES if t.name in tables)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        people = study(spark, sf_dir) if with_areas else study_without_areas(spark, sf_dir)
        table = counts.monthly_counts_all(people, run, specs)
        return rounded(
            rate_tables(table, weights(spark), default_poisson_limits(spark), run, chosen)
        )

    return query


SMALL = ("sex", "disability", "education", "rural_urban")


def crude_rates(spark, sf_dir):
    """Crude rates by exposure and age group, by the operator itself."""
    df = counts.monthly_counts(
        study_without_areas(spark, sf_dir), RUN, ["disability"], ["age_group"]
    )
    return rounded(
        rates.crude_rates(df, ["vaccine_number", "year", "month", "group", "age_group"])
    )


def age_standardised_rates(spark, sf_dir):
    """Standardised rates by region, by the operator itself."""
    df = counts.monthly_counts(
        study_without_areas(spark, sf_dir), RUN, ["region"], ["age_group_esp"]
    )
    return rounded(
        rates.age_standardised_rates(
            df, weights(spark), default_poisson_limits(spark), RUN.min_age, RUN.max_age,
            ["vaccine_number", "year", "month", "group"],
        )
    )


def complement_first_dose(spark, sf_dir):
    df = counts.monthly_counts(study_without_areas(spark, sf_dir), RUN, ["sex"], [])
    return rates.complement_first_dose(df)


def embed_sex_rows(spark, sf_dir):
    df = counts.monthly_counts(
        study_without_areas(spark, sf_dir), RUN, ["sex", "disability"], []
    )
    return embed_sex(df)


def _regional_rates(spark, sf_dir, tables=("total", "exposure", "region", "age", "region_age")):
    specs = [CountSpec("region", SMALL, "region")]
    table = counts.monthly_counts_all(study_without_areas(spark, sf_dir), RUN, specs)
    chosen = tuple(t for t in RATE_TABLES if t.name in tables)
    return rate_tables(table, weights(spark), default_poisson_limits(spark), RUN, chosen)


def union_of_tables(spark, sf_dir):
    """A table without rates beside one with them: missing columns are null."""
    people = study_without_areas(spark, sf_dir)
    by_sex = counts.monthly_counts(people, RUN, ["sex"], [])
    by_region = counts.monthly_counts(people, RUN, ["disability"], ["region"])
    return union_tables(by_sex, by_region)


# ---------------------------------------------------------------- disclosure, publication


def _from_rates(function: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(_regional_rates(spark, sf_dir)))

    return query


def _exposure_region_rates(spark, sf_dir):
    specs = [CountSpec("region", ("ethnicity", "religion"), "region")]
    table = counts.monthly_counts_all(study_without_areas(spark, sf_dir), RUN, specs)
    chosen = tuple(t for t in RATE_TABLES if t.name == "exposure_region")
    return rate_tables(table, weights(spark), default_poisson_limits(spark), RUN, chosen)


def suppress_rules(spark, sf_dir):
    return rounded(
        disclosure.suppress(_exposure_region_rates(spark, sf_dir), standard_rules(18))
    )


def suppress_rules_50(spark, sf_dir):
    """Rules of a run from 50, which name local authorities and leave fields open."""
    specs = [CountSpec("la", ("nssec_agg", "language"), "la_derived", fv.AREA_FIRST_PERIOD)]
    table = counts.monthly_counts_all(study(spark, sf_dir), RUN_50, specs)
    chosen = tuple(t for t in RATE_TABLES if t.name == "la_exposure")
    df = rate_tables(table, weights(spark), default_poisson_limits(spark), RUN_50, chosen)
    return rounded(disclosure.suppress(df, standard_rules(50)))


def _published(spark, sf_dir):
    return published_rows(_regional_rates(spark, sf_dir), RUN, TEXT)


def publish_dataset(spark, sf_dir):
    return rounded(publication.dataset(_published(spark, sf_dir)))


def _shared_path(spark, name):
    """A new place in the folder that all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def published_files(spark, sf_dir):
    """The files of the periods as they were written, read back as text."""
    path = _shared_path(spark, "dataset")
    published = rounded(publication.dataset(_published(spark, sf_dir)))
    writers.write_periods(published, path)
    texts = writers.read_periods(spark, path)
    return texts.select(*[F.col(c).cast(t) for c, t in published.dtypes])


def person_table_scan(spark, sf_dir):
    """The used columns of a table that has more."""
    raw = mapping.raw_persons(spark, sf_dir)
    raw.withColumn("unused", F.lit(1)).createOrReplaceTempView("persons_scan_v2")
    table = readers.read_person_table(spark, "persons_scan", "_v2")
    return table.groupBy("rgn_derived", "sex_census").agg(F.count("*").alias("n"))


def csv_header_order(spark, sf_dir):
    """A lookup written with its columns in another order and one more, read by header."""
    path = _shared_path(spark, "imd")
    table = mapping.imd(spark, sf_dir)
    shuffled = table.select(F.lit("x").alias("extra"), *reversed(table.columns))
    writers.write_csv(shuffled, path)
    return readers.read_imd(spark, path).select(
        *[F.col(c).cast(t) for c, t in table.dtypes])


def resumed_stage(spark, sf_dir):
    """A stage that is found written, and so not computed again."""
    path = _shared_path(spark, "cells")
    cells = checks.death_cells(persons(spark, sf_dir))
    read_or_compute(spark, path, lambda: cells, recompute=False)
    return read_or_compute(spark, path, lambda: cells.limit(0), recompute=False)


def publish_metadata(spark, sf_dir):
    return publication.metadata(_published(spark, sf_dir))


def period_calendar(spark, sf_dir):
    """First doses in every month of the run, months without any included."""
    given = persons(spark, sf_dir).groupBy(
        F.year("first_vacc_date").alias("year"), F.month("first_vacc_date").alias("month")
    ).agg(F.count("*").alias("n"))
    return (
        publication.period_calendar(spark, RUN)
        .join(given, ["year", "month"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


# ---------------------------------------------------------------- one scan, state, guards, files


def _shared_cells(spark, sf_dir):
    """The cells of several reports from one scan of the persons."""
    variants = (
        CheckVariant("any", END),
        CheckVariant("adults", END, END, min_age=18),
        CheckVariant("window", "2022-01-31", END, "2022-01-31", 18, 90),
    )
    return check_cells.check_cells(
        persons(spark, sf_dir), variants, LinkageVariant(END, END, "first", 18))


def _shared(function: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(_shared_cells(spark, sf_dir)))

    return query


PERSON_NAMES = list(fv.PERSON_COLUMNS.values())
STATE_SPECS = [("all", ("sex", "disability", "education"), ("region",))]


def incremental_month(spark, sf_dir):
    """The last month from the state of the month before and its own changes."""
    before = RunConfig(2022, 12)
    people = study_without_areas(spark, sf_dir)
    state = counts.month_state(people, before, STATE_SPECS, counts.BANDS)
    path = _shared_path(spark, "state")
    state.write.parquet(path)
    now = counts.next_state(spark.read.parquet(path), people, RUN, STATE_SPECS, counts.BANDS)
    found = counts.by_dose(counts.state_counts(now, RUN, STATE_SPECS, counts.BANDS))
    return found.withColumnRenamed("area_0", "region").select(
        "vaccine_number", "year", "month", "exposure", "age_group", "age_group_esp", "region", "group",
        "population", "vaccinated")


def rate_guards(spark, sf_dir):
    """What a lookup of weights without one band and with another twice does, counted as it is joined."""
    df = counts.monthly_counts(
        study_without_areas(spark, sf_dir), RUN, ["disability"], ["age_group_esp", "region"])
    whole = weights(spark)
    faulty = whole.where("age_group_esp <> '85-89'").unionByName(whole.where("age_group_esp = '30-34'"))
    guard = guards.Guard()
    joined = guards.watched_lookup_join(
        guard, df, faulty, "age_group_esp", "ESP", "weights",
        conditions={"no_group": F.col("group").isNull()})
    joined.write.parquet(_shared_path(spark, "weighted"))
    return guard.table(spark)


def fingerprinted_stage(spark, sf_dir):
    """A stage asked for with one spec twice, then with another; a half-written one is there as well."""
    path = _shared_path(spark, "stage")
    table = [f"{sf_dir}/lineitem.parquet"]
    cells = checks.deaths_by_month(checks.death_cells(persons(spark, sf_dir)))
    empty = cells.where("n < 0")
    empty.write.parquet(f"{path}/half-written")
    found = []
    for place, (least, made) in enumerate([(0, cells), (0, empty), (5, cells.where("n >= 5"))]):
        stage = fingerprinted(spark, path, lambda made=made: made, {"least": least}, table)
        found.append(stage.withColumn("asked", F.lit(place)))
    return found[0].unionByName(found[1]).unionByName(found[2])


def poisson_limits_exact(spark, sf_dir):
    """Limits of the numbers of lines of orders, parts and suppliers' places."""
    lines = mapping.read(spark, sf_dir, "lineitem")
    sizes = [lines.groupBy(*keys).agg(F.count("*").alias("n")).select("n")
             for keys in (["l_orderkey"], ["l_partkey"], ["l_suppkey", "l_linenumber"])]
    numbers = sizes[0].unionByName(sizes[1]).unionByName(sizes[2])
    return rounded(poisson.poisson_limits(
        numbers.groupBy("n").agg(F.count("*").alias("groups")), "n"))


def _marked_lines(spark, sf_dir):
    """A lookup file in which some lines are broken."""
    path = _shared_path(spark, "imd-lines")
    name = "LSOA11CD,IMD_RANK,IMD_QUINTILE"
    lines = mapping.read(spark, sf_dir, "part").selectExpr(f"{mapping.MARKED_LINE['spark']} AS `{name}`")
    writer = lines.write.option("header", True).option("sep", "\u0001").option("quote", "")
    writer.csv(path)
    return readers.read_csv_checked(spark, path, schemas.IMD)


def csv_good_rows(spark, sf_dir):
    return _marked_lines(spark, sf_dir)[0]


def csv_refused_lines(spark, sf_dir):
    return _marked_lines(spark, sf_dir)[1]


MAX_ROWS = 40


def bounded_period_files(spark, sf_dir):
    """Rows of each period's files, whether all files keep the bound and follow each other in order."""
    path = _shared_path(spark, "bounded")
    published = rounded(publication.dataset(_published(spark, sf_dir)))
    order = ["Category", "SubCategory", "ChartTitle", "IndDropdown", "Sex", "CategoryType"]
    writers.write_bounded_periods(published, path, order, MAX_ROWS)
    place = F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in order])
    files = writers.read_periods(spark, path).withColumn("file", F.input_file_name()).groupBy(
        "TimePeriodLabel", "file").agg(
            F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    before = F.lag("last").over(Window.partitionBy("TimePeriodLabel").orderBy("file"))
    return files.withColumn("follows", F.coalesce(before <= F.col("first"), F.lit(True))).groupBy(
        "TimePeriodLabel").agg(
            F.sum("n").alias("n"), (F.max("n") <= MAX_ROWS).alias("bounded"),
            F.bool_and("follows").alias("in_order"))


def person_full_scan(spark, sf_dir):
    """All columns of a table of the catalog."""
    mapping.raw_persons(spark, sf_dir).createOrReplaceTempView("persons_whole")
    table = readers.read_table(spark, "persons_whole")
    return table.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in table.columns])


def output_names(spark, sf_dir):
    """The folders that runs write to, and the rows in them."""
    base = _shared_path(spark, "outputs")
    deaths = checks.deaths_by_month(checks.death_cells(persons(spark, sf_dir)))
    runs = (RUN, RUN_50, RunConfig(2023, 1, dataset_version="v2"))
    for run in runs:
        writers.write_csv(deaths, f"{base}/{writers.output_name('deaths', run)}")
    found = [
        spark.read.option("header", True).csv(f"{base}/{name}").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("name"), "n")
        for name in (writers.output_name("deaths", run) for run in runs)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


# ---------------------------------------------------------------- whole run


def monthly_total(spark, sf_dir):
    """Flagship: monthly age-standardised uptake of the whole study population."""
    specs = [CountSpec("region", ("sex",), "region")]
    table = counts.monthly_counts_all(study_without_areas(spark, sf_dir), RUN, specs)
    chosen = tuple(t for t in RATE_TABLES if t.name == "total")
    return rounded(
        rate_tables(table, weights(spark), default_poisson_limits(spark), RUN, chosen)
    )


def _run_rates(spark, sf_dir, run, keep_name=False):
    table = study_counts(spark, sf_dir, run)
    return rate_tables(
        table, weights(spark), default_poisson_limits(spark), run, keep_name=keep_name
    )


def _run_rows(run: RunConfig) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every row of every table of a run."""
        df = _run_rates(spark, sf_dir, run, keep_name=True)
        return rounded(disclosure.suppress(df, standard_rules(run.min_age)))

    return query


def _published_run(run: RunConfig, part: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(part(published_rows(_run_rates(spark, sf_dir, run), run, TEXT)))

    return query


def _run(run: RunConfig) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every table of a run, from one count plan, summed per published table."""
        df = _run_rates(spark, sf_dir, run, keep_name=True)
        safe = disclosure.suppress(df, standard_rules(run.min_age))
        figures = [c for c in AGG_COLUMNS if c.startswith(("crude", "age_standardised"))]
        return safe.groupBy("table", "vaccine_number", "year", "month", "Sex").agg(
            F.count("*").alias("rows"),
            F.count("vaccinated").alias("published"),
            F.sum("population").alias("population"),
            F.sum("vaccinated").alias("vaccinated"),
            *[F.round(F.sum(c), 4).alias(c) for c in figures],
        )

    return query


def queries() -> dict[str, Query]:
    return {
        "monthly_total": monthly_total,
        "full_run_18": _run(RUN),
        "full_run_50": _run(RUN_50),
        "band_age_a": _band_query(REPORT_BANDS),
        "band_age_b": _band_query(GROUP_BANDS),
        "band_age_esp": _band_query(STANDARD_BANDS),
        "recode_case_when": _recode_query("religion", "language"),
        "recode_codes": _recode_query("education", "disability", "rural_urban"),
        "recode_numeric_ranges": _recode_query("ethnicity", "nssec_agg"),
        "recode_not_in_null": _recode_query("sex", "country_of_birth", "care_home", "tenure"),
        "recode_region": _recode_query("region"),
        "load_person_dates": load_person_dates,
        "static_filter_nulls": static_filter_nulls,
        "age_window_counts": age_window_counts,
        "month_expansion": month_expansion,
        "registrations_by_month": _deaths(checks.registrations_by_month),
        "registrations_by_day": _deaths(checks.registrations_by_day),
        "deaths_by_month": _deaths(checks.deaths_by_month),
        "deaths_by_day": _deaths(checks.deaths_by_day),
        "dose_trend_all": _check(lambda df: checks.dose_trend(df, death_date=END)),
        "dose_trend_cumulative": _check(
            lambda df: checks.dose_trend(df, death_date=END, age_date=END, min_age=18)
        ),
        "rate_by_age_any_date": _check(
            lambda df: checks.rate_by_age(df, death_date=END, age_date=END)
        ),
        "rate_by_age": _check(
            lambda df: checks.rate_by_age(
                df, death_date="2022-01-31", age_date=END, vacc_date="2022-01-31",
                min_age=18, max_age=90,
            )
        ),
        "missing_profile_all": _check(lambda df: checks.missing_profile(df, END)),
        "missing_profile": _check(
            lambda df: checks.missing_profile(df, END, age_date=END, min_age=18)
        ),
        "dose_trend_order": _in_order(lambda df: checks.dose_trend(df, death_date=END)),
        "rate_by_age_order": _in_order(
            lambda df: checks.rate_by_age(df, death_date=END, age_date=END)
        ),
        "missing_profile_order": _in_order(lambda df: checks.missing_profile(df, END)),
        "linkage_overall": _linkage(linkage.linkage_overall),
        "linkage_by_band_wide": _linkage(
            lambda c: linkage.linkage_wide(c, "age_group", "age_group")
        ),
        "linkage_by_sex_wide": _linkage(lambda c: linkage.linkage_wide(c, "sex", "sex")),
        "linkage_mean_age": _linkage(linkage.linkage_mean_age),
        "linkage_dist_by_band_wide": _linkage(
            lambda c: linkage.linkage_wide(c, "age_group", "linked")
        ),
        "linkage_dist_by_sex_wide": _linkage(lambda c: linkage.linkage_wide(c, "sex", "linked")),
        "area_percentiles": area_percentiles,
        "area_quintile_la": area_quintile_la,
        "area_quintile_region": area_quintile_region,
        "distinct_lookup": distinct_lookup,
        "lookup_left_join_fanout": lookup_left_join_fanout,
        "study_population_areas": study_population_areas,
        "merge_small_areas": merge_small_areas,
        "monthly_counts_region": _counts(
            RUN, ("sex", "disability", "ethnicity", "religion"), ["age_group", "region"]
        ),
        "monthly_counts_area": monthly_counts_area,
        "monthly_counts_sex": _counts(
            RUN, ("disability", "nssec_agg", "tenure", "rural_urban"), ["age_group_esp", "sex"]
        ),
        "monthly_counts_min_age_exposure": _counts(
            RUN, ("education", "language"), ["age_group", "age_group_esp"]
        ),
        "monthly_counts_50": _counts(RUN_50, ("education", "sex"), ["age_group_esp"]),
        "monthly_counts_no_band": _counts(RUN, ("country_of_birth",), ["region", "sex"]),
        "monthly_counts_all": all_calls,
        "period_exclusions": period_exclusions,
        "standard_population": standard_population,
        "round_base5": round_base5,
        "round_half_away": round_half_away_prices,
        "complement_first_dose": complement_first_dose,
        "crude_rates": crude_rates,
        "age_standardised_rates": age_standardised_rates,
        "asr_care_home": _single_rates(
            "region", ("care_home", "sex"), "region",
            ["total", "exposure", "region", "exposure_region", "age", "exposure_age", "region_age"],
        ),
        "asr_by_exposure": _single_rates("region", SMALL, "region", ["exposure"]),
        "asr_by_region": _single_rates("region", ("sex",), "region", ["region"]),
        "asr_exposure_region": _single_rates("region", SMALL, "region", ["exposure_region"]),
        "asr_deprivation": _single_rates(
            "region", ("imd_quintile", "imd_quintile_region"), "region",
            ["exposure", "exposure_region"], with_areas=True,
        ),
        "asr_by_sex": _single_rates("sex", ("disability", "education", "tenure"), "sex", ["sex"]),
        "crude_by_age": _single_rates("region", ("sex",), "region", ["age"]),
        "crude_exposure_age": _single_rates("region", SMALL, "region", ["exposure_age"]),
        "crude_region_age": _single_rates("region", ("sex",), "region", ["region_age"]),
        "la_total": _single_rates("la", ("sex",), "la_derived", ["la"], with_areas=True),
        "la_exposure": _single_rates(
            "la", ("disability", "imd_quintile_la"), "la_derived", ["la_exposure"], with_areas=True
        ),
        "la_age": _single_rates("la", ("sex",), "la_derived", ["la_age"], with_areas=True),
        "embed_sex": embed_sex_rows,
        "union_tables": union_of_tables,
        "disclosure_counts": _from_rates(disclosure.disclosure_counts),
        "disclosure_by_month": _from_rates(disclosure.disclosure_by_month),
        "disclosure_listing": _from_rates(disclosure.disclosure_listing),
        "disclosure_listing_complement": _from_rates(
            lambda df: disclosure.disclosure_listing(df, "not_vaccinated")
        ),
        "suppress_thresholds": _from_rates(disclosure.suppress),
        "suppress_rules": suppress_rules,
        "suppress_rules_50": suppress_rules_50,
        "rates_long": _from_rates(publication.rates_long),
        "publish_dataset": publish_dataset,
        "publish_metadata": publish_metadata,
        "published_files": published_files,
        "full_run_18_rows": _run_rows(RUN),
        "full_run_50_rows": _run_rows(RUN_50),
        "published_run_18": _published_run(RUN, publication.dataset),
        "published_run_50": _published_run(RUN_50, publication.dataset),
        "published_notes_50": _published_run(RUN_50, publication.metadata),
        "person_table_scan": person_table_scan,
        "csv_header_order": csv_header_order,
        "resumed_stage": resumed_stage,
        "period_calendar": period_calendar,
        "shared_deaths_by_month": _shared(
            lambda c: checks.deaths_by_month(check_cells.death_cells_of(c))),
        "shared_dose_trend": _shared(lambda c: check_cells.dose_trend_of(c, "adults")),
        "shared_rate_by_age": _shared(lambda c: check_cells.rate_by_age_of(c, "window")),
        "shared_missing_profile": _shared(
            lambda c: check_cells.missing_of(c, "any", PERSON_NAMES)),
        "shared_linkage_by_band": _shared(lambda c: linkage.linkage_wide(
            check_cells.linkage_cells_of(c), "age_group", "age_group")),
        "incremental_month": incremental_month,
        "rate_guards": rate_guards,
        "fingerprinted_stage": fingerprinted_stage,
        "poisson_limits_exact": poisson_limits_exact,
        "csv_good_rows": csv_good_rows,
        "csv_refused_lines": csv_refused_lines,
        "bounded_period_files": bounded_period_files,
        "person_full_scan": person_full_scan,
        "output_names": output_names,
    }
