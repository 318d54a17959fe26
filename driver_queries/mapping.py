"""The driver tables seen as the inputs of a run.

One order line is one person; parts are small areas, their sizes and brands say
in which local authority and region they lie, and nations name the local
authorities.  Every row of the tables is used.  The expressions are SQL that
Spark and DuckDB both understand, apart from a few words kept in ``DIALECTS``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from cohortwise.sources.staging import fingerprinted, shared_folder

DIALECTS = {
    "spark": {
        "days": "datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01')",
        "rollout_age": "datediff(DATE '2020-12-08', dob) / CAST(365.25 AS DOUBLE)",
        "compact": "date_format({0}, 'yyyyMMdd')",
        "text": "STRING",
    },
    "duckdb": {
        "days": "CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT)",
        "rollout_age": "datediff('day', dob, DATE '2020-12-08') / CAST(365.25 AS DOUBLE)",
        "compact": "strftime({0}, '%Y%m%d')",
        "text": "VARCHAR",
    },
}


ROW_GROUP = 16 << 20  # bytes; small, so that a scan of few stored files has a task for each core


def _steps(dialect: str) -> list[dict[str, str]]:
    words = DIALECTS[dialect]
    text = words["text"]

    def as_text(expression: str) -> str:
        return f"CAST({expression} AS {text})"

    def compact(column: str) -> str:
        return words["compact"].format(column)

    keep = {c: c for c in ("ok", "pk", "sk", "ln", "rf", "ls", "q", "dc", "tc", "d")}
    base = {
        "ok": "l_orderkey",
        "pk": "l_partkey",
        "sk": "l_suppkey",
        "ln": "l_linenumber",
        "rf": "l_returnflag",
        "ls": "l_linestatus",
        "q": "CAST(l_quantity AS INT)",
        "dc": "CAST(round(l_discount * 100) AS INT)",
        "tc": "CAST(round(l_tax * 100) AS INT)",
        "d": words["days"],
    }
    dates = {
        **keep,
        # Two persons in five are called in the first two weeks and again a month later, so that
        # the months named by the suppression rules have counts above the thresholds.
        "first_d": "CASE WHEN rf = 'N' AND ls = 'O' THEN NULL "
        "WHEN ok % 5 < 2 THEN DATE '2020-12-08' + (q % 14) "
        "ELSE DATE '2020-12-05' + CAST(floor(d / 4) AS INT) END",
        "dob": "CASE WHEN tc = 8 AND dc = 10 THEN NULL "
        "ELSE DATE '1925-01-01' + CAST((ok * 7919 + pk * 31) % 31000 AS INT) END",
        "dod": "CASE WHEN ln = 3 AND tc = 3 THEN DATE '2020-12-10' + CAST(floor(d / 4) AS INT) END",
    }
    second = {
        **keep,
        **{c: c for c in ("first_d", "dob", "dod")},
        "second_d": "CASE WHEN tc > 0 THEN first_d + "
        "CASE WHEN ok % 5 < 2 THEN 21 + 2 * ln ELSE 60 + q END END",
    }
    third = {
        **second,
        "second_d": "second_d",
        "third_d": "CASE WHEN dc < 8 THEN second_d + (120 + 10 * ln) END",
    }
    raw = {
        "cen_pr_flag": "CASE WHEN ln = 7 AND tc = 0 THEN 0 WHEN ln = 7 AND tc = 1 THEN NULL ELSE 1 END",
        "present_in_census": "CASE WHEN dc = 0 AND tc = 2 THEN 0 ELSE 1 END",
        "present_in_gpes": "CASE WHEN dc = 1 AND tc = 7 THEN NULL ELSE 1 END",
        "uresindpuk11_census": "CASE WHEN q = 44 AND ls = 'F' THEN 0 ELSE 1 END",
        "rgn_derived": "CASE WHEN q <= 45 THEN 'E1200000' || " + as_text("(q - 1) % 9 + 1")
        + " WHEN q = 46 THEN 'W92000004' WHEN q = 47 THEN NULL ELSE 'E12000007' END",
        "vaccine_number_1_vaccination_date_vacc": "CASE WHEN first_d IS NULL AND tc = 5 THEN '' "
        f"WHEN first_d IS NULL AND tc = 6 THEN 'unknown' ELSE {compact('first_d')} END",
        "vaccine_number_2_vaccination_date_vacc": compact("second_d"),
        "vaccine_number_3_vaccination_date_vacc": compact("third_d"),
        "dob_census": "dob",
        "dod_deaths": "dod",
        "dor_deaths": compact("(dod + 5)"),
        "dodyr_deaths": as_text("year(dod)"),
        "dodmt_deaths": as_text("month(dod)"),
        "sex_census": "CASE WHEN ln = 2 AND tc = 4 THEN NULL WHEN ls = 'O' THEN '1' ELSE '2' END",
        "ethpuk11_census": as_text("nullif(ok % 19, 0)"),
        "relpuk11_census": as_text("nullif(sk % 10, 0)"),
        "cob_census": "CASE WHEN pk % 12 <= 5 THEN " + as_text("921 + pk % 12")
        + " WHEN pk % 12 = 11 THEN NULL ELSE " + as_text("350 + pk % 12") + " END",
        "mainlangprf11_census": "CASE WHEN ln <= 5 THEN " + as_text("ln") + " WHEN ln = 6 THEN 'X' END",
        "age_at_rollout_years_vacc": words["rollout_age"],
        "vaccine_number_1_gender_vacc": "CASE WHEN q = 13 THEN NULL WHEN ls = 'O' THEN 'Male' "
        "ELSE 'Female' END",
        "hlqpuk11_census": "CASE WHEN dc <= 6 THEN " + as_text("10 + dc")
        + " WHEN dc = 7 THEN 'XX' WHEN dc <= 9 THEN '15' END",
        "disability_census": as_text("nullif(ok % 4, 0)"),
        "care_home_pr19": "CASE WHEN q = 1 THEN 'CH' END",
        "nsshuk11_census": "CASE WHEN tc <> 5 THEN " + as_text("(pk % 36) / CAST(2 AS DOUBLE)") + " END",
        "tenhuk11_census": "CASE WHEN (sk + ln) % 11 < 10 THEN " + as_text("(sk + ln) % 11") + " END",
        "rural_urban_derived": "CASE WHEN ok % 13 < 12 THEN substr('ABCDEF', "
        "CAST(ok % 13 % 6 + 1 AS INT), 1) || CASE WHEN ok % 13 < 6 THEN '1' ELSE '2' END END",
        "lsoa_derived": "CASE WHEN q = 17 THEN 'E01X' WHEN tc = 6 AND ln = 6 THEN NULL "
        "ELSE 'E01' || lpad(" + as_text("pk") + ", 9, '0') END",
    }
    return [base, dates, second, third, raw]


def _area_columns(dialect: str) -> dict[str, dict[str, str]]:
    text = DIALECTS[dialect]["text"]
    lsoa = f"'E01' || lpad(CAST(p_partkey AS {text}), 9, '0')"
    rank = "CAST(round(p_retailprice * 10) AS INT)"
    by_size = f"CASE WHEN p_size <> 49 THEN 'E07' || CAST(p_size % 25 AS {text}) END"
    return {
        "imd": {
            "LSOA11CD": lsoa,
            "IMD_RANK": f"CASE WHEN p_size = 13 AND p_brand = 'Brand#1' THEN NULL ELSE {rank} END",
            "IMD_QUINTILE": f"CAST(floor(({rank} - 9000) / 200) AS INT) + 1",
        },
        "postcodes": {
            "lsoa11": lsoa,
            "laua": by_size,
            "rgn": f"CASE WHEN p_size <> 48 THEN 'E1200000' || CAST(p_size % 9 + 1 AS {text}) END",
        },
        "other_postcodes": {
            "lsoa11": lsoa,
            "laua": f"'E07' || CAST(CAST(substr(p_brand, 7) AS INT) % 25 AS {text})",
            "rgn": f"CASE WHEN p_size <> 48 THEN 'E1200000' || CAST(p_size % 9 + 1 AS {text}) END",
        },
        "names": {
            "ltla22cd": f"'E07' || CAST(n_nationkey AS {text})",
            "utla22cd": f"'E10' || CAST(n_nationkey AS {text})",
            "utla22nm": "CASE n_nationkey WHEN 0 THEN 'Isles of Scilly' WHEN 1 THEN 'Cornwall' "
            "WHEN 2 THEN 'City of London' WHEN 3 THEN 'Hackney' WHEN 4 THEN 'Rutland' "
            "WHEN 5 THEN 'Derby' ELSE n_name END",
        },
    }


def _marked_line(dialect: str) -> str:
    """A line of the area file by part: one in ten is broken, in four ways."""
    imd_columns = _area_columns(dialect)["imd"]
    text = DIALECTS[dialect]["text"]
    code, rank, quintile = (
        f"coalesce(CAST({imd_columns[c]} AS {text}), '')" for c in ("LSOA11CD", "IMD_RANK", "IMD_QUINTILE"))
    return (
        f"CASE p_partkey % 40 WHEN 0 THEN {code} || ',' || {rank} "
        f"WHEN 1 THEN {code} || ',' || {rank} || ',' || {quintile} || ',more' "
        f"WHEN 2 THEN {code} || ',n/a,' || {quintile} "
        f"WHEN 3 THEN {code} || ',n/a,five' "
        f"ELSE {code} || ',' || {rank} || ',' || {quintile} END"
    )


MARKED_LINE = {dialect: _marked_line(dialect) for dialect in DIALECTS}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, tables: list[str],
           spec: object) -> DataFrame:
    """``df`` written once for a folder of driver tables, and again where these or ``spec`` change."""
    place = hashlib.md5(sf_dir.encode()).hexdigest()
    return fingerprinted(
        spark, f"{shared_folder(spark)}/driver-inputs/{place}/{name}", lambda: df, {"made": spec},
        [f"{sf_dir}/{t}.parquet" for t in tables], {"parquet.block.size": str(ROW_GROUP)})


def raw_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person table, as it would lie in a run's storage."""
    files = spark.sparkContext.defaultParallelism
    return stored(spark, sf_dir, "persons", spread_persons(spark, sf_dir, files),
                  ["lineitem"], [files, _steps("spark")])


def spread_persons(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    """The person table in ``files`` parts or more.

    A scan has a part for each core once its input is a few MB a core; only a smaller table is shuffled,
    so that what is shuffled doesn't grow with the input.
    """
    df = computed_persons(spark, sf_dir)
    return df if df.rdd.getNumPartitions() >= files else df.repartition(files)


def computed_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person table, from all order lines."""
    base, *rest = _steps("spark")
    df = read(spark, sf_dir, "lineitem").selectExpr(*_select(base))
    for step in rest:
        df = df.selectExpr(*_select(step))
    return df


def imd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*_select(_area_columns("spark")["imd"]))


def postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two postcodes per small area, in the same local authority."""
    rows = read(spark, sf_dir, "part").selectExpr(
        *_select(_area_columns("spark")["postcodes"]), "explode(array('A', 'B')) AS postcode"
    )
    return rows.select("postcode", "lsoa11", "laua", "rgn")


def split_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two postcodes per small area, mostly in two local authorities."""
    part = read(spark, sf_dir, "part")
    columns = _area_columns("spark")
    return part.selectExpr(*_select(columns["postcodes"])).unionByName(
        part.selectExpr(*_select(columns["other_postcodes"]))
    )


def area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr(*_select(_area_columns("spark")["names"]))


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_select(columns))} FROM {source}"


def duckdb_tables() -> dict[str, str]:
    """The same tables as DuckDB common table expressions, by name."""
    ctes, source = {}, "lineitem"
    for i, step in enumerate(_steps("duckdb")):
        name = f"line_{i}"
        ctes[name] = _sql(step, source)
        source = name
    ctes["raw"] = ctes.pop(source)
    areas = _area_columns("duckdb")
    ctes["imd"] = _sql(areas["imd"], "part")
    ctes["nspl"] = _sql(areas["postcodes"], "part, (VALUES ('A'), ('B')) AS two(postcode)")
    ctes["nspl_split"] = (
        _sql(areas["postcodes"], "part") + " UNION ALL " + _sql(areas["other_postcodes"], "part")
    )
    ctes["la_names"] = _sql(areas["names"], "nation")
    return ctes
