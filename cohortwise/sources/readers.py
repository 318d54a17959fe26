"""Scans of the person table and of the lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise import fixed_values as fv
from cohortwise import schemas
from cohortwise.operators.poisson import poisson_limits
from cohortwise.sources.lookups import assert_unique_lookup

CORRUPT = "_corrupt_line"


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """Catalog table, all columns or a chosen list."""
    table = spark.table(name)
    return table.select(*columns) if columns else table


def read_person_table(spark: SparkSession, name: str, dataset_version: str = "") -> DataFrame:
    """The columns of the person table that the library uses, nothing more."""
    return read_table(spark, f"{name}{dataset_version}", list(fv.PERSON_COLUMNS))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated file with a header line, by declared schema.

    Columns are matched to the header by name, so files may hold more columns
    or another order.
    """
    header = spark.read.option("header", True).csv(path)
    return header.select(
        *[header[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """As ``read_csv``, and the lines that it can't take as they are: (good rows, refused lines).

    A line is refused if it has another number of fields than the header (a broken quote included), or if a
    value can't be read as its declared type.  A refused line has the line itself or, for a bad value, its
    fields joined by commas, and the reason.  Both results are plans over one scan each; an empty field
    is null and no reason to refuse.  A column of the schema that the header lacks is an error.
    """
    names = spark.read.option("header", True).csv(path).columns
    absent = [f.name for f in schema.fields if f.name not in names]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    # Without pruning a line is parsed whole, whatever columns are used later.
    lines = spark.read.schema(texts).option("header", True).option("columnPruning", False).option(
        "columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").csv(path)
    values = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    bad = [F.when(F.col(f"`{n}`").isNotNull() & v.isNull(), F.lit(f"bad {n}"))
           for n, v in values.items()]
    broken = F.col(CORRUPT).isNotNull()
    reason = F.when(broken, F.lit("wrong number of fields")).otherwise(
        F.nullif(F.concat_ws(", ", *bad), F.lit("")))
    judged = lines.select(
        reason.alias("reason"),
        F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]))
        .alias("line"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("row"))
    return (judged.where("reason IS NULL").select("row.*"),
            judged.where("reason IS NOT NULL").select("line", "reason"))


def read_imd(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.IMD)


def read_area_names(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.AREA_NAMES)


def read_standard_population(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.STANDARD_POPULATION)


def read_poisson_limits(spark: SparkSession, path: str) -> DataFrame:
    """One row per count, or an error when it is read."""
    return assert_unique_lookup(read_csv(spark, path, schemas.POISSON), "Deaths")


def _values(spark: SparkSession, rows: tuple, schema: T.StructType) -> DataFrame:
    """A small fixed table as a literal relation, which needs no Python on the way."""
    lines = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*lines)))


def default_standard_population(spark: SparkSession) -> DataFrame:
    return _values(spark, fv.STANDARD_POPULATION, schemas.STANDARD_POPULATION)


def exact_poisson_limits(spark: SparkSession, below: int = 100) -> DataFrame:
    """Limits of every count that isn't given normal ones, not of the multiples of 5 alone."""
    return poisson_limits(spark.range(1, below).withColumnRenamed("id", "Deaths"))


def default_poisson_limits(spark: SparkSession) -> DataFrame:
    return _values(spark, fv.POISSON_LIMITS, schemas.POISSON)

