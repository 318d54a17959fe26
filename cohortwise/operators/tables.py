"""Rate tables of a run: which counts make which published rows.

A table says which counts it takes and what its rows are called.  The tables of
a run become a small routing relation keyed by call; joining the
counts with it sends every count row to the tables that want it, and one
aggregation sums all tables.  The counts are computed once however many tables
there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.config import RunConfig
from cohortwise.functions.semantics import sum_or_zero
from cohortwise.operators.rates import RATE_COLUMNS, complement_first_dose, mixed_rates

TOTAL = "Total"
NATION = "England"
PERSONS = "Persons"
KEYS = ["vaccine_number", "year", "month", "exposure", "group", "SubCategory", "Sex"]
AGG_COLUMNS = [*KEYS, "population", "vaccinated", *RATE_COLUMNS]


@dataclass(frozen=True)
class RateTable:
    """One table.  Labels are column names when they start with ``$``, else texts.

    ``only`` / ``without`` choose exposures; a crude table is split by
    ``age_group`` in one of its labels instead of being standardised.
    """

    name: str
    call: str
    exposure: str = "$exposure"
    group: str = "$group"
    sub_category: str = NATION
    only: str | None = None
    without: str | None = None
    standardise: bool = True
    embed_sex: bool = True


RATE_TABLES = (
    RateTable("total", "region", TOTAL, TOTAL, only="sex"),
    RateTable("exposure", "region", without="imd_quintile_region"),
    RateTable("region", "region", TOTAL, TOTAL, "$area", only="sex"),
    RateTable("exposure_region", "region", sub_category="$area", without="imd_quintile"),
    RateTable("age", "region", TOTAL, TOTAL, "$age_group", only="sex", standardise=False),
    RateTable(
        "exposure_age", "region", sub_category="$age_group", without="imd_quintile_region",
        standardise=False,
    ),
    RateTable(
        "region_age", "region", "age_group", "$age_group", "$area", only="sex", standardise=False
    ),
    RateTable("la", "la", TOTAL, TOTAL, "$area", only="sex"),
    RateTable("la_exposure", "la", sub_category="$area"),
    RateTable("la_age", "la", "age_group", "$age_group", "$area", only="sex", standardise=False),
    RateTable("sex", "sex", embed_sex=False),
)
AGE_SPECIFIC = ("age", "exposure_age", "region_age")


def standard_tables(run: RunConfig, names: Sequence[str] | None = None) -> tuple[RateTable, ...]:
    """The tables of a run; the regional age tables exist for runs from 18 only."""
    run.require_standard_age()
    tables = [t for t in RATE_TABLES if run.age_specific or t.name not in AGE_SPECIFIC]
    return tuple(t for t in tables if names is None or t.name in names)


def _routes(spark: SparkSession, tables: Sequence[RateTable]) -> DataFrame:
    """One row per table: the call and exposures it takes and the names it gives."""
    def route(t: RateTable) -> Column:
        texts = {"to_call": t.call, "only": t.only, "without": t.without, "table": t.name,
                 "to_exposure": t.exposure, "to_group": t.group, "to_sub": t.sub_category}
        return F.struct(
            *[F.lit(v).cast("string").alias(k) for k, v in texts.items()],
            F.lit(t.standardise).alias("standardise"), F.lit(t.embed_sex).alias("embed"),
        )

    return spark.range(1).select(F.inline(F.array(*[route(t) for t in tables])))


def _known_call(tables: Sequence[RateTable]) -> Column:
    """The call of a count, failing at run time for one that no table takes."""
    known = sorted({t.call for t in (*RATE_TABLES, *tables)})
    message = F.concat(F.lit("no rate table takes the counts of call "), F.col("call"))
    return F.when(F.col("call").isin(known), F.col("call")).otherwise(
        F.raise_error(message).cast("string"))


def _label(text: Column) -> Column:
    """The column a ``$name`` stands for, or the text itself."""
    out = F.when(text.startswith("$"), F.lit(None).cast("string")).otherwise(text)
    for name in ("exposure", "group", "area", "age_group"):
        out = F.when(text == f"${name}", F.col(name)).otherwise(out)
    return out


def table_counts(counts: DataFrame, tables: Sequence[RateTable]) -> DataFrame:
    """Counts summed to the rows of the tables (and the age band, if standardised).

    Which exposures a table takes is asked of the counts' own exposures, whatever they are.
    The routes are broadcast: there is one row per table.
    """
    routes = F.broadcast(_routes(counts.sparkSession, tables))
    takes = (
        (F.col("call") == F.col("to_call"))
        & (F.col("only").isNull() | (F.col("only") == F.col("exposure")))
        & (F.col("without").isNull() | (F.col("without") != F.col("exposure")))
    )
    names = {
        "exposure": _label(F.col("to_exposure")),
        "group": _label(F.col("to_group")),
        "SubCategory": _label(F.col("to_sub")),
        "Sex": F.when(~F.col("embed"), F.col("area")),
        "age_group_esp": F.when(F.col("standardise"), F.col("age_group_esp")),
    }
    rows = counts.withColumn("call", _known_call(tables)).join(routes, takes).select(
        "vaccine_number", "year", "month", "table", "standardise", "embed",
        *[column.alias(name) for name, column in names.items()],
        "population", "vaccinated",
    )
    keys = [c for c in rows.columns if c not in ("population", "vaccinated")]
    summed = rows.groupBy(*keys).agg(
        *[sum_or_zero(F.col(c)).alias(c) for c in ("population", "vaccinated")]
    )
    return complement_first_dose(summed)


def embed_sex(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Move rows of the exposure ``sex`` to totals with the sex in its own column.

    ``when`` limits the step to some rows; the others keep their ``Sex``.
    """
    here = F.lit(True) if when is None else when
    is_sex = F.col("exposure") == "sex"
    sex = F.when(is_sex, F.col("group")).otherwise(F.lit(PERSONS))
    known = F.when(F.col("exposure").isNotNull(), F.col("group"))
    previous = F.col("Sex") if "Sex" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "Sex": F.when(here, sex).otherwise(previous),
            "group": F.when(here & is_sex, F.lit(TOTAL))
            .when(here, known)
            .otherwise(F.col("group")),
            "exposure": F.when(here & is_sex, F.lit(TOTAL)).otherwise(F.col("exposure")),
        }
    )


def rate_tables(
    counts: DataFrame,
    weights: DataFrame,
    poisson: DataFrame,
    run: RunConfig,
    tables: Sequence[RateTable] | None = None,
    keep_name: bool = False,
) -> DataFrame:
    """Rates of all tables as one table (``keep_name`` adds the table's name)."""
    tables = standard_tables(run) if tables is None else tables
    summed = table_counts(counts, tables)
    keys = ["table", "embed", *KEYS]
    rates = mixed_rates(summed, weights, poisson, run.min_age, run.max_age, keys)
    done = embed_sex(rates, F.col("embed"))
    return done.select(*(["table"] if keep_name else []), *AGG_COLUMNS)


def union_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
