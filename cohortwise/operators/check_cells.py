"""All check reports of a run from one scan of the persons.

Every report is a sum over persons by some keys.  Here a person becomes one tagged row for each report
that counts them, all reports are summed by the same aggregation, and the reports are read off its cells, of which
there are few.  Missing values are counted by pattern: the columns that are null together are one
key, and a column's number is the sum over the patterns that hold it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions import predicates as p
from cohortwise.functions.bands import REPORT_BANDS, assign_band
from cohortwise.functions.dates import age_at
from cohortwise.functions.semantics import if_else
from cohortwise.operators.checks import Day, nulls_last
from cohortwise.operators.linkage import LINKED, NOT_LINKED

DOSES = ("first", "second")
KEYS = ("k1", "k2", "k3", "k4")
REPORTS = ("dose_trend", "rate_by_age", "missing")
MASK_BITS = 62


@dataclass(frozen=True)
class CheckVariant:
    """The persons that some reports are about, and by when a dose must be given."""

    name: str
    death_date: Day = None
    age_date: Day = None
    vacc_date: Day = None
    min_age: float | None = None
    max_age: float | None = None
    reports: tuple[str, ...] = REPORTS


@dataclass(frozen=True)
class LinkageVariant:
    vacc_date: Day
    death_date: Day
    dose: str = "first"
    min_age: float | None = None
    max_age: float | None = None


def _all(conditions: Sequence[Column | None]) -> Column:
    given = [c for c in conditions if c is not None]
    whole = given[0]
    for c in given[1:]:
        whole = whole & c
    return whole


class _Rows:
    """The rows that a person becomes, kept small for the code that Spark generates.

    What keys and sums are made of is worked out once a person (``columns``); a person is then repeated by the
    numbers of the rows that are for them, and a row's keys are chosen by its number.
    """

    def __init__(self) -> None:
        self.columns: dict[str, Column] = {}
        self.rows: list[tuple[str, list[str], str | None, str | None, Column | None]] = []
        self._known: dict[tuple[int, str], tuple[str, Column]] = {}

    def column(self, value: Column, kind: str) -> str:
        """The name of a column that is carried along; the same object is carried once."""
        name, _ = self._known.setdefault((id(value), kind), (f"c{len(self._known)}", value))
        self.columns[name] = value.cast(kind)
        return name

    def add(self, tag: str, keys: Sequence[Column], inside: Column | None, a: Column | None = None,
            b: Column | None = None) -> None:
        self.rows.append((
            tag, [self.column(k, "string") for k in keys],
            None if a is None else self.column(a, "double"),
            None if b is None else self.column(b, "double"),
            None if inside is None else F.col(self.column(inside, "boolean"))))

    def cells(self, df: DataFrame) -> DataFrame:
        carried = df.select(*[c.alias(n) for n, c in self.columns.items()])
        numbers = [F.lit(i) if row[4] is None else F.when(row[4], F.lit(i))
                   for i, row in enumerate(self.rows)]
        rows = carried.withColumn("at", F.explode(F.array(*numbers))).where("at IS NOT NULL")

        def chosen(names: Sequence[str | None], nothing: Column) -> Column:
            """The column named for the row's number; rows that share a column share a branch."""
            by_name: dict[str, list[int]] = {}
            for i, name in enumerate(names):
                if name is not None:
                    by_name.setdefault(name, []).append(i)
            out = nothing
            for name, at in by_name.items():
                out = F.when(F.col("at").isin(*at), F.col(name)).otherwise(out)
            return out

        keys = [chosen([row[1][i] if i < len(row[1]) else None for row in self.rows],
                       F.lit(None).cast("string")).alias(k) for i, k in enumerate(KEYS)]
        sums = [chosen([row[i] for row in self.rows], F.lit(0.0)).alias(n) for i, n in ((2, "a"), (3, "b"))]
        summed = rows.select("at", *keys, *sums).groupBy("at", *KEYS).agg(
            F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        tags = F.array(*[F.lit(row[0]) for row in self.rows])
        return summed.select(F.element_at(tags, F.col("at") + 1).alias("report"), *KEYS, "n", "a", "b")


def _add_variant(rows: _Rows, df: DataFrame, v: CheckVariant) -> None:
    age = age_at(p.day(v.age_date), F.col("dob"))
    alive = None if v.death_date is None else p.alive_on(F.col("dod"), p.day(v.death_date))
    inside = _all([p.linked_in_country(), alive, p.age_window(age, v.min_age, v.max_age)])
    if "dose_trend" in v.reports:
        for d in DOSES:
            rows.add(f"dose_trend_{v.name}", [F.lit(d), F.col(f"{d}_vacc_date")], inside)
    if "rate_by_age" in v.reports:
        given = [p.given_by(F.col(f"{d}_vacc_date"), v.vacc_date) for d in DOSES]
        rows.add(f"rate_by_age_{v.name}", [assign_band(age, REPORT_BANDS)], inside, *given)
    if "missing" in v.reports:
        rows.add(f"missing_{v.name}", [*_null_masks(df), age.isNull().cast("int")], inside)


def _null_masks(df: DataFrame) -> list[Column]:
    """Which columns are null, ``country`` included, as the bits of whole numbers."""
    nulls = [F.col(c).isNull() for c in df.columns] + [p.country_of(F.col("rgn_derived")).isNull()]
    if len(nulls) > MASK_BITS * (len(KEYS) - 1):
        raise ValueError(f"more than {MASK_BITS * (len(KEYS) - 1)} columns")
    masks = []
    for lo in range(0, len(nulls), MASK_BITS):
        bits = [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i, x in enumerate(nulls[lo : lo + MASK_BITS])]
        masks.append(sum(bits[1:], bits[0]))
    return masks


def _add_linkage(rows: _Rows, v: LinkageVariant) -> None:
    age = F.col("age_when_eligible_years")
    inside = _all([
        p.alive_on(F.col("dod"), p.day(v.death_date)),
        p.given_by(F.col(f"{v.dose}_vacc_date"), v.vacc_date) == 1,
        p.age_window(age, v.min_age, v.max_age)])
    status = if_else(p.linked_in_country(), F.lit(LINKED), F.lit(NOT_LINKED))
    keys = [status, assign_band(age, REPORT_BANDS), F.coalesce("gender_vacc", F.lit("Unknown"))]
    rows.add("linkage", keys, inside, F.coalesce(age, F.lit(0.0)), age.isNotNull().cast("int"))


def check_cells(
    df: DataFrame, variants: Sequence[CheckVariant], linkage: LinkageVariant | None = None
) -> DataFrame:
    """The cells of all reports: report, k1..k4 (texts), n, a, b.  Write them, then read reports off."""
    rows = _Rows()
    rows.add("deaths", [F.col(c) for c in ("dor", "dodyr", "dodmt", "dod")], None)
    for v in variants:
        _add_variant(rows, df, v)
    if linkage is not None:
        _add_linkage(rows, linkage)
    return rows.cells(df)


def _of(cells: DataFrame, report: str) -> DataFrame:
    return cells.where(F.col("report") == report)


def death_cells_of(cells: DataFrame) -> DataFrame:
    """As ``checks.death_cells`` gives them."""
    return _of(cells, "deaths").select(
        F.col("k1").alias("dor"), F.col("k2").alias("dodyr"), F.col("k3").alias("dodmt"),
        F.col("k4").cast("date").alias("dod"), "n")


def linkage_cells_of(cells: DataFrame) -> DataFrame:
    """As ``linkage.linkage_cells`` gives them."""
    return _of(cells, "linkage").select(
        F.col("k1").alias("linked"), F.col("k2").alias("age_group"), F.col("k3").alias("sex"), "n",
        F.col("a").alias("age_sum"), F.col("b").cast("long").alias("age_n"))


def dose_trend_of(cells: DataFrame, variant: str) -> DataFrame:
    """As ``checks.dose_trend`` gives it."""
    upto = Window.partitionBy("dose").orderBy(F.col("vacc_date").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    place = F.array_position(F.array(*[F.lit(d) for d in DOSES]), F.col("dose"))
    daily = _of(cells, f"dose_trend_{variant}").select(
        F.col("k1").alias("dose"), F.col("k2").cast("date").alias("vacc_date"), "n")
    return daily.withColumn("n_cum", F.sum("n").over(upto)).orderBy(place, *nulls_last("vacc_date"))


def rate_by_age_of(cells: DataFrame, variant: str) -> DataFrame:
    """As ``checks.rate_by_age`` gives it."""
    first, second = (f"{d}_rate" for d in DOSES)
    return _of(cells, f"rate_by_age_{variant}").select(
        F.col("k1").alias("age_group"), "n", (F.col("a") / F.col("n")).alias(first),
        (F.col("b") / F.col("n")).alias(second)).orderBy(*nulls_last("age_group"))


def missing_of(cells: DataFrame, variant: str, columns: Sequence[str]) -> DataFrame:
    """As ``checks.missing_profile`` gives it; ``columns`` are those of the persons."""
    names = [*columns, "country", "age"]
    n_masks = -(-(len(names) - 1) // MASK_BITS)
    bits = [(KEYS[i // MASK_BITS], i % MASK_BITS) for i in range(len(names) - 1)] + [(KEYS[n_masks], 0)]
    sums = _of(cells, f"missing_{variant}").agg(*[
        F.coalesce(F.sum(F.shiftright(F.col(key).cast("long"), bit).bitwiseAND(F.lit(1)) * F.col("n")),
                   F.lit(0)).alias(c) for c, (key, bit) in zip(names, bits, strict=True)])
    return sums.unpivot([], names, "variable", "missing").orderBy("missing", "variable")
