"""Monthly population and uptake by characteristic, in one pass over persons.

A person adds to a cell (exposure, its value, area, age band) for a run of
consecutive months.  Instead of one row per person and month, each person emits
a row where a run begins, where it ends and where a dose is given: the changes
of the cell.  Changes are summed per cell and month, and a running total over
the months of a cell gives the counts.  A person emits a handful of rows
however long the calendar is, the sums are combined before the shuffle, and the
running total only sees the aggregated cells.

All exposures of all calls are counted by the same aggregation, so the person
table is read once.  Where the values of all columns are known beforehand, cells
are numbered by them: the aggregation then has one whole number as its key in
place of texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv
from cohortwise.config import CountSpec, RunConfig, month_number
from cohortwise.functions.bands import GROUP_BANDS, STANDARD_BANDS, BandScheme
from cohortwise.functions.dates import DAYS_PER_YEAR, days_to_age, month_of, month_start, year_month

BANDS: dict[str, BandScheme] = {"age_group": GROUP_BANDS, "age_group_esp": STANDARD_BANDS}


def _literal_array(values: Sequence[int | str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


class _Segments:
    """Stretches of age between consecutive cuts of the bands and minimum ages."""

    def __init__(self, bands: Mapping[str, BandScheme], min_age: int, min_ages: Sequence[int]):
        cuts = set(chain.from_iterable(b.cuts for b in bands.values())) | set(min_ages)
        self.bands = bands
        # The first stretch starts at the minimum age of the run.
        self.lower = [min_age, *sorted(c for c in cuts if c > min_age)]
        self.labels = [tuple(b.label_of(a) for b in bands.values()) for a in self.lower]
        cells = list(dict.fromkeys(self.labels))
        self.cells = cells
        self.cell_of = [cells.index(label) for label in self.labels]

    def index_at(self, age_days: Column) -> Column:
        """Stretch that holds an age given in days (at least the minimum age)."""
        oldest = self.lower[-1]
        by_year = [bisect_right(self.lower, year) - 1 for year in range(oldest + 1)]
        years = F.floor(age_days / F.lit(DAYS_PER_YEAR)).cast("int")
        return F.element_at(_literal_array(by_year), F.least(years, F.lit(oldest)) + 1)

    def first_month(self, index: Column, born: Column) -> Column:
        """Month at whose end the stretch has been reached."""
        days = _literal_array([days_to_age(a) for a in self.lower])
        return month_of(F.date_add(born, F.element_at(days, index + 1)))

    def label(self, cell: Column, name: str) -> Column:
        position = list(self.bands).index(name)
        return F.element_at(_literal_array([c[position] for c in self.cells]), cell + 1)


def _spans(df: DataFrame, run: RunConfig, segments: _Segments, keep: Sequence[str]) -> DataFrame:
    """One row per person and stretch of age: months ``lo`` to ``hi`` in the population."""
    first, last = run.month_range
    born, died = F.col("dob"), F.col("dod")
    persons = (
        df.filter(born.isNotNull())
        .select(
            *keep,
            "dob",
            *[month_of(F.col(f"{d}_vacc_date")).alias(f"m_{d}") for d in fv.DOSES],
            F.greatest(F.lit(first), segments.first_month(F.lit(0), born)).alias("lo"),
            # Alive strictly after the end of the month: up to the month before death.
            F.least(F.lit(last), month_of(died) - 1).alias("hi"),
        )
        .filter(F.col("lo") <= F.col("hi"))
    )

    def stretch_in(month: Column) -> Column:
        return segments.index_at(F.datediff(F.last_day(month_start(month)), born))

    stretches = F.sequence(stretch_in(F.col("lo")), stretch_in(F.col("hi")))
    following = F.when(
        F.col("segment") + 1 < len(segments.lower),
        segments.first_month(
            F.least(F.col("segment") + 1, F.lit(len(segments.lower) - 1)), born
        ) - 1,
    )
    return (
        persons.withColumn("segment", F.explode(stretches))
        .withColumns(
            {
                "lo": F.greatest("lo", segments.first_month(F.col("segment"), born)),
                "hi": F.least(F.col("hi"), following),
            }
        )
        .drop("dob")
    )


def _changes(spans: DataFrame, run: RunConfig, keep: Sequence[str]) -> DataFrame:
    """Rows (month, change of population, change of each dose count)."""
    lo, hi = F.col("lo"), F.col("hi")
    given = {d: F.col(f"m_{d}") for d in fv.DOSES}
    zero, one = F.lit(0), F.lit(1)

    def flag(condition: Column) -> Column:
        return F.when(condition, one).otherwise(zero)

    begin = F.struct(
        lo.alias("month"),
        one.alias("population"),
        *[flag(given[d] <= lo).alias(d) for d in fv.DOSES],
    )
    end = F.when(
        hi < run.month_range[1],
        F.struct(
            (hi + 1).alias("month"),
            (-one).alias("population"),
            *[(-flag(given[d] <= hi)).alias(d) for d in fv.DOSES],
        ),
    )
    dose = [
        F.when(
            (given[d] > lo) & (given[d] <= hi),
            F.struct(
                given[d].alias("month"),
                zero.alias("population"),
                *[(one if d == other else zero).alias(other) for other in fv.DOSES],
            ),
        )
        for d in fv.DOSES
    ]
    return (
        spans.withColumn("change", F.explode(F.array(begin, end, *dose)))
        .filter(F.col("change").isNotNull())
        .select(*keep, "segment", "change.*")
    )


def _per_exposure(df: DataFrame, pairs: Sequence[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """Repeat each row for every (cell number, exposure, areas) with its values.

    ``cell`` holds the number as text: it is part of the aggregation key, and
    short keys keep the hash map and the shuffle small.
    """
    width = max(len(areas) for _, _, areas in pairs)
    names = ["group", *[f"area_{i}" for i in range(width)]]
    # UNPIVOT takes columns only, so short area lists are padded with a null one.
    uneven = any(len(areas) < width for _, _, areas in pairs)
    padded = df.withColumn("no_area", F.lit(None).cast("string")) if uneven else df
    values = ", ".join(
        "({}) AS `{}`".format(
            ", ".join(f"`{c}`" for c in (e, *areas, *["no_area"] * (width - len(areas)))), key
        )
        for key, e, areas in pairs
    )
    return df.sparkSession.sql(
        "SELECT * FROM {{persons}} UNPIVOT INCLUDE NULLS (({}) FOR cell IN ({}))".format(
            ", ".join(f"`{n}`" for n in names), values
        ),
        persons=padded,
    )


Specs = Sequence[tuple[str, Sequence[str], Sequence[str]]]
Values = Mapping[str, Sequence[str]]
SUMS = ["population", *fv.DOSES]
WORD = 62  # bits of a whole number that are used
NOT_COUNTED = -(1 << WORD)  # makes a key negative


def _bits(column: str | Column, shift: int, width: int) -> Column:
    """The ``width`` bits of a whole number from ``shift`` on."""
    word = F.col(column) if isinstance(column, str) else column
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _joined(parts: Sequence[tuple[Column, int]]) -> Column:
    """One whole number of (number, shift) pairs."""
    return reduce(lambda a, b: a + b, [F.shiftleft(n.cast("long"), shift) for n, shift in parts])


class _Codes:
    """Whole numbers for the values of columns (0 for null) and for the cells made of them.

    A person's codes lie in one or two words.  A key has the bits of pair, group, areas, band and month.
    """

    def __init__(self, values: Values, columns: Sequence[str], calls: Sequence[tuple[str, str, tuple[str, ...]]],
                 areas: int, bands: int, run: RunConfig) -> None:
        self.values = {c: list(dict.fromkeys(values[c])) for c in columns}
        self.calls, self.first = calls, run.month_range[0]
        widths = {c: len(v).bit_length() for c, v in self.values.items()}
        self.place: dict[str, tuple[str, int, int]] = {}
        word = used = 0
        for name, width in widths.items():
            if used + width > WORD:
                word, used = word + 1, 0
            self.place[name] = (f"word_{word}", used, width)
            used += width
        self.words = [f"word_{i}" for i in range(word + 1)]
        # From the lowest bit of a key: month, band, areas, group, pair.
        self.month = (run.month_range[1] - self.first).bit_length()
        self.time = self.month + bands.bit_length()
        self.wide = max(widths.values())
        self.group = self.time + areas * self.wide
        self.pair = self.group + self.wide
        self.fits = self.pair + len(calls).bit_length() <= WORD

    def _code(self, name: str) -> Column:
        text = F.col(name).cast("string")
        message = F.concat(F.lit(f"not among the values given for {name}: "), text)
        missing = F.when(text.isNotNull(), F.raise_error(message).cast("int"))
        known = self.values[name]
        codes = F.create_map(*[F.lit(x) for i, v in enumerate(known, 1) for x in (v, i)]) if known else None
        found = [] if codes is None else [F.try_element_at(codes, text)]
        return F.coalesce(*found, missing, F.lit(0))

    def encode(self) -> dict[str, Column]:
        """The words of a person; a text that is not among the values of its column is an error."""
        return {
            word: _joined([(self._code(c), shift) for c, (w, shift, _) in self.place.items() if w == word])
            for word in self.words
        }

    def code(self, name: str) -> Column:
        return _bits(*self.place[name])

    def decode(self, areas: int) -> dict[str, Column]:
        """The columns that the column ``key`` stands for."""
        pair = F.shiftright("key", self.pair).cast("int")

        def text(columns: Sequence[str | None], shift: int) -> Column:
            lists = [F.array(F.lit(None).cast("string"), *[F.lit(v) for v in self.values.get(c, [])])
                     for c in columns]
            code = _bits("key", shift, self.wide).cast("int")
            return F.element_at(F.element_at(F.array(*lists), pair + 1), code + 1)

        out = {
            "cell": pair.cast("string"),
            "group": text([e for _, e, _ in self.calls], self.group),
            "band": _bits("key", self.month, self.time - self.month).cast("int"),
            "month": (_bits("key", 0, self.month) + self.first).cast("int"),
        }
        for i in range(areas):
            columns = [names[i] if i < len(names) else None for *_, names in self.calls]
            out[f"area_{i}"] = text(columns, self.time + i * self.wide)
        return out


class _Plan:
    """The cells that a set of calls asks for, numbered."""

    def __init__(self, run: RunConfig, specs: Specs, bands: Mapping[str, BandScheme],
                 exposure_min_age: Mapping[str, int], values: Values | None = None) -> None:
        self.run, self.bands, self.values = run, bands, values or {}
        self.late = {e: a for e, a in exposure_min_age.items() if a > run.min_age}
        self.segments = _Segments(bands, run.min_age, list(self.late.values()))
        self.calls = [(call, e, tuple(areas)) for call, exposures, areas in specs for e in exposures]
        self.areas = [f"area_{i}" for i in range(max(len(areas) for *_, areas in self.calls))]
        self.keys = ["cell", "group", *self.areas, "band"]

    def changes(self, df: DataFrame, month: Column | None = None) -> DataFrame:
        """Summed changes per cell and month (of the months that ``month`` holds for)."""
        pairs = [(str(number), e, areas) for number, (_, e, areas) in enumerate(self.calls)]
        used = list(dict.fromkeys(c for _, e, areas in pairs for c in (e, *areas)))
        if all(c in self.values for c in used):
            codes = _Codes(
                self.values, used, self.calls, len(self.areas), len(self.segments.cells), self.run)
            if codes.fits:
                return self._coded_changes(df, codes, month)
        text = df.withColumns({c: F.col(c).cast("string") for c in used})
        changes = _changes(_spans(text, self.run, self.segments, used), self.run, used)
        if month is not None:
            changes = changes.filter(month)
        rows = _per_exposure(changes, pairs)
        for exposure, age in self.late.items():
            keys = [key for key, e, _ in pairs if e == exposure]
            if keys:
                young = F.col("segment") < self.segments.lower.index(age)
                rows = rows.filter(~(F.col("cell").isin(*keys) & young))
        band = F.element_at(_literal_array(self.segments.cell_of), F.col("segment") + 1)
        return rows.withColumn("band", band).groupBy(*self.keys, "month").agg(
            *[F.sum(c).alias(c) for c in SUMS])

    def _coded_changes(self, df: DataFrame, codes: _Codes, month: Column | None) -> DataFrame:
        """The same rows, by way of whole numbers.

        Changes are sorted by age and month within their task, in 24 to 32 bytes each.  The cells that
        are added to at a time are then few, and stay in the processor's cache.
        """
        changes = _changes(_spans(df.withColumns(codes.encode()), self.run, self.segments, codes.words),
                           self.run, codes.words)
        if month is not None:
            changes = changes.filter(month)
        # Segment, month and the changes of the sums (-1, 0 or 1: two bits each) in one number.
        low = 2 * len(SUMS)
        place = _joined([
            (F.col("segment"), low + codes.month), (F.col("month") - codes.first, low),
            *[(F.col(c) + 1, 2 * i) for i, c in enumerate(SUMS)],
        ])
        rows = changes.select(*codes.words, place.alias("place")).sortWithinPartitions("place")
        segment = F.shiftright("place", low + codes.month).cast("int")
        band = F.element_at(_literal_array(self.segments.cell_of), segment + 1)
        exposures = list(dict.fromkeys(e for _, e, _ in self.calls))
        sets = list(dict.fromkeys(names for *_, names in self.calls))
        groups = {e: F.shiftleft(codes.code(e), codes.group) for e in exposures}
        for e, age in self.late.items():
            if e in groups:
                young = segment < self.segments.lower.index(age)
                groups[e] = F.when(young, F.lit(NOT_COUNTED)).otherwise(groups[e])
        time = F.coalesce(band, F.lit(0)).cast("long")
        time = F.shiftleft(time, codes.month) + _bits("place", low, codes.month)
        split = rows.select(
            *[g.alias(f"group_{i}") for i, g in enumerate(groups.values())],
            *[reduce(lambda a, b: a + b, [
                F.shiftleft(codes.code(c), codes.time + i * codes.wide) for i, c in enumerate(names)
            ], time).alias(f"areas_{i}") for i, names in enumerate(sets)],
            *[(_bits("place", 2 * i, 2) - 1).alias(c) for i, c in enumerate(SUMS)],
        )
        keys = {
            f"key_{number}": F.col(f"group_{exposures.index(e)}") + F.col(f"areas_{sets.index(names)}")
            + F.lit(number << codes.pair)
            for number, (_, e, names) in enumerate(self.calls)
        }
        cells = split.select(*[k.alias(name) for name, k in keys.items()], *SUMS).unpivot(
            SUMS, list(keys), "pair", "key").filter("key >= 0")
        # A struct as key: there are far more cells than the small first-level map holds.
        summed = cells.groupBy(F.struct("key").alias("_")).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.select("_.key", *SUMS).select(
            *[column.alias(name) for name, column in codes.decode(len(self.areas)).items()], *SUMS
        ).select(*self.keys, "month", *SUMS)

    def named(self, months: DataFrame) -> DataFrame:
        """Cells (with their ``month``) by name: call, exposure, bands, year and month."""
        year, month = year_month(F.col("month"))
        number = F.col("cell").cast("int") + 1
        return months.select(
            F.element_at(_literal_array([call for call, _, _ in self.calls]), number).alias("call"),
            F.element_at(_literal_array([e for _, e, _ in self.calls]), number).alias("exposure"),
            "group",
            *self.areas,
            *[self.segments.label(F.col("band"), name).alias(name) for name in self.bands],
            year.alias("year"),
            month.alias("month"),
            *SUMS,
        )


def count_cells(
    df: DataFrame,
    run: RunConfig,
    specs: Specs,
    bands: Mapping[str, BandScheme],
    exposure_min_age: Mapping[str, int] = fv.EXPOSURE_MIN_AGE,
    values: Values | None = None,
) -> DataFrame:
    """Population and uptake per (call, exposure, group, areas, band, month).

    ``specs`` are (call, exposures, area columns).  Columns of the result:
    ``call, exposure, group, area_0.., <bands>, year, month, population,`` one
    column per dose.  Only cells with a population are present.  ``values`` may list the texts
    that columns can have (null apart): if it does for every column of the specs, cells are counted by number.
    A person with another text is then an error.
    """
    plan = _Plan(run, specs, bands, exposure_min_age, values)
    in_cell = Window.partitionBy(*plan.keys).orderBy("month")
    running = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = plan.changes(df).select(
        *plan.keys,
        "month",
        (F.lead("month", 1, run.month_range[1] + 1).over(in_cell) - 1).alias("until"),
        *[F.sum(c).over(running).alias(c) for c in SUMS],
    ).filter(F.col("population") > 0)
    return plan.named(totals.withColumn("month", F.explode(F.sequence("month", "until"))))


def month_state(
    df: DataFrame, run: RunConfig, specs: Specs, bands: Mapping[str, BandScheme],
    exposure_min_age: Mapping[str, int] = fv.EXPOSURE_MIN_AGE,
) -> DataFrame:
    """Population and uptake of each cell at the end of the run's month: what the next month adds to.

    One row a cell that any month had persons in, so its size is that of one month's counts, not of the calendar.
    """
    plan = _Plan(run, specs, bands, exposure_min_age)
    return plan.changes(df).groupBy(*plan.keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def next_state(
    state: DataFrame, df: DataFrame, run: RunConfig, specs: Specs, bands: Mapping[str, BandScheme],
    exposure_min_age: Mapping[str, int] = fv.EXPOSURE_MIN_AGE,
) -> DataFrame:
    """The state at the end of ``run``'s month from that of the month before and the month's own changes.

    ``state`` was made with the same specs for the month before.  Of the persons only those that enter, leave,
    grow into another band or are given a dose in the month reach the aggregation; there is no running
    total over the calendar.  It takes the past as settled: a dose or death that is reported later for
    a month already counted needs ``month_state`` of the whole table.
    """
    plan = _Plan(run, specs, bands, exposure_min_age)
    delta = plan.changes(df, F.col("month") == run.month_range[1]).drop("month")
    return state.unionByName(delta).groupBy(*plan.keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def state_counts(
    state: DataFrame, run: RunConfig, specs: Specs, bands: Mapping[str, BandScheme],
    exposure_min_age: Mapping[str, int] = fv.EXPOSURE_MIN_AGE,
) -> DataFrame:
    """The rows that ``count_cells`` has for the run's month, from its state."""
    plan = _Plan(run, specs, bands, exposure_min_age)
    return plan.named(state.filter("population > 0").withColumn("month", F.lit(run.month_range[1])))


def by_dose(cells: DataFrame) -> DataFrame:
    """One row per dose: ``vaccine_number`` and ``vaccinated`` for each cell."""
    pairs = ", ".join(f"'{d}', {d}" for d in fv.DOSES)
    keep = [c for c in cells.columns if c not in fv.DOSES]
    return cells.select(
        *keep, F.expr(f"stack({len(fv.DOSES)}, {pairs})").alias("vaccine_number", "vaccinated")
    )


def period_exclusions(
    df: DataFrame,
    second_from: tuple[int, int] = fv.SECOND_DOSE_FIRST_PERIOD,
    third_from: tuple[int, int] = fv.THIRD_DOSE_FIRST_PERIOD,
) -> DataFrame:
    """Drop the months before a dose was offered (second and third dose)."""
    month = F.col("year") * 12 + F.col("month") - 1
    first_month = (
        F.when(F.col("vaccine_number") == "second", month_number(*second_from))
        .when(F.col("vaccine_number") == "third", month_number(*third_from))
        .otherwise(0)
    )
    return df.filter(month >= first_month)


def from_period(df: DataFrame, first: tuple[int, int] | None) -> DataFrame:
    """Keep the months from ``first`` on."""
    if first is None:
        return df
    return df.filter(F.col("year") * 12 + F.col("month") - 1 >= month_number(*first))


def monthly_counts(
    df: DataFrame, run: RunConfig, exposures: Sequence[str], group_vars: Sequence[str]
) -> DataFrame:
    """Population and vaccinated by dose, month, ``group_vars`` and each exposure.

    ``group_vars`` may name age bands (``age_group``, ``age_group_esp``) and any
    columns of the person table.
    """
    bands = {g: BANDS[g] for g in group_vars if g in BANDS}
    others = [g for g in group_vars if g not in BANDS]
    cells = count_cells(df, run, [("all", exposures, others)], bands)
    renamed = cells.withColumnsRenamed({f"area_{i}": name for i, name in enumerate(others)})
    return by_dose(renamed).select(
        "vaccine_number", "year", "month", "exposure", *group_vars, "group",
        "population", "vaccinated",
    )


def monthly_counts_all(
    df: DataFrame, run: RunConfig, specs: Sequence[CountSpec], values: Values | None = None
) -> DataFrame:
    """All calls in one plan, with ``call`` and ``area`` columns and exclusions applied.

    ``values`` are the texts that columns can have, as for ``count_cells``.
    """
    calls = [(s.name, s.exposures, (s.area,)) for s in specs]
    cells = count_cells(df, run, calls, BANDS, values=values)
    starts = [(s.name, month_number(*s.first_period)) for s in specs if s.first_period]
    month = F.col("year") * 12 + F.col("month") - 1
    for name, first in starts:
        cells = cells.filter((F.col("call") != name) | (month >= first))
    counts = by_dose(cells.withColumnRenamed("area_0", "area"))
    return period_exclusions(counts).select(
        "call", "vaccine_number", "year", "month", "exposure", *BANDS, "area", "group",
        "population", "vaccinated",
    )
