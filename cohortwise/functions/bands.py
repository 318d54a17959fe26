"""Age bands described by their lower bounds."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise import fixed_values as fv


@dataclass(frozen=True)
class BandScheme:
    """Half-open bands: below the first cut, between cuts, from the last cut on."""

    cuts: tuple[int, ...]

    @property
    def labels(self) -> tuple[str, ...]:
        inner = [f"{lo}-{hi - 1}" for lo, hi in zip(self.cuts, self.cuts[1:])]
        return (f"<{self.cuts[0]}", *inner, f"{self.cuts[-1]}+")

    def label_of(self, age: float) -> str:
        return self.labels[bisect_right(self.cuts, age)]


REPORT_BANDS = BandScheme(fv.AGE_CUTS_REPORT)
GROUP_BANDS = BandScheme(fv.AGE_CUTS_GROUP)
STANDARD_BANDS = BandScheme(fv.AGE_CUTS_STANDARD)


def assign_band(age: Column, scheme: BandScheme) -> Column:
    """Label of the band an age falls in; a null age has a null band."""
    out = F.when(age < scheme.cuts[0], F.lit(scheme.labels[0]))
    for upper, label in zip(scheme.cuts[1:], scheme.labels[1:]):
        out = out.when(age < upper, F.lit(label))
    return out.when(age >= scheme.cuts[-1], F.lit(scheme.labels[-1]))


def band_limits(label: Column) -> tuple[Column, Column]:
    """Lower and exclusive upper age written in a band label.

    ``25-29`` is (25, 30) and ``<1`` is (0, 1).  An open band ``90+`` gets a
    width of one year, the convention the age filter of the rates relies on.
    """
    parts = F.split(F.translate(label, "<+", ""), "-")
    first = F.element_at(parts, 1).try_cast("int")
    last = F.element_at(parts, -1).try_cast("int")
    infant = label == "<1"
    return F.when(infant, F.lit(0)).otherwise(first), F.when(infant, last).otherwise(last + 1)
