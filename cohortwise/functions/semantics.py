"""Null-aware building blocks shared by all operators.

Spark expressions follow three-valued logic.  The statistics (rates, limits,
suppression, labels) need a second dialect in which a null is an ordinary value
of ``not in``, an empty sum is zero and a 0/0 is missing.  The helpers name the
dialect they implement.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice in which a null condition gives null."""
    return F.when(condition, yes).when(~condition, no)


def not_in_keep_null(col: Column, values: Iterable[str]) -> Column:
    """``not in`` that is true for null."""
    return F.coalesce(~col.isin(*values), F.lit(True))


def is_true(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def sum_or_zero(col: Column) -> Column:
    """Sum over non-null values; zero when there are none."""
    return F.coalesce(F.sum(col), F.lit(0))


def clamp_low(col: Column, bound: float = 0.0) -> Column:
    """Raise to the bound; null stays null (``greatest`` would return the bound)."""
    return F.when(col < bound, F.lit(bound)).otherwise(col)


def clamp_high(col: Column, bound: float = 100.0) -> Column:
    return F.when(col > bound, F.lit(bound)).otherwise(col)


def round_to_base(col: Column, base: int = 5) -> Column:
    """Nearest multiple of ``base`` (disclosure rounding of counts)."""
    return (F.round(col / F.lit(float(base))) * base).cast("long")


def round_half_away(col: Column, digits: int = 0) -> Column:
    """Half away from zero, computed on the binary value as it is stored."""
    scale = F.lit(float(10**digits))
    return F.floor(F.abs(col) * scale + 0.5) / scale * F.signum(col)


def label_codes(code: Column, labels: Mapping[str, Iterable]) -> Column:
    """Label of the code set that contains ``code``; null when there is none.

    A literal map keeps the generated code of a projection with many recodes
    small enough for the JVM to compile.
    """
    pairs = [(c, label) for label, codes in labels.items() for c in codes]
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), code)


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup_label(col: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Label from a small literal map; null key or no entry gives ``default``."""
    found = F.when(col.isNotNull(), F.try_element_at(literal_map(mapping), col))
    return found if default is None else F.coalesce(found, default)


def text_slice(col: Column, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, counted from one, both included."""
    return F.substring(col, start, stop - start + 1)


def capitalise(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), col.substr(F.lit(2), F.length(col)))
