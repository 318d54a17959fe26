"""Guards that count what is wrong in the pass that meets it, by observed metrics.

``DataFrame.observe`` adds counters to the plan where the rows go by, so no job of its own, no extra grouping of a
lookup and no second scan is needed.  The numbers are there once an action has gone through the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Guard:
    """Counters of a plan: ``watch`` adds them, ``metrics`` reads them after an action."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, place: str, **counts: Column) -> DataFrame:
        """Count rows, and rows for which each condition holds (null is no), as they pass here."""
        observation = Observation()
        self._seen.append((place, observation))
        return df.observe(
            observation, F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()])

    def metrics(self) -> dict[str, int]:
        """All counters as place.name; waits for the action that goes through the plan."""
        return {f"{place}.{name}": int(value) for place, seen in self._seen
                for name, value in seen.get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = sorted(self.metrics().items())
        return spark.createDataFrame(rows, "metric string, value long")

    def require_none(self, names: Sequence[str]) -> None:
        """Raise if a counter of one of these names isn't zero."""
        wrong = {k: v for k, v in self.metrics().items() if v and k.rpartition(".")[2] in names}
        if wrong:
            raise ValueError("; ".join(f"{k} = {v}" for k, v in sorted(wrong.items())))


def watched_lookup_join(
    guard: Guard,
    df: DataFrame,
    lookup: DataFrame,
    on: str,
    value: str,
    place: str,
    needed: Column | None = None,
    conditions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Left join to a lookup that counts what a checked lookup would be grouped for.

    ``place``_in.rows and ``place``_out.rows differ by as many rows as keys with several rows have added;
    ``missing`` counts the rows (where ``needed`` holds) that found no ``value``; ``conditions`` are counted before
    the join.
    """
    before = guard.watch(df, f"{place}_in", **(conditions or {}))
    joined = before.join(lookup, on, "left")
    missing = F.col(value).isNull() if needed is None else needed & F.col(value).isNull()
    return guard.watch(joined, f"{place}_out", missing=missing)


def fan_out(metrics: Mapping[str, int], place: str) -> int:
    """Rows that several lookup rows of one key have added."""
    return metrics[f"{place}_out.rows"] - metrics[f"{place}_in.rows"]
