"""Joins to lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(df: DataFrame, lookup: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join that keeps every left row; a null key matches nothing.

    No size is counted beforehand and nothing is hinted: Spark broadcasts a lookup whose size,
    from statistics or as it has been computed, is within ``autoBroadcastJoinThreshold``, and
    otherwise shuffles both sides and splits the partitions of hot keys.
    """
    return df.join(lookup, on, "left")


def assert_unique_lookup(lookup: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The lookup itself, failing at run time if a key has more than one row.

    Rows are combined per key before the shuffle, so a key with very many rows
    fails without being gathered.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in lookup.columns if c not in keys]
    message = F.lit(f"lookup has several rows for one value of {', '.join(keys)}")
    unique = F.when(F.col("_rows") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return (
        lookup.groupBy(*keys)
        .agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in others])
        .filter(unique)
        .select(*lookup.columns)
    )
