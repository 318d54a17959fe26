"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import written


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none, or no smaller one at all."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")),
    )).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.where("below > 1 or below = 1 and above = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node's larger
    neighbours are hung on its smallest neighbour, then all smaller ones are, until only stars are left.
    Each step is a minimum per node (combined before the shuffle) and a join back, so no
    neighbourhood is ever gathered in one place, and each round is a table in shared storage.
    Loops and repeated edges are fine; rows with a null end are ignored.
    """
    def larger_first(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(
            "u != v").distinct()

    now = written(larger_first(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        now = written(larger_first(
            hung.select(F.explode(F.array(
                F.struct(F.col("u").alias("x"), F.col("m").alias("y")),
                F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select("e.x", "e.y"), "x", "y"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
