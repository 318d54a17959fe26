"""Mixing sources to target weights: budgets down a tree, token prefixes from seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm.common import unpacked, whole_row, written

EPOCHS = 4
_PART_DIGITS = 3  # 16^3 parts of a leaf's order


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    words = F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))])
    return F.greatest(F.coalesce(F.element_at(table, F.col(level).cast("string")), F.lit(1.0)),
                      F.lit(0.0))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[f"__of_{c}"])
    return condition


def _join_same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join in which nulls are equal; the right side's key columns go."""
    right = right.withColumnsRenamed({c: f"__of_{c}" for c in columns})
    return left.join(right, _same(left, right, columns)).drop(*[f"__of_{c}" for c in columns])


def leaf_budgets(supply: DataFrame, levels: Sequence[str],
                 weights: Mapping[str, Mapping[str, float]], total_share: float,
                 epochs: int = EPOCHS) -> DataFrame:
    """Tokens to take from each leaf: the levels, supply and budget (whole tokens).

    ``supply`` has one row per leaf: the level columns and ``supply``.  In all, ``total_share`` times
    the supply is to be taken; a leaf can give ``epochs`` times its supply, an inner node what its
    children can.  Top down, a node's budget goes to its children in proportion to their weights; a
    child that cannot take its share gives up the rest, which its siblings share by weight, until
    all is placed.  A node never gets more than its subtree can give, so a shortage is made good
    among siblings first, and only what a whole subtree lacks goes to its ancestors' siblings.
    Weights are by level and name, 1 where none is given; 0 or less takes nothing.

    All children of one node meet in one window, which reads one row per child, not per document.
    """
    nodes = supply
    capacity = F.col("supply") * F.lit(float(epochs))
    for i, level in enumerate(levels):
        nodes = nodes.withColumn(f"__w{i}", _weight(level, weights.get(level, {})))
        capacity = F.when(F.col(f"__w{i}") > 0, capacity).otherwise(F.lit(0.0))
    nodes = nodes.withColumn("__capacity", capacity)
    whole = nodes.agg(F.least(F.floor(F.sum("supply") * F.lit(float(total_share))),
                              F.sum("__capacity")).cast("double").alias("__budget"))
    above = whole
    for i, level in enumerate(levels):
        path = list(levels[: i + 1])
        children = nodes.groupBy(*path).agg(
            F.sum("__capacity").alias("__capacity"), F.first(f"__w{i}").alias("__w"))
        # The level above has one row per node; at the top that is a single row.
        placed = (_join_same(children, above, path[:-1]) if i
                  else children.crossJoin(F.broadcast(above)))
        siblings = Window.partitionBy(*path[:-1]) if i else Window.partitionBy(F.lit(0))
        full_at = F.when(F.col("__w") > 0, F.col("__capacity") / F.col("__w")).otherwise(F.lit(0.0))
        ordered = siblings.orderBy("__full_at", level)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        onwards = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        # The level to which children fill when those before are full; the true one is the highest.
        fill = (F.col("__budget") - F.coalesce(F.sum("__capacity").over(before), F.lit(0.0))
                ) / F.sum("__w").over(onwards)
        above = (
            placed.withColumn("__full_at", full_at)
            .withColumn("__fill", F.when(F.sum("__w").over(onwards) > 0, fill))
            .withColumn("__level", F.max("__fill").over(siblings))
            .select(*path, F.least("__capacity", F.coalesce(F.col("__level") * F.col("__w"),
                                                            F.lit(0.0))).alias("__budget"))
        )
    leaves = nodes.select(*levels, "supply")
    return _join_same(leaves, above, list(levels)).select(
        *levels, "supply", F.floor(F.col("__budget") + F.lit(1e-6)).cast("long").alias("budget"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]],
        total_share: float, epochs: int = EPOCHS, seed: int = 0, id_col: str = "doc_id",
        text_col: str = "text", into: str = "mix") -> DataFrame:
    """Draw documents so that the tree's leaves get their budgets; see ``leaf_budgets``.

    ``levels`` names the tree's levels from the top, with an expression for each.  A document's tokens
    are its words.  A leaf with a budget of several times its supply is taken in whole epochs; the
    rest of the budget is a prefix of one more epoch, in an order seeded by seed and epoch:
    documents are taken while the running total of tokens stays within it.

    Returns one row per document and epoch it is taken in: the columns of ``docs`` and a struct ``into``
    with the levels, epoch (from 0) and tokens.  The prefix of a leaf is found from sums of 4,096
    parts of its order and the rows of one part, so no leaf is sorted in one place; texts are filtered by
    a table with one row per leaf.  Documents without tokens (null, empty or blank text)
    have nothing to take and are not returned.  Null levels are a node like any other.  Rows equal in
    id and text have one place in the order and are taken or left together.  An empty table gives
    an empty result; a column named ``into`` is replaced.
    """
    names = list(levels)
    inner = {name: f"__level_{i}" for i, name in enumerate(names)}
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(
        whole_row(docs).alias("row"),
        *[c.cast("string").alias(inner[name]) for name, c in levels.items()],
        word_count(F.col(text_col)).alias("__tokens"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), content))
        .alias("__row"),
    ).where(F.col("__tokens") > 0)
    at = list(inner.values())
    narrow = written(keyed.select(*at, "__row", "__tokens"))
    supply = narrow.groupBy(*at).agg(F.sum("__tokens").alias("supply"))
    budgets = leaf_budgets(supply, at, {inner[n]: weights.get(n, {}) for n in names}, total_share,
                           epochs)
    plan = written(budgets.withColumn("__epoch", F.floor(F.col("budget") / F.col("supply")))
                   .withColumn("__rest", F.col("budget") - F.col("__epoch") * F.col("supply")))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__epoch").cast("string"), F.col("__row")))
    part = F.substring("__place", 1, _PART_DIGITS)
    open_rows = _join_same(narrow, plan, at).where("__rest > 0").withColumn(
        "__place", place).withColumn("__part", part)
    sums = open_rows.groupBy(*at, "__part").agg(
        F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest"))
    running = Window.partitionBy(*at).orderBy("__part")
    crossing = (
        sums.withColumn("__upto", F.sum("__sum").over(running)).where("__upto > __rest")
        .groupBy(*at).agg(F.min(F.struct("__part", (F.col("__upto") - F.col("__sum")).alias("base")))
                          .alias("__first"))
        .select(*at, F.col("__first.__part").alias("__stop"), F.col("__first.base").alias("__base"))
    )
    within = Window.partitionBy(*at).orderBy("__place")
    last = (
        _join_same(open_rows, crossing, at).where("__part = __stop")
        .withColumn("__upto", F.sum("__tokens").over(within) + F.col("__base"))
        .groupBy(*at).agg(F.max(F.when(F.col("__upto") <= F.col("__rest"), F.col("__place")))
                          .alias("__last"), F.first("__stop").alias("__stop"))
    )
    last = last.withColumnsRenamed({c: f"__of_{c}" for c in at})
    leaves = written(plan.join(last, _same(plan, last, at), "left").select(
        *at, "__epoch", "__stop", "__last"))
    taken = _join_same(keyed, leaves, at).withColumn("__place", place)
    in_prefix = F.coalesce((part < F.col("__stop")) | (F.col("__place") <= F.col("__last")),
                           F.lit(False))
    times = F.col("__epoch") + F.when(in_prefix, 1).otherwise(0)
    chosen = taken.withColumn("__times", times).where("__times > 0").withColumn(
        "__taken", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    result = F.struct(*[F.col(inner[n]).alias(n) for n in names],
                      F.col("__taken").alias("epoch"), F.col("__tokens").alias("tokens"))
    others = [c for c in docs.columns if c != into]
    return chosen.select(*unpacked("row", others), result.alias(into))
