"""Exact top-k inner-product search: ball trees per shard, branch and bound with shared k-th scores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm.common import ship_package, written

SCALE = 1024
K = 10
SHARD_ROWS = 16_384
LEAST_SHARDS = 8
LEAF_ROWS = 64
QUERY_BLOCK = 2_048
LONG = (1 << 63) - 1


class Tree(NamedTuple):
    """A ball tree as a heap: the children of node i are 2i+1 and 2i+2; leaves stand on the last level."""

    depth: int
    centre: np.ndarray
    radius: np.ndarray
    leaves: list[np.ndarray]


def ball_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Halve the rows along the line between two far points until a leaf holds ``leaf_rows`` at most.

    Halves are equal in number, so that ties and repeated points can't make the tree deep.
    """
    depth = 0
    while len(points) > leaf_rows << depth:
        depth += 1
    n = (2 << depth) - 1
    centre, radius = np.zeros((n, points.shape[1])), np.full(n, -np.inf)
    level = [np.arange(len(points))]
    for d in range(depth + 1):
        below = []
        for i, rows in enumerate(level, (1 << d) - 1):
            own = points[rows].astype(np.float64)
            if len(rows):
                centre[i] = own.mean(axis=0)
                away = np.sqrt(((own - centre[i]) ** 2).sum(axis=1))
                radius[i] = away.max()
                if d < depth:
                    a = own[away.argmax()]
                    b = own[((own - a) ** 2).sum(axis=1).argmax()]
                    rows = rows[np.argsort(own @ (b - a), kind="stable")]
            half = len(rows) // 2
            below += [rows[:half], rows[half:]]
        if d < depth:
            level = below
    return Tree(depth, centre, radius, level)


def _largest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer rows, exact; what passes 63 bits stands at the end of their range."""
    most = a.shape[1] * _largest(a) * _largest(b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= LONG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LONG, LONG).astype(np.int64)


class Best:
    """The ``k`` best rows of each query so far, in order."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -LONG - 1)
        self.tie = np.full((queries, k), LONG)
        self.row = np.full((queries, k), -1)

    def merge(self, at: np.ndarray, score: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        """Offer the rows to the queries ``at``."""
        s = np.concatenate([self.score[at], score], axis=1)
        t = np.concatenate([self.tie[at], np.broadcast_to(tie, score.shape)], axis=1)
        r = np.concatenate([self.row[at], np.broadcast_to(row, score.shape)], axis=1)
        order = np.lexsort((t, ~s), axis=1)[:, : self.k]
        for name, x in (("score", s), ("tie", t), ("row", r)):
            getattr(self, name)[at] = np.take_along_axis(x, order, axis=1)


def search(tree: Tree, points: np.ndarray, tie: np.ndarray, queries: np.ndarray, bar: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best points of the tree, as (query, point, score).

    ``bar`` is a score that k points elsewhere are known to reach (-2^63 if none is).  A node is
    left out where its bound, query . centre + |query| radius, is below the bar or below the k-th score by
    now.  Leaves are taken in order of their bounds, highest first, in waves of 1, 2, 4, ... a query;
    the queries that want the same leaf are answered by one product.
    """
    best = Best(len(queries), k)
    real = queries.astype(np.float64)
    length = np.sqrt((real * real).sum(axis=1))
    here = np.ones((len(queries), 1), bool)
    for d in range(tree.depth + 1):
        nodes = slice((1 << d) - 1, (2 << d) - 1)
        here = np.repeat(here, 2, axis=1) if d else here
        reach = np.maximum(tree.radius[nodes], 0)
        # Doubles round: the bound gets room for the errors of its terms.
        room = 1e-12 * points.shape[1] * (np.abs(tree.centre[nodes]).sum(axis=1) + reach)
        bound = real @ tree.centre[nodes].T + length[:, None] * (reach + room) + 1e-6
        here &= (bound >= bar[:, None]) & (tree.radius[nodes] >= 0)
    order = np.argsort(np.where(here, -bound, np.inf), axis=1)
    left, done, wave = here.sum(axis=1), 0, 1
    while True:
        kth = np.maximum(best.score[:, -1], bar)
        at, step = np.nonzero(done + np.arange(wave) < left[:, None])
        leaf = order[at, done + step]
        hopeful = bound[at, leaf] >= kth[at]
        at, leaf = at[hopeful], leaf[hopeful]
        if not len(at):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by_leaf], prepend=-1, append=-1))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            own = at[by_leaf[begin:end]]
            rows = tree.leaves[leaf[by_leaf[begin]]]
            best.merge(own, products(queries[own], points[rows]), tie[rows], rows)
        done, wave = done + wave, wave * 2
    found = best.row >= 0
    return np.nonzero(found)[0], best.row[found], best.score[found]


def _answers(members: pd.DataFrame, asked: pd.DataFrame, trees: dict[int, tuple], k: int
             ) -> Iterator[pd.DataFrame]:
    """The best members of a shard for a block of queries; only vectors of one length are compared."""
    for dims, block in asked.groupby(asked["v"].str.len()):
        if dims not in trees:
            own = members[members["v"].str.len() == dims]
            points = np.array(own["v"].tolist(), np.int64).reshape(len(own), dims)
            trees[dims] = (ball_tree(points), points, own["tie"].to_numpy(), own["node"].to_numpy())
        tree, points, tie, node = trees[dims]
        if not len(points):
            continue
        queries = np.array(block["v"].tolist(), np.int64).reshape(len(block), dims)
        query, row, score = search(tree, points, tie, queries, block["tie"].to_numpy(), k)
        yield pd.DataFrame({"query": block["node"].to_numpy()[query], "node": node[row],
                            "tie": tie[row], "score": score})


def _searched(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """Rows (shard, kind, node, v, tie), kind 0 members and kind 1 queries with their bar as tie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, members, trees = None, [], {}
        for batch in batches:
            for (at, kind), part in batch.groupby(["shard", "kind"], sort=True):
                if at != shard:
                    shard, members, trees = at, [], {}
                if kind == 0:
                    members.append(part)
                    continue
                if not members:
                    continue
                members = [pd.concat(members)]
                for lo in range(0, len(part), QUERY_BLOCK):
                    yield from _answers(members[0], part.iloc[lo : lo + QUERY_BLOCK], trees, k)

    return (
        rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        .mapInPandas(run, "query long, node long, tie long, score long")
    )


def top_inner_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id",
                       vector_col: str = "embedding", k: int = K, scale: int = SCALE,
                       shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """For each row that ``is_query`` holds for, the ``k`` other rows of the greatest inner product.

    Components x become floor(scale * x), so that scores are integers and exact.  Equal vectors are
    one point, which keeps its k + 1 smallest ids: no answer can need more of them.  Points are dealt by a hash
    to shards of about ``shard_rows``; a shard's ball tree is built where it is searched.  Queries go to
    one shard each first, then to 4, 16, ... others, and bring with them the k-th score of all shards
    before, which prunes trees whatever the shard.  A query that was in all shards has its exact answer.  Memory
    of a task is a shard and a block of queries; only counts reach the driver.

    Returns query_id, rank (int, from 1), vec_id and score, ties to the smaller id.  Vectors that are null or hold
    a null or non-finite component take no part.  Vectors of different lengths aren't compared, the empty
    ones score 0 among themselves.  Components and scores beyond 64 bits stand at the end of that range.
    A row is never its own answer, but another row of the same id may be; rows that
    repeat a query's id are queries of their own.  A null id is no query, and an answer
    after all others of its score.  With fewer other rows than k all are returned.  Zero vectors are vectors as any
    other.  An empty table gives an empty result; other columns are not read.
    """
    ship_package(vectors.sparkSession)
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                                 & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(usable).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale))))
    by_id = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    first = rows.withColumn("i", F.row_number().over(by_id)).where(F.col("i") <= k + 1)
    points = written(first.groupBy("v").agg(
        F.min("id").alias("least"), F.collect_list(F.struct("id")).alias("ids")
    ).withColumn("node", F.monotonically_increasing_id()))
    asking = written(rows.where("asks AND id IS NOT NULL").select("id", "v").join(
        points.select("v", "node"), "v"))
    shards = max(least_shards, -(-points.count() // shard_rows))
    members = points.select(
        F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "node", "v",
        F.coalesce("least", F.lit(LONG)).alias("tie"))
    queries = written(asking.groupBy("node").agg(F.any_value("v").alias("v")))
    home = F.xxhash64("node", F.lit(1))
    best: DataFrame | None = None
    begin, end = 0, 1
    while begin < shards:
        bars = (queries.withColumn("tie", F.lit(-LONG - 1)) if best is None else queries.join(
            best.where(F.col("i") == k + 1).select(F.col("query").alias("node"), "score"), "node", "left"
        ).withColumn("tie", F.coalesce("score", F.lit(-LONG - 1))))
        asked = bars.withColumn("at", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))).select(
            F.pmod(F.pmod(home, F.lit(shards)) + F.col("at"), F.lit(shards)).alias("shard"),
            F.lit(1).alias("kind"), "node", "v", "tie")
        found = _searched(members.unionByName(asked), shards, k + 1)
        if best is not None:
            found = found.unionByName(best.drop("i"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "tie")
        best = written(found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1))
        begin, end = end, min(shards, end + 3 * end)
    entry = F.struct((-F.col("score")).alias("lowered"), F.col("one.id").isNull().alias("unnamed"),
                     F.col("one.id").alias("id"), F.col("node").alias("of"))
    answers = (
        best.join(points.select("node", F.explode("ids").alias("one")), "node")
        .groupBy(F.col("query").alias("node"))
        .agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("found"))
    )
    place = F.expr("array_position(transform(found, "
                   "x -> coalesce(x.of = node AND x.id = query_id, false)), true)")
    others = F.expr("filter(found, (x, i) -> i + 1 != place)")
    return (
        asking.select(F.col("id").alias("query_id"), "node").join(answers, "node")
        .withColumn("place", place)
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "x"))
        .select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"),
                (-F.col("x.lowered")).alias("score"))
    )
