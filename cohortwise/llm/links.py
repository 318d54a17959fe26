"""Linking sets that share buckets: exact verification without writing out all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import written
from cohortwise.llm.graph import connected_components

LEADER_ROUNDS = 1
LEADER_ORDERS = 3  # each names two leaders, its first and its last
SIGNATURE_WORDS = 8  # at most so many in the longest part of a signature, whatever the set

POSTING = ("bucket", "node", "size", "left")
Fetch = Callable[[DataFrame], DataFrame]


def parity_bits(elements: np.ndarray) -> bytes:
    """One bit per residue: whether an odd number of elements fall on it; about 2 bits each."""
    bits = max(64, 1 << int(2 * max(len(elements), 1) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from two sets' parity bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _signature(parity: bytes) -> np.ndarray:
    """Parity bits folded to 1, 2, 4 and 8 words of 64 bits, one after the other, as far as there are so many."""
    x = np.frombuffer(parity, "<i8")
    while len(x) > SIGNATURE_WORDS:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    levels = [x]
    while len(x) > 1:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        levels.append(x)
    return np.concatenate(levels[::-1])


def _signatures_fit(percent: int) -> Column:
    """Whether two rows' signatures leave the similarity possible: false only for pairs that are not alike.

    The odd residues of both, at each length that both have, are no more than the differences.
    """
    allowed = (100 - percent) * (F.col("size") + F.col("other_size"))
    fits, words, at = F.lit(True), 1, 0
    while words <= SIGNATURE_WORDS:
        odd = [F.bit_count(F.get("signature", F.lit(i)).bitwiseXOR(F.get("other_signature", F.lit(i))))
               for i in range(at, at + words)]
        fits = fits & F.coalesce((100 + percent) * sum(odd[1:], odd[0]) <= allowed, F.lit(True))
        at, words = at + words, words * 2
    return fits


def verified(pairs: DataFrame, profiles: DataFrame, fetch: Fetch, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * intersection >= percent * union.

    ``profiles`` has node, size and parity.  The parity bits, about a quarter byte an element,
    exclude most unlike pairs for certain; ``fetch`` then gets the sets of the nodes of the rest: node
    and elements (sorted 64-bit values).
    """
    @F.pandas_udf("boolean")
    def possible(na: pd.Series, pa: pd.Series, nb: pd.Series, pb: pd.Series) -> pd.Series:
        return pd.Series([
            (100 + percent) * fewest_differences(x, y) <= (100 - percent) * (m + n)
            for m, x, n, y in zip(na, pa, nb, pb, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        good = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(good, dtype=bool)

    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("node").alias(name),
                            *[F.col(c).alias(f"{c}_{name}") for c in columns])

    hopeful = written(
        pairs.join(side(profiles, "a", "size", "parity"), "a")
        .join(side(profiles, "b", "size", "parity"), "b")
        .where(possible("size_a", "parity_a", "size_b", "parity_b")).select("a", "b")
    )
    if hopeful.isEmpty():
        return hopeful
    sets = fetch(hopeful.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return (
        hopeful.join(side(sets, "a", "elements"), "a").join(side(sets, "b", "elements"), "b")
        .where(alike("elements_a", "elements_b")).select("a", "b")
    )


def shared_buckets(postings: DataFrame) -> DataFrame:
    """Postings (bucket, node, size, left) of the buckets that hold two nodes or more, written.

    ``left`` is how many of the node's elements may be common if this is the first bucket it shares
    with another: its size, less the elements before this one where buckets stand for elements in a
    global order.
    """
    ends = postings.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return written(postings.join(ends.select("bucket"), "bucket").select(*POSTING).distinct())


def _fit(percent: int):
    """What is left of either set allows the similarity; holds at the first bucket of a linked pair."""
    return ((100 + percent) * F.least("left", "other_left")
            >= percent * (F.col("size") + F.col("other_size")))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked_components(live: DataFrame, profiles: DataFrame, fetch: Fetch, percent: int,
                      rounds: int = LEADER_ROUNDS, links: DataFrame | None = None,
                      decided: int | None = None) -> DataFrame:
    """(node, component) of the nodes that are linked to others.

    ``live`` has the shared buckets (written); two nodes that are alike must share one.  See
    ``verified`` for ``profiles`` and ``fetch``.  All links that join different components are found,
    without comparing all pairs of a bucket:

    1. In a round each bucket names a few leaders (the first and last in several orders by hash,
       others in each round), and every node is compared with its buckets' leaders, unless both are in
       one component already.  That is linear in the postings.  Groups of near copies fall together.
    2. Buckets whose nodes are all in one component are done, and so are those of two nodes.
    3. At the end the nodes outside a bucket's main component are compared with all nodes of
       the bucket that are in other components than their own.  No bucket is capped or skipped.
       The join itself leaves out pairs whose folded parity bits prove them unlike, so that
       these are neither written nor shuffled.

    ``links`` (a, b) may give links that are known beforehand.  If these are all links among nodes of
    the size ``decided``, two such nodes are not compared any more.
    """
    tested: DataFrame | None = None
    part_of: DataFrame | None = None
    marked = live.withColumn("component", F.col("node"))

    def grown(pairs: DataFrame) -> None:
        nonlocal tested, part_of, marked
        found = written(verified(pairs, profiles, fetch, percent))
        if part_of is not None and found.isEmpty():
            return
        edges = found if part_of is None else found.unionByName(
            part_of.select(F.col("node").alias("a"), F.col("component").alias("b")))
        part_of = written(connected_components(edges))

    undecided = F.lit(True) if decided is None else F.col("size") != decided
    compare = (F.col("component") != F.col("other_component")) & _fit(percent) & (
        F.lit(True) if decided is None else undecided | (F.col("other_size") != decided))

    def regrouped(postings: DataFrame, least: int) -> DataFrame:
        """Postings of the buckets of ``least`` nodes or more that still hold several components."""
        now = postings.select(*POSTING).join(part_of, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        open_ = now.groupBy("bucket").agg(
            F.count("*").alias("n"), F.min("component").alias("low"),
            F.max("component").alias("high"), F.max(undecided).alias("open")
        ).where((F.col("n") >= least) & (F.col("low") < F.col("high")) & F.col("open"))
        return written(now.join(open_.select("bucket"), "bucket")
                       .select(*POSTING, "component"))

    if links is not None:
        part_of = written(connected_components(links))
        marked = regrouped(live, 2)
        if marked.isEmpty():
            return part_of
    for number in range(rounds):
        orders = [F.struct(F.xxhash64(F.lit(number * LEADER_ORDERS + k), "node").alias("h"),
                           *[F.col(c) for c in ("node", "size", "left", "component")])
                  for k in range(LEADER_ORDERS)]
        ends = [end(order).alias(f"{i}{name}") for i, order in enumerate(orders)
                for name, end in (("first", F.min), ("last", F.max))]
        named = F.array_distinct(F.transform(
            F.array(*[F.col(f"{i}{name}") for i in range(LEADER_ORDERS) for name in ("first", "last")]),
            lambda s: F.struct(s["node"].alias("node"), s["size"].alias("size"),
                               s["left"].alias("left"), s["component"].alias("component"))))
        leaders = marked.groupBy("bucket").agg(*ends).select("bucket", F.explode(named).alias("l"))
        leaders = leaders.select(
            "bucket", F.col("l.node").alias("other"), F.col("l.size").alias("other_size"),
            F.col("l.left").alias("other_left"), F.col("l.component").alias("other_component"))
        pairs = marked.join(leaders, "bucket").where(compare).select(*_pair("node", "other")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        grown(pairs)
        marked = regrouped(marked, 3)
        if marked.isEmpty():
            return part_of
    @F.pandas_udf("array<long>")
    def signature(parity: pd.Series) -> pd.Series:
        return parity.map(_signature)

    signed = profiles.join(marked.select("node").distinct(), "node", "left_semi").select(
        "node", signature("parity").alias("signature"))
    marked = written(marked.join(signed, "node"))
    sizes = marked.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m")).select(
        "bucket", F.col("m.component").alias("main"))
    outside = marked.join(main, "bucket").where("component != main").select(
        "bucket", F.col("node").alias("other"), F.col("size").alias("other_size"),
        F.col("left").alias("other_left"), F.col("component").alias("other_component"),
        F.col("signature").alias("other_signature"))
    rest = marked.join(outside, "bucket").where(compare & _signatures_fit(percent)).select(
        *_pair("node", "other")).distinct().join(tested, ["a", "b"], "left_anti")
    rest = written(rest)
    if not rest.isEmpty():
        grown(rest)
    return part_of
