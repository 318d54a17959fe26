"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import gapless_rank, written


@dataclass(frozen=True)
class Leaf:
    """A shard and its place.  ``layer`` is the step of growth that added this weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    layer: int = 0


def even_tree(shards: int, regions: int = 2, racks: int = 3, base: int | None = None
              ) -> list[Leaf]:
    """Shards of equal weight; those from ``base`` on are layers of growth of their own.

    The first ``base`` shards lie in blocks, region by region and rack by rack; later ones are
    dealt to the racks in turn.
    """
    base = shards if base is None else base
    places = regions * racks
    leaves = []
    for s in range(shards):
        place = s * places // base if s < base else (s - base) % places
        leaves.append(Leaf(place // racks, place % racks, s, 1.0, max(0, s - base + 1)))
    return leaves


def tree_shard(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key (a column, read as text) in the tree.

    At each level every child draws an exponential with its weight as rate, and the smallest
    draw wins.  A child's weight is kept by layer of growth: what a layer adds has a draw of its
    own, and a child that wins by such a draw is descended within that layer.  So added weight
    takes keys only into what was added, in proportion, and every other draw stays as it was:
    keys move nowhere but into the subtree whose weight grew.  Leaves of weight 0 or less get
    nothing.  A null key counts as empty text and so has one shard.

    52 bits of an MD5 value of key and node make the uniform number, so that any engine can
    repeat the draw.
    """
    children: dict[str, dict[str, float]] = {}
    shard_of: dict[str, int] = {}
    for leaf in leaves:
        if leaf.weight <= 0:
            continue
        path, steps = "", (leaf.region, leaf.rack, leaf.shard)
        for depth, step in enumerate(steps):
            # the first level tells the layers apart; below it they have nodes of their own
            below = f"{path}/{step}" if depth else f"+{leaf.layer}/{step}"
            weights = children.setdefault(path, {})
            weights[below] = weights.get(below, 0.0) + leaf.weight
            path = below
        shard_of[path] = leaf.shard
    table = F.create_map(*[
        x for path, weights in sorted(children.items())
        for x in (F.lit(path), F.array(*[
            F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight"))
            for label, w in sorted(weights.items())]))
    ])
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"))

    def draw(node: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, node["label"])), 1, 13), 16, 10)
        uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return -F.log(uniform) / node["weight"]

    path = F.lit("")
    for _ in range(3):
        drawn = F.transform(F.element_at(table, path),
                            lambda node: F.struct(draw(node).alias("draw"), node["label"].alias("label")))
        path = F.array_min(drawn)["label"]
    shards = F.create_map(*[x for p, s in sorted(shard_of.items()) for x in (F.lit(p), F.lit(s))])
    return F.element_at(shards, path)


def shard_documents(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None,
                    id_col: str = "doc_id", text_col: str = "text",
                    carry: dict[str, Column] | None = None) -> DataFrame:
    """Place every row in a shard by its id and number the rows of each shard from 0.

    Returns id, size (UTF-8 bytes of the text plus 8; a null text has none), shard, slot, the
    columns of ``carry``, and grown_shard, the place in the tree ``grown``, if that is given.
    Narrow rows are written once; texts are read once and go through no shuffle.  Slots follow an
    MD5 value of id and text, and are counted in 4,096 parts of each shard, so that no task holds
    a whole shard and the result does not depend on how the files are cut.  Rows with a null
    id share a shard; rows that repeat an id share it as well and get slots of their own.  An empty
    table gives an empty result, and other columns of ``docs`` are not looked at.
    """
    carry = carry or {}
    key = F.col(id_col)
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    place = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), content))
    rows = written(docs.select(
        key.alias("id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8)
        .cast("long").alias("size"),
        *[c.alias(name) for name, c in carry.items()],
        place.alias("__place"),
        tree_shard(key, leaves).cast("int").alias("shard"),
        *([tree_shard(key, grown).cast("int").alias("grown_shard")] if grown is not None else []),
    ))
    slots = gapless_rank(rows, ["shard"], F.substring("__place", 1, 3), ["__place"], "slot")
    out = ["size", "shard", "slot", *carry, *(["grown_shard"] if grown is not None else [])]
    return slots.select(F.col("id").alias(id_col), *out)
