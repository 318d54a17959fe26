import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cohortwise.llm import sharding
from cohortwise.llm.queries import op2_sharding
from tests.conftest import SF
from tests.llm.helpers import awkward_texts, documents


def place(key, leaves):
    """The tree walked in plain Python."""
    key = "" if key is None else str(key)
    children = defaultdict(Counter)
    shard = {}
    for x in leaves:
        path = ""
        for depth, step in enumerate((x.region, x.rack, x.shard)):
            below = f"{path}/{step}" if depth else f"+{x.layer}/{step}"
            children[path][below] += x.weight
            path = below
        shard[path] = x.shard

    def draw(label, weight):
        bits = int(hashlib.md5(f"{key}|{label}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weight

    path = ""
    while path not in shard:
        path = min(children[path], key=lambda c: draw(c, children[path][c]))
    return shard[path]


def test_tree_against_plain_python(spark):
    leaves = [*sharding.even_tree(7, base=6), sharding.Leaf(1, 1, 9, 2.5), sharding.Leaf(0, 0, 10, 0)]
    df = spark.range(300).select(F.col("id"), sharding.tree_shard(F.col("id"), leaves).alias("s"))
    assert all(r.s == place(r.id, [x for x in leaves if x.weight > 0]) for r in df.collect())


def test_growth_takes_keys_into_the_new_shard_alone(spark):
    old, new = sharding.even_tree(24), sharding.even_tree(25, base=24)
    rows = spark.range(20_000).select(
        sharding.tree_shard(F.col("id"), old).alias("a"),
        sharding.tree_shard(F.col("id"), new).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {24} and 600 < len(moved) < 1000  # 1/25 is 800
    counts = Counter(r.a for r in rows)
    assert len(counts) == 24 and max(counts.values()) < 1.25 * min(counts.values())


def test_weights_are_met(spark):
    leaves = [sharding.Leaf(0, 0, 0, 1), sharding.Leaf(0, 1, 1, 3), sharding.Leaf(1, 0, 2, 4)]
    counts = Counter(r.s for r in spark.range(16_000).select(
        sharding.tree_shard(F.col("id"), leaves).alias("s")).collect())
    assert abs(counts[0] - 2000) < 250 and abs(counts[1] - 6000) < 350


def test_slots_and_awkward_rows(spark):
    rows = awkward_texts()
    df = documents(spark, rows)
    got = sharding.shard_documents(df, sharding.even_tree(3), carry={"crc": F.crc32(
        F.coalesce("text", F.lit("")))}).collect()
    assert Counter((r.doc_id, r.size, r.crc) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard_documents(df.limit(0), sharding.even_tree(3)).count() == 0


def test_query(spark):
    got = op2_sharding(spark, SF).collect()
    old, new = sharding.even_tree(24), sharding.even_tree(25, base=24)
    assert len({r.doc_id for r in got}) == 200
    for r in got:
        assert (r.shard, r.grown_shard) == (place(r.doc_id, old), place(r.doc_id, new))
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
