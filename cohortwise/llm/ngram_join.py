"""N-gram Jaccard join by a size-aware heavy-light scheme."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm import textnum
from cohortwise.llm.common import bit_words, ship_package, small_batches, written
from cohortwise.llm.links import linked_components, parity_bits, shared_buckets

SKETCH = 1 << 18  # counters of the frequency sketch, whatever the corpus
FILTER_BITS = 1 << 22
LARGEST_LIGHT = 26
_COUNTED_SIZES = 64
_ALL = (1 << 64) - 1


def _least_common(size: int, percent: int) -> int:
    """Elements of a set that must be common for a link: at least its share of any union."""
    return -(-percent * size // 100)


def subset_count(size: int, percent: int) -> int:
    return sum(math.comb(size, d) for d in range(size - _least_common(size, percent) + 1))


def choose_boundary(sizes: np.ndarray, list_length: float, percent: int) -> int:
    """Largest light size: the one for which subsets and list scans cost least together.

    ``sizes`` counts sets by size (0 to ``_COUNTED_SIZES``).  A light set of size s writes every
    subset of a size that a partner may share; a heavy one writes its prefix and meets
    ``list_length`` sets in each list.  Sets that are light, but large enough to be like a heavy one,
    do both.
    """
    best, least = 0, math.inf
    for x in range(LARGEST_LIGHT + 1):
        cost = sum(int(sizes[s]) * subset_count(s, percent) for s in range(1, x + 1))
        first_heavy = _least_common(x + 1, percent)
        cost += sum(int(sizes[s]) * (s - _least_common(s, percent) + 1) * (1 + list_length)
                    for s in range(max(1, first_heavy), len(sizes)))
        if cost < least:
            best, least = x, cost
    return best


def _subset_buckets(elements: np.ndarray, percent: int) -> np.ndarray:
    """A hash for each subset that a partner may share: sums of scrambled elements."""
    scrambled = textnum.mixed(elements ^ np.uint64(0x5851F42D4C957F2D))
    total = scrambled.sum(dtype=np.uint64)
    n, found = len(elements), []
    for d in range(n - _least_common(n, percent) + 1):
        if d:
            out = np.array(list(combinations(range(n), d)), dtype=np.int64)
            sums = total - scrambled[out].sum(axis=1, dtype=np.uint64)
        else:
            sums = np.array([total], dtype=np.uint64)
        found.append(textnum.mixed(sums + np.uint64((n - d) * 0x9E3779B97F4A7C15 & _ALL)))
    return np.concatenate(found)


def _prefix(elements: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The rarest elements, so many that any partner's prefix holds one of them."""
    n = len(elements)
    order = np.lexsort((elements, frequency[(elements & np.uint64(SKETCH - 1)).astype(np.int64)]))
    return elements[order[: n - _least_common(n, percent) + 1]]


def _node(elements: np.ndarray) -> np.uint64:
    """A 64-bit name for a set."""
    return textnum.mixed(
        textnum.mixed(elements).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(elements)))[0]


def _tag(node: np.uint64, row_id) -> int:
    """Tells the rows of one set apart by their id."""
    name = zlib.crc32(repr(row_id).encode())
    return int(textnum.mixed(np.array([int(node) ^ (name * 0xD6E8FEB86659FD93 & _ALL)],
                                      dtype=np.uint64)).view(np.int64)[0])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose word n-gram sets have a Jaccard similarity of ``percent`` / 100.

    Words are runs of characters other than space and 0x09-0x0D, with A-Z lower-cased.  A set holds
    the distinct n-grams of the whole text, or, with fewer words, the whole sequence as one.

    * A first reading counts n-grams in a sketch of fixed size, and sets by size.  From these the
      boundary between light and heavy sets is chosen by cost.
    * Light sets write a hash for each subset they may share with a partner; two light sets that are
      alike share the one of their intersection.
    * Heavy sets (and light ones large enough to be like them) are found by inverted lists over
      their rarest n-grams, as many as are needed to share one with any partner.
    * Two sets meet in the list of their first common n-gram; if what follows it in either set is
      too little for the similarity, they are not compared.
    * Documents of one set are one node.  Nodes that share a subset or list are compared exactly as
      ``links.linked_components`` says: no list is capped, no link between components is lost.

    Returns one row per input row: id, n_shingles, component_id (the smallest id reachable by
    links, its own included).  A null text, or one without words, has an empty set and is linked with
    nothing.  Null ids take part, but name no component; rows that repeat an id or a text are nodes'
    members like any other.  An empty table gives an empty result; other columns are not looked
    at.  Sets are compared by 64-bit hashes of their n-grams.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, id_col, text_col, words, percent)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """See ``jaccard_components``; all that Python does has run when this returns."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH + _COUNTED_SIZES + 1, dtype=np.int64)
        for batch in batches:
            for run in textnum.chunked(textnum.each_text(batch.column(0))):
                sets = list(textnum.shingle_sets(run, words))
                slots_ = (np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64)
                sizes_ = np.minimum([len(x) for x in sets], _COUNTED_SIZES) + SKETCH
                counts += np.bincount(np.concatenate((slots_, sizes_)), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    counted = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).toPandas()  # SKETCH + 65 rows at most
    slots = np.zeros(SKETCH + _COUNTED_SIZES + 1, dtype=np.int64)
    slots[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    frequency, sizes = slots[:SKETCH], slots[SKETCH:]
    total = max(1, int(frequency.sum()))
    crowding = float((frequency.astype(float) ** 2).sum()) / total / max(total / SKETCH, 1.0)
    boundary = choose_boundary(sizes, crowding, percent)
    heavy_from = _least_common(boundary + 1, percent)
    frequency = np.minimum(frequency, 2**31 - 1).astype(np.int32)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column(0), 0
            for run in textnum.chunked(textnum.each_text(batch.column(1))):
                nodes, tags, counts, parities = [], [], [], []
                buckets, lefts, ends = [], [], [0]
                for elements in textnum.shingle_sets(run, words):
                    n = len(elements)
                    counts.append(n)
                    found = []
                    parities.append(parity_bits(elements) if n else None)
                    if n:
                        node = _node(elements)
                        nodes.append(int(node.view(np.int64)))
                        tags.append(_tag(node, ids[row + len(counts) - 1].as_py()))
                        if n <= boundary:
                            found.append(_subset_buckets(elements, percent))
                            lefts.append(np.full(len(found[-1]), n, dtype=np.int32))
                        if n >= heavy_from:
                            found.append(textnum.mixed(_prefix(elements, frequency, percent)))
                            lefts.append(np.arange(n, n - len(found[-1]), -1, dtype=np.int32))
                    else:
                        nodes.append(None)
                        tags.append(None)
                    buckets += found
                    ends.append(ends[-1] + sum(map(len, found)))
                flat = np.concatenate(buckets).view(np.int64) if buckets else np.zeros(0, np.int64)
                left = np.concatenate(lefts) if lefts else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(run)), pa.array(nodes, pa.int64()),
                     pa.array(tags, pa.int64()), pa.array(counts, pa.int32()),
                     pa.array(parities, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(left))],
                    names=["id", "node", "tag", "size", "parity", "buckets", "lefts"])
                row += len(run)

    id_type = texts.schema["id"].dataType.simpleString()
    described = written(texts.mapInArrow(
        describe, f"id {id_type}, node long, tag long, size int, parity binary, "
                  "buckets array<long>, lefts array<int>"))
    live = shared_buckets(
        described.where("node is not null").select(
            "node", "size", F.explode(F.arrays_zip("buckets", "lefts")).alias("b"))
        .select("node", "size", F.col("b.buckets").alias("bucket"), F.col("b.lefts").alias("left")))

    profiles = written(
        described.select("node", "size", "parity").join(
            live.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))

    def fetch(nodes: DataFrame) -> DataFrame:
        """Sets of some nodes, each from one of its documents: the texts are read again, and a bit
        filter of fixed size spares most other documents the way through the shuffle."""
        needed = written(described.select("node", "tag").join(nodes, "node")
                         .groupBy("node").agg(F.min("tag").alias("tag")))
        mask = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        part = bit_words(needed, F.col("tag"), FILTER_BITS).toPandas()
        mask[part["word"].to_numpy(np.int64)] = part["mask"].to_numpy(np.int64).view(np.uint64)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, row = batch.column(0).to_pylist(), 0
                for run in textnum.chunked(textnum.each_text(batch.column(1))):
                    columns: list[list] = [[], [], []]
                    for elements in textnum.shingle_sets(run, words):
                        row += 1
                        if not len(elements):
                            continue
                        node = _node(elements)
                        tag = _tag(node, ids[row - 1])
                        bit = tag % FILTER_BITS
                        if int(mask[bit >> 6]) >> (bit & 63) & 1:
                            for column, value in zip(columns, (
                                    int(node.view(np.int64)), tag, elements.astype("<u8").tobytes())):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (
                            pa.int64(), pa.int64(), pa.binary()))],
                        names=["node", "tag", "elements"])

        found = texts.mapInArrow(gather, "node long, tag long, elements binary")
        wanted = needed.select("node", F.col("tag").alias("wanted"))
        return written(found.join(wanted, "node").where("tag = wanted")
                       .dropDuplicates(["node"]).select("node", "elements"))

    part_of = linked_components(live, profiles, fetch, percent)
    members = described.select("id", "node", F.col("size").cast("long").alias("n_shingles"))
    grouped = members.join(part_of, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = grouped.where("component is not null").groupBy("component").agg(
        F.min("id").alias("name"))
    return grouped.join(names, "component", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("name"))
        .alias("component_id"))
