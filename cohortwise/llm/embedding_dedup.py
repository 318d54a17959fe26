"""Near-duplicate vectors: random hyperplanes in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import ship_package, written
from cohortwise.llm.graph import connected_components

THRESHOLD = 0.9
RECALL = 0.95
BLOCK = 1024


def tables_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Tables of ``bits`` signs that find a pair just at the threshold with probability ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def sign_codes(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One integer of ``bits`` signs for each vector and table."""
    planes = np.random.default_rng(seed).standard_normal((unit.shape[1], bits * tables))
    signs = (unit @ planes > 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _unit(raw: list[bytes], kind: np.dtype) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links a-b, among 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked_pairs(group: np.ndarray, side: np.ndarray, cross: np.ndarray, unit: np.ndarray,
                  codes: np.ndarray, table: np.ndarray, threshold: float
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group that are near and first meet in this table.

    Rows are sorted by group.  Of a group that is made of two blocks (``cross``) only pairs from
    different sides are compared.
    """
    size = np.bincount(group)
    found_a, found_b = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        good = (~cross[a] | (side[a] != side[b]))
        a, b = a[good], b[good]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            first = (codes[x] == codes[y]).argmax(axis=1) == table[x]
            found_a.append(x[first])
            found_b.append(y[first])

    small = np.flatnonzero(size[group] <= 64)
    for step in range(1, int(size[size <= 64].max(initial=1))):
        a, b = small[:-step], small[step:]
        same = group[a] == group[b]
        if not same.any():
            break
        keep(a[same], b[same])
    starts = np.concatenate(([0], np.cumsum(size)))
    for g in np.flatnonzero(size > 64):
        lo, hi = starts[g], starts[g + 1]
        for at in range(lo, hi, 256):
            rows = np.arange(at, min(at + 256, hi))
            near = unit[rows] @ unit[lo:hi].T >= threshold - 1e-9
            x, y = np.nonzero(near)
            x, y = rows[x], y + lo
            later = x < y
            keep(x[later], y[later])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id",
                           vector_col: str = "embedding", threshold: float = THRESHOLD,
                           recall: float = RECALL, bits: int | None = None, seed: int = 11,
                           block: int = BLOCK) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least ``threshold``.

    Equal vectors become one node with a count.  A node gets a code of ``bits`` hyperplane signs in
    each of so many tables that a pair at the threshold meets with probability ``recall`` (nearer
    pairs more surely).  Unless given, bits = log2 of the number of nodes, rounded up, so that
    buckets of unlike vectors stay small at any size.  All pairs in a bucket are compared exactly.
    A pair that meets in several tables counts in the first alone, which both rows can tell
    from their codes, so pairs are never written out: a bucket gives each row its number
    of links and its local root.  A bucket of more than ``block`` rows is cut into blocks, and pairs of
    blocks are spread over tasks.

    Returns one row per input row: id, n_links (other rows linked directly, equal ones included),
    component_id (smallest id reachable, its own included) and kept (id = component_id).  Vectors
    that are null, empty, zero, or hold a null or non-finite component link with nothing.  Vectors of
    different lengths are never linked.  Null ids take part but name no component (component_id
    is null where all are); rows that repeat an id count as vectors of their own, and each
    is kept if it bears its component's id.  An empty table gives an empty result.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = np.dtype("<f4") if element == "float" else np.dtype("<f8")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn(
        "usable", F.coalesce(
            F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x) < F.lit(float("inf"))))
            & F.exists("v", lambda x: x != 0), F.lit(False)))
    equal = rows.where("usable").groupBy("v").agg(
        F.count("*").alias("copies"), F.min("id").alias("least_id"))
    nodes = written(equal.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    bits = bits or max(8, math.ceil(math.log2(max(n, 2))))
    tables = tables_for(bits, threshold, recall)

    ship_package(vectors.sparkSession)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [np.asarray(v, dtype=kind).tobytes() for v in pdf["v"]]
            lengths = np.array([len(x) for x in raw])
            for size in np.unique(lengths):
                own = np.flatnonzero(lengths == size)
                own_raw = [raw[i] for i in own]
                codes = sign_codes(_unit(own_raw, kind), bits, tables, seed)
                yield pd.DataFrame({
                    "node": pdf["node"].to_numpy()[own], "copies": pdf["copies"].to_numpy()[own],
                    "dims": size // kind.itemsize, "vector": own_raw,
                    "codes": [x.astype("<i8" if bits > 31 else "<i4").tobytes() for x in codes],
                    "code": list(codes)})

    coded = written(nodes.select("node", "copies", "v").mapInPandas(
        code, "node long, copies long, dims int, vector binary, codes binary, code array<long>"))
    member = coded.select("node", "dims", F.posexplode("code").alias("table", "bucket"))
    key = ["dims", "table", "bucket"]
    crowded = member.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(
        *key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = member.join(crowded, key).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", *key, "own", F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"))
    group = [*key, "lo", "hi"]
    compared = (
        placed.join(coded.drop("code", "dims"), "node")
        .repartition(*group).sortWithinPartitions(*group)
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def done(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Whole groups, in pieces of one vector length."""
            for _, part in pdf.groupby("dims", sort=False):
                starts = (part[group] != part[group].shift()).any(axis=1).to_numpy()
                number = np.cumsum(starts) - 1
                unit = _unit(list(part["vector"]), kind)
                codes = np.frombuffer(b"".join(part["codes"]), "<i8" if bits > 31 else "<i4")
                a, b = _linked_pairs(
                    number, part["own"].to_numpy(), (part["lo"] != part["hi"]).to_numpy(), unit,
                    codes.reshape(len(part), tables), part["table"].to_numpy(), threshold)
                node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
                links = np.zeros(len(part), dtype=np.int64)
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                linked = np.flatnonzero(links)
                yield pd.DataFrame({"node": node[linked], "links": links[linked],
                                    "root": node[_roots(len(part), a, b)[linked]]})

        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            last = (pdf[group] == pdf[group].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            rest = pdf.iloc[cut:].reset_index(drop=True)
            for at in _cuts(pdf.iloc[:cut], group):
                yield from done(at)
        if rest is not None and len(rest):
            yield from done(rest)

    found = written(compared.select(
        *group, "own", "node", "copies", "vector", "codes"
    ).mapInPandas(link, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    part_of = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # The component's name is the least id of its vectors.
    graph = nodes.join(part_of, "node", "left").join(links, "node", "left").select(
        "v", "copies", "least_id", F.coalesce("component", "node").alias("component"),
        F.coalesce("links", F.lit(0)).alias("links"))
    names = graph.groupBy("component").agg(F.min("least_id").alias("name"))
    known = graph.join(names, "component").select(
        "v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "name")
    usable = rows.where("usable").join(known, "v").select("id", "n_links", "name")
    alone = rows.where(~F.col("usable")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("name"))
    return usable.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("name").alias("component_id"),
        F.coalesce(F.col("id") == F.col("name"), F.lit(False)).alias("kept"))


def _cuts(pdf: pd.DataFrame, group: list[str], rows: int = 4096) -> Iterator[pd.DataFrame]:
    """Runs of whole groups, of about ``rows`` rows."""
    if not len(pdf):
        return
    starts = np.flatnonzero((pdf[group] != pdf[group].shift()).any(axis=1).to_numpy())
    at = 0
    while at < len(pdf):
        ahead = starts[starts >= at + rows]
        end = int(ahead[0]) if len(ahead) else len(pdf)
        yield pdf.iloc[at:end]
        at = end
