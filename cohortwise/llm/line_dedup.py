"""Line deduplication by pairwise alignment of documents that share rare lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import ship_package, unpacked, whole_row, written

RARE_SHARE = 0.1
RARE_LEAST = 10
ANCHOR_CHARS = 20
_LAST = (1 << 63) - 1


def patience_matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Patience diff: index pairs of equal elements, ascending in both.

    Common ends of a region are matched; between them elements that occur once in either part
    anchor the longest ascending run, and the regions between anchors are treated likewise.
    """
    found: list[tuple[int, int]] = []
    regions = [(0, len(a), 0, len(b))]
    while regions:
        a0, a1, b0, b1 = regions.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        run = _longest_ascending(once)
        if not run:
            continue
        i0, j0 = a0, b0
        for i, j in run:
            regions.append((i0, i, j0, j))
            i0, j0 = i, j  # the anchor itself is matched as the start of the next region
        regions.append((i0, a1, j0, b1))
    return sorted(found)


def _longest_ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends: list[int] = []
    at_end: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        ends[n : n + 1] = [j]
        at_end[n : n + 1] = [k]
        before.append(at_end[n - 1] if n else -1)
    run, k = [], at_end[-1] if at_end else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def common_blocks(later: Sequence, earlier: Sequence, shared: set,
                  keys: Sequence[tuple] | None = None, places: dict | None = None) -> list[int]:
    """Indices in ``later`` of common blocks that hold a shared key.

    Blocks are those of the alignment first.  Keys that it leaves, as they repeat or stand in another
    order, are then met with their place in ``earlier`` and extended to both sides.  ``keys``
    are those of ``later`` (key, first line, end), ``places`` where keys begin in ``earlier``; of
    the shared lines if not given.
    """
    if keys is None:
        keys = [(x, i, i + 1) for i, x in enumerate(later) if x in shared]
    if places is None:
        places = {x: j for j, x in reversed([*enumerate(earlier)]) if x in shared}
    ends_at: dict[int, int] = {}
    for _, i, end in keys:
        ends_at[i] = min(end, ends_at.get(i, end))
    removed: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience_matches(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(ends_at.get(x, len(later)) <= block[-1] + 1 for x in block if x in ends_at):
                removed += block
            block = []
        block.append(i)
        last = (i, j)
    gone = set(removed)
    for key, i, end in keys:
        if key not in places or all(x in gone for x in range(i, end)):
            continue
        j, shift = places[key], places[key] - i
        while i and j and later[i - 1] == earlier[j - 1]:
            i, j = i - 1, j - 1
        while end < len(later) and end + shift < len(earlier) and later[end] == earlier[end + shift]:
            end += 1
        gone.update(range(i, end))
    return sorted(gone)


def line_keys(lines: Sequence, sizes: Sequence, least: int, frequent: set | frozenset = frozenset()
              ) -> list[tuple[int, int, int, bool]]:
    """What a document is found by: (key, first line, end, whether it is a passage of several lines).

    Each line of ``least`` characters has a key; a shorter one has two, with the lines after and with
    those before it until they have so many together.  A key in ``frequent`` that holds a line
    of ``least`` characters is none on its own; it is widened to either side until its neighbours have
    as many characters too.
    """
    found: list[tuple[int, int, int, bool]] = []

    def ahead(i: int) -> int:
        total = 0
        for end in range(i, len(lines)):
            total += sizes[end]
            if total >= least:
                return end + 1
        return -1

    def back(i: int) -> int:
        total = 0
        for start in range(i - 1, -1, -1):
            total += sizes[start]
            if total >= least:
                return start
        return -1

    def add(key: int, start: int, end: int, passage: bool) -> None:
        if passage or key not in frequent:
            found.append((key, start, end, passage))
            return
        for x, y in ((start, ahead(end)), (back(start), end)):
            if x >= 0 and y >= 0:
                found.append((hash(tuple(lines[x:y])), x, y, True))

    for i, size in enumerate(sizes):
        if size >= least:
            add(lines[i], i, i + 1, False)
        elif size:
            for x, y in {(i, ahead(i)), (back(i + 1), i + 1)}:
                if x >= 0 and y >= 0:
                    single = max(sizes[x:y]) >= least
                    add(hash(tuple(lines[x:y])), x, y, not single)
    return found


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rare_share: float = RARE_SHARE, rare_least: int = RARE_LEAST,
               anchor_chars: int = ANCHOR_CHARS, into: str = "line_dedup") -> DataFrame:
    """Delete from each document the blocks of lines it shares with earlier documents.

    A text equal to an earlier document's goes whole.  Other documents are found by their lines of
    at least ``anchor_chars`` characters, and by shorter ones joined with their neighbours until
    they have so many: each document that holds such a line or run is paired with the first that does, so pairs grow with the lines and not with the square of a group of copies.  Each pair is
    aligned with patience diff over line hashes; aligned common blocks with such a line are deleted
    from the later document, and so are blocks around such lines that repeat or stand in another order:
    each is left in its first document alone.  Only a single line that stands alone may be boilerplate: one that more
    than ``rare_share`` of all documents (and more than ``rare_least``) hold counts together with
    ``anchor_chars`` characters of its neighbours only.  A block of several lines goes however
    frequent it is.  The first holder of a line keeps it, so no line is lost.

    Returns ``docs`` with new texts and a struct ``into``: n_lines, n_removed, removed (line indices).
    Documents are ordered by integer id, then by a hash of the text; null ids come last.  Rows equal
    in both are one document that is said again: they lose the same lines, not each other's.
    A null text stays null and has no lines; lines are parted by a line feed, and one that holds
    blanks only is no anchor but may be part of a block; nor is a single short line.  A text of blanks only stays.  An empty
    table gives an empty result.  Any other columns stay; one named ``into`` is replaced.  Lines
    are compared by 64-bit hashes.  The driver gets the boilerplate lines, at most 1 / ``rare_share``
    times the lines of an average document.
    """
    rows = docs.select(
        whole_row(docs).alias("row"), F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__hash"))
    lines = _lines(F.col("text"))
    filled = rows.where(F.col("text").isNotNull())
    # Equal texts are one sequence, that of the first document; the others lose all lines.
    copies = filled.select("__id", "__hash").distinct().groupBy("__hash").agg(
        F.count("*").alias("copies"))
    sequences = written(filled.select(
        "__id", "__hash",
        F.transform(lines, lambda x: F.when(F.trim(x) == "", 0).otherwise(F.xxhash64(x)))
        .alias("lines"),
        F.transform(lines, lambda x: F.when(F.trim(x) == "", 0).otherwise(
            F.least(F.char_length(x), F.lit(anchor_chars)))).alias("sizes"),
    ).groupBy("__hash").agg(F.min("__id").alias("__id"), F.first("lines").alias("lines"),
                            F.first("sizes").alias("sizes")).join(copies, "__hash"))
    n_docs = sequences.agg(F.sum("copies")).first()[0] or 0
    most = max(rare_least, int(rare_share * n_docs))

    ship_package(docs.sparkSession)

    def keys_without(frequent: frozenset):
        @F.pandas_udf("array<struct<key:long,passage:boolean>>")
        def keys(lines: pd.Series, sizes: pd.Series) -> pd.Series:
            return pd.Series([
                [{"key": k, "passage": p} for k, p in
                 {k: p for k, _, _, p in line_keys(x.tolist(), y.tolist(), anchor_chars, frequent)}
                 .items()]
                for x, y in zip(lines, sizes, strict=True)], dtype=object)

        return sequences.select(F.struct("__id", "__hash").alias("doc"), "copies",
                                F.explode(keys("lines", "sizes")).alias("k")).select(
            "doc", "copies", F.col("k.key").alias("line"), F.col("k.passage").alias("passage"))

    frequent = frozenset(r["line"] for r in keys_without(frozenset()).where(~F.col("passage"))
                         .groupBy("line").agg(F.sum("copies").alias("n"))
                         .where(F.col("n") > most).select("line").collect())
    held = keys_without(frequent).select("doc", "line")
    first = (held.groupBy("line").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
             .where(F.col("n") > 1).select("line", "first"))
    pairs = (
        held.join(first, "line").where(F.col("doc") != F.col("first"))
        .groupBy(F.col("doc.__id").alias("__id"), F.col("doc.__hash").alias("__hash"),
                 F.col("first.__id").alias("first_id"), F.col("first.__hash").alias("first_hash"))
        .agg(F.collect_set("line").alias("shared"))
    )
    later = sequences.select("__id", "__hash", F.col("lines").alias("later"),
                             F.col("sizes").alias("later_sizes"))
    earlier = sequences.select(F.col("__id").alias("first_id"), F.col("__hash").alias("first_hash"),
                               F.col("lines").alias("earlier"),
                               F.col("sizes").alias("earlier_sizes"))

    def keyed(lines: list, sizes: list, shared: set) -> list[tuple[int, int, int]]:
        return [(k, i, end) for k, i, end, _ in line_keys(lines, sizes, anchor_chars, frequent)
                if k in shared]

    @F.pandas_udf("array<int>")
    def align(a: pd.Series, a_sizes: pd.Series, b: pd.Series, b_sizes: pd.Series, shared: pd.Series
              ) -> pd.Series:
        out = []
        for *sides, z in zip(a, a_sizes, b, b_sizes, shared, strict=True):
            x, x_sizes, y, y_sizes = (side.tolist() for side in sides)
            both = set(z.tolist())
            places = {k: j for k, j, _ in reversed(keyed(y, y_sizes, both))}
            out.append(common_blocks(x, y, both, keyed(x, x_sizes, both), places))
        return pd.Series(out, dtype=object)

    removed = (
        pairs.join(later, ["__id", "__hash"]).join(earlier, ["first_id", "first_hash"])
        .select("__id", "__hash", F.explode(align(
            "later", "later_sizes", "earlier", "earlier_sizes", "shared")).alias("line"))
        .groupBy("__id", "__hash").agg(F.sort_array(F.collect_set("line")).alias("__found"))
    )
    none = F.array().cast("array<int>")
    heads = sequences.select("__id", "__hash").join(removed, ["__id", "__hash"], "left").select(
        "__id", "__hash", F.coalesce("__found", none).alias("__found"))
    blank = ~F.exists(lines, lambda x: F.trim(x) != "")
    whole = F.sequence(F.lit(0), F.size(lines) - 1)
    marked = rows.join(heads, ["__id", "__hash"], "left").withColumn(
        "__removed", F.when(F.col("__found").isNotNull(), F.col("__found"))
        .when(F.col("text").isNull() | blank, none).otherwise(whole))
    # What stays: the runs between removed lines, so that long documents are rebuilt in one pass.
    cuts = F.concat(F.array(F.lit(-1)), F.col("__removed"), F.array(F.size("__lines")))
    runs = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("__removed") + 1),
                    lambda i: F.struct((F.element_at("__cuts", i) + 2).alias("start"),
                                       (F.element_at("__cuts", i + 1) - F.element_at("__cuts", i) - 1)
                                       .alias("length"))),
        lambda r: r["length"] > 0)
    kept = F.array_join(F.flatten(F.transform(
        runs, lambda r: F.slice("__lines", r["start"], r["length"]))), "\n")
    result = F.struct(
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lines")), F.lit(0)).alias("n_lines"),
        F.size("__removed").alias("n_removed"), F.col("__removed").alias("removed"))
    new_text = F.when(F.size("__removed") == 0, F.col("text")).otherwise(kept)
    others = [c for c in docs.columns if c != into]
    return marked.withColumn("__lines", lines).withColumn("__cuts", cuts).select(
        *unpacked("row", others, **{text_col: new_text}), result.alias(into))
