"""Substring deduplication: paragraph MinHash banding, exact Jaccard, components of removals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm import textnum
from cohortwise.llm.common import bit_words, ship_package, unpacked, whole_row, written
from cohortwise.llm.links import linked_components, parity_bits, shared_buckets

LEAST_PASSAGE = 51  # words; every shared passage of so many holds a shared paragraph
PARAGRAPH = 20  # words
SHINGLE = 5
PERCENT = 80
RECALL = 0.95
BAND_ROWS = 5  # paragraphs that share a frequent line, but no more, rarely collide
FILTER_BITS = 1 << 22
_LAST = (1 << 63) - 1
_BASE = 0xBF58476D1CE4E5B9 | 1
_NATURAL = 0x94D049BB133111EB
_WORD = re.compile(r"[^ \t-\r]+")  # as in ``textnum``
_LOWERED = {c: c + 32 for c in range(65, 91)}


def least_similarity(size: int, percent: int) -> float:
    """The smallest Jaccard similarity of two sets of a size that is ``percent`` / 100 or more."""
    return min(i / (2 * size - i) for i in range(size + 1) if 100 * i >= percent * (2 * size - i))


def tune_bands(similarity: float, recall: float, rows: int = BAND_ROWS) -> int:
    """Bands of ``rows`` MinHash values that find a pair at the similarity with ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, by doubling."""
    span, best = 1, values
    while span * 2 <= width:
        best = pick(best[:-span], best[span:])
        span *= 2
    return pick(best[: len(values) - width + 1], best[width - span :][: len(values) - width + 1])


def anchors(words: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Word positions that the content alone selects, at least one in each run of ``window`` + 1
    words of a text: where a hash of two words is the least of a run that holds it."""
    if len(words) < window + 1:
        return np.zeros(0, np.int64)
    pairs = textnum.mixed(words[:-1] * np.uint64(0xA24BAED4963EE407) + words[1:]) | np.uint64(1)
    least = _sliding(pairs, window, np.minimum)
    # Runs over a text's end do not count.
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least[text[: len(least)] != text[window : window + len(least)]] = 0
    edge = np.zeros(window - 1, np.uint64)
    highest = _sliding(np.concatenate((edge, least, edge)), window, np.maximum)
    return np.flatnonzero(highest == pairs)


def natural(texts: list[bytes], starts: np.ndarray, bounds: np.ndarray, least: int, passage: int,
            shingle: int) -> np.ndarray:
    """(first word, end) of the natural paragraphs: line-feed blocks of ``least`` words or more, and
    whole texts of ``shingle`` words or more that are one block or have less than ``passage``."""
    # Texts are joined by line feeds as well, so that no block spans two.
    feeds = np.flatnonzero(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) == 10)
    edges = np.unique(np.concatenate(([0], np.searchsorted(starts, feeds))))
    blocks = np.stack((edges[:-1], edges[1:]), axis=1)
    whole = np.stack((bounds[:-1], bounds[1:]), axis=1)
    length = whole[:, 1] - whole[:, 0]
    single = np.searchsorted(edges, whole[:, 1]) - np.searchsorted(edges, whole[:, 0]) == 1
    return np.unique(np.concatenate((
        blocks[blocks[:, 1] - blocks[:, 0] >= least],
        whole[(length >= shingle) & (single | (length < passage))])), axis=0)


class Paragraphs:
    """The paragraphs of some texts: ``size`` words from each anchor that has so many left, and
    the natural paragraphs after them."""

    def __init__(self, texts: list[bytes], size: int, window: int, shingle: int):
        self.words, self.bounds, starts, ends, text_starts = textnum.located_words(texts)
        at = anchors(self.words, self.bounds, window)
        text = np.searchsorted(self.bounds, at, side="right") - 1
        whole = at + size <= self.bounds[text + 1]
        self.at, self.text, self.size, self.k = at[whole], text[whole], size, shingle
        n = max(len(self.words) - shingle + 1, 0)
        self.shingles = np.zeros(n, dtype=np.uint64)
        for j in range(shingle if n else 0):
            self.shingles = textnum.mixed(
                self.shingles * np.uint64(0xA24BAED4963EE407) + self.words[j : j + n])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
            self.words * textnum.power_table(_BASE, len(self.words)), dtype=np.uint64)))
        inverse = textnum.power_table(pow(_BASE, -1, 1 << 64), len(self.words))
        self.contents = _contents(self.words, self.bounds)
        #: A 64-bit name for the words of each paragraph.
        self.nodes = textnum.mixed((sums[self.at + size] - sums[self.at]) * inverse[self.at])
        # Each anchor's next one in its text, and a name for the words up to there.
        ahead = np.searchsorted(at, self.at, side="right")
        following = np.append(at, len(self.words))[ahead]
        self.next = np.minimum(following, self.bounds[self.text + 1])
        self.onward = textnum.mixed((sums[self.next] - sums[self.at]) * inverse[self.at]
                                    + (self.next - self.at).astype(np.uint64))
        #: So many are set by anchors; the rest are natural ones.
        self.anchored = len(self.at)
        blocks = natural(texts, starts, self.bounds, size, window + size, shingle)
        self.till = np.concatenate((self.at + size, blocks[:, 1]))
        self.at = np.concatenate((self.at, blocks[:, 0]))
        self.text = np.searchsorted(self.bounds, self.at, side="right") - 1
        names = textnum.mixed((sums[blocks[:, 1]] - sums[blocks[:, 0]]) * inverse[blocks[:, 0]]
                              + (blocks[:, 1] - blocks[:, 0]).astype(np.uint64) * np.uint64(_NATURAL))
        self.nodes = np.concatenate((self.nodes, names))
        # A natural paragraph is whole: it goes on with nothing.
        self.next = np.concatenate((self.next, blocks[:, 1]))
        self.onward = np.concatenate((self.onward, names))
        self.begin = starts[self.at] - text_starts[self.text] if len(self.at) else self.at
        self.end = ends[self.till - 1] - text_starts[self.text] if len(self.at) else self.at
        self.next_end = ends[self.next - 1] - text_starts[self.text] if len(self.at) else self.at

    def rows(self, which: np.ndarray) -> np.ndarray:
        return self.shingles[self.at[which][:, None] + np.arange(self.size - self.k + 1)]

    def shingle_set(self, i: int) -> np.ndarray:
        return np.unique(self.shingles[self.at[i] : self.till[i] - self.k + 1])

    def shingle_sets(self, which: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
        """Size, parity bits and sorted elements of some paragraphs' sets; those that anchors set and
        that repeat no shingle are worked together."""
        sizes, parities, elements = (np.empty(len(which), dtype=object) for _ in range(3))
        n = self.size - self.k + 1
        anchored = np.flatnonzero(which < self.anchored)
        rows = np.sort(self.rows(which[anchored]), axis=1)
        full = np.ones(len(anchored), dtype=bool) if n == 1 else (rows[:, 1:] != rows[:, :-1]).all(axis=1)
        together = anchored[full] if 2 * n <= 64 else anchored[:0]
        if len(together):
            rows = rows[full]
            odd = np.bitwise_xor.reduce(np.uint64(1) << (rows & np.uint64(63)), axis=1)
            sizes[together] = n
            parities[together] = _cut_up(odd, 8)
            elements[together] = _cut_up(rows, 8 * n)
        alone = np.ones(len(which), dtype=bool)
        alone[together] = False
        for i in np.flatnonzero(alone):
            x = self.shingle_set(which[i])
            sizes[i], parities[i], elements[i] = len(x), parity_bits(x), x.astype("<u8").tobytes()
        return list(sizes), list(parities), list(elements)

    def natural_hashes(self, which: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """As ``band_hashes``, for natural paragraphs, over all their shingles."""
        odd = np.random.default_rng(29).integers(1, 1 << 62, (bands, rows)).astype(np.uint64)
        odd = odd * np.uint64(2) + np.uint64(1)
        found = np.zeros((len(which), bands), dtype=np.uint64)
        if not len(which):
            return found
        # In order of their places: what ``reduceat`` takes in between is then short.
        order = np.argsort(self.at[which], kind="stable")
        # One more value than shingles, so that the last end is a place as well.
        x = np.append(self.shingles, np.uint64(0))
        places = np.stack((self.at[which], self.till[which] - self.k + 1), axis=1)[order].reshape(-1)
        for band in range(bands):
            joined = np.full(len(which), _NATURAL + band, dtype=np.uint64)
            for factor in odd[band]:
                least = np.minimum.reduceat((x * factor) >> np.uint64(20), places)[::2]
                joined = textnum.mixed(joined * np.uint64(0x9E3779B97F4A7C15) + least)
            found[order, band] = joined
        return found

    def band_hashes(self, which: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """One hash per paragraph and band: of ``rows`` minima under different scrambles."""
        odd = np.random.default_rng(23).integers(1, 1 << 62, (bands, rows)).astype(np.uint64)
        odd = odd * np.uint64(2) + np.uint64(1)
        found = np.zeros((len(which), bands), dtype=np.uint64)
        for at in range(0, len(which), 4096):
            x = self.rows(which[at : at + 4096])
            for band in range(bands):
                joined = np.full(len(x), band + 1, dtype=np.uint64)
                for factor in odd[band]:
                    least = ((x * factor) >> np.uint64(20)).min(axis=1)
                    joined = textnum.mixed(joined * np.uint64(0x9E3779B97F4A7C15) + least)
                found[at : at + 4096, band] = joined
        return found


def _cut_up(values: np.ndarray, length: int) -> list[bytes]:
    raw = values.astype("<u8").tobytes()
    return [raw[i : i + length] for i in range(0, len(raw), length)]


def _characters_before(text: bytes, at: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return starts[at]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      paragraph: int = PARAGRAPH, least_passage: int = LEAST_PASSAGE,
                      shingle: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL
                      ) -> DataFrame:
    """Find passages that repeat across documents; all but the first occurrence are to be removed.

    Passages lie anywhere, not only between line feeds, so paragraphs are set by content: ``paragraph``
    words from each anchor, with anchors so dense that any ``least_passage`` words that two
    documents share hold one paragraph they share.  Natural paragraphs are further ones: line-feed
    blocks of ``paragraph`` words or more, and whole texts of ``shingle`` words or more that are one
    block or shorter than ``least_passage``.  Each paragraph gets MinHash values of its
    ``shingle``-word shingles, banded so that a pair with a Jaccard similarity of ``percent`` / 100
    collides with probability ``recall`` (a passage of more words has several paragraphs).  Colliding
    paragraphs are verified by exact Jaccard, those without repeated shingles by their common subsets,
    which amounts to the same, and joined into components; no bucket is capped (see
    ``links.linked_components``).  In each component that spans several documents what the first
    document holds of it stays, and the others' occurrences go.  Either end of what goes is extended
    word by word, up to ``least_passage`` words, as far as the first document goes on alike.

    Returns one row per passage to remove, overlapping paragraphs merged: id, start and length
    (characters of the text), keep_id (the document in which its first paragraph stays).
    Texts that repeat nothing have no row.  A null or empty text has no paragraph, and what
    repeats within one document only is no finding.  Rows equal in id and text are one document;
    null ids come last and are told apart by their texts.  An empty table gives an empty
    result; other columns are not looked at.
    """
    window = least_passage - paragraph
    size = paragraph - shingle + 1
    bands = tune_bands(least_similarity(size, percent), recall)
    natural_bands = tune_bands(percent / 100, recall)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
                        F.col(text_col).alias("text"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], Paragraphs]]:
        for batch in batches:
            ids, row = batch.column(0).to_numpy(zero_copy_only=False), 0
            for run in textnum.chunked(textnum.as_bytes(batch.column(1))):
                yield ids[row : row + len(run)], run, Paragraphs(run, paragraph, window, shingle)
                row += len(run)

    ship_package(docs.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each paragraph once in a run of texts, with the least and the largest of the 64-bit
        names of the documents that hold it, and its buckets."""
        for ids, _, found in runs(batches):
            names = textnum.mixed(found.contents + ids.astype(np.uint64)
                                  * np.uint64(0xD6E8FEB86659FD93))
            holder = names[found.text].view(np.int64)
            order = np.lexsort((holder, found.nodes))
            nodes, first, times = np.unique(
                found.nodes[order], return_index=True, return_counts=True)
            lead, last = order[first], order[first + times - 1]
            for own, count, hashed in (
                    (lead < found.anchored, bands, found.band_hashes),
                    (lead >= found.anchored, natural_bands, found.natural_hashes)):
                hashes = hashed(lead[own], count, BAND_ROWS)
                ends = np.arange(own.sum() + 1, dtype=np.int32) * count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[own].view(np.int64)), pa.array(holder[lead[own]]),
                     pa.array(holder[last[own]]),
                     pa.ListArray.from_arrays(pa.array(ends),
                                              pa.array(hashes.reshape(-1).view(np.int64)))],
                    names=["node", "one", "other", "buckets"])

    posted = texts.mapInArrow(post, "node long, one long, other long, buckets array<long>").select(
        "node", "one", "other", F.explode("buckets").alias("bucket"))
    # A bucket matters if two documents meet in it.  Its rows pass by in order; none is gathered.
    in_bucket = Window.partitionBy("bucket")
    least = F.min("one").over(in_bucket)
    most = F.max("other").over(in_bucket)
    shared = written(
        posted.withColumn("least", least).withColumn("most", most).where("least < most")
        .select("bucket", "node"))
    live = shared_buckets(shared.select("bucket", "node", F.lit(size).alias("size"),
                                       F.lit(size).alias("left")))

    def bit_mask(nodes: DataFrame) -> np.ndarray:
        mask = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        part = bit_words(nodes, F.col("node"), FILTER_BITS).toPandas()
        mask[part["word"].to_numpy(np.int64)] = part["mask"].to_numpy(np.int64).view(np.uint64)
        return mask

    def chosen(mask: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        bit = nodes.view(np.int64) % FILTER_BITS
        return np.flatnonzero(mask[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))

    # The texts are read again for the places of paragraphs in shared buckets.
    held = shared.select("node").distinct()
    held_mask = bit_mask(held)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, run, found in runs(batches):
            which = chosen(held_mask, found.nodes)
            begin, end, reach = np.zeros((3, len(which)), np.int64)
            for t in np.unique(found.text[which]):
                own = np.flatnonzero(found.text[which] == t)
                for values, at in ((begin, found.begin), (end, found.end), (reach, found.next_end)):
                    values[own] = _characters_before(run[t], at[which[own]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found.text[which]], pa.int64()),
                 pa.array(found.contents[found.text[which]].view(np.int64)),
                 pa.array(begin), pa.array(end), pa.array(np.maximum(end, reach)),
                 pa.array(found.onward[which].view(np.int64)),
                 pa.array(found.nodes[which].view(np.int64))],
                names=["id", "content", "start", "stop", "reach", "onward", "node"])

    placed = written(texts.mapInArrow(
        place, "id long, content long, start long, stop long, reach long, onward long, node long"
    ).join(held, "node"))

    # And for the sets of those that share a bucket with others than themselves.
    alive = live.select("node").distinct()
    alive_mask = bit_mask(alive)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found in runs(batches):
            which = chosen(alive_mask, found.nodes)
            which = which[np.unique(found.nodes[which], return_index=True)[1]]
            sizes, parities, elements = found.shingle_sets(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.nodes[which].view(np.int64)), pa.array(sizes, pa.int32()),
                 pa.array(parities, pa.binary()), pa.array(elements, pa.binary())],
                names=["node", "size", "parity", "elements"])

    sets = written(
        texts.mapInArrow(gather, "node long, size int, parity binary, elements binary")
        .join(alive, "node").dropDuplicates(["node"]))

    # Sets without repeated shingles have one size.  Two of them are alike exactly if they have a
    # common subset of the size that the similarity asks for, so links among them come from equal
    # subsets, each hung on the first set that has it, and no pairs are made.
    common = -(-2 * percent * size // (100 + percent))

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left_out = np.array(list(combinations(range(size), size - common)), dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = np.frombuffer(b"".join(part["elements"]), "<u8").reshape(len(part), size)
                scrambled = textnum.mixed(x ^ np.uint64(0x5851F42D4C957F2D))
                sums = scrambled.sum(axis=1, dtype=np.uint64)[:, None] - scrambled[:, left_out].sum(
                    axis=2, dtype=np.uint64)
                yield pd.DataFrame({
                    "node": np.repeat(part["node"].to_numpy(), len(left_out)),
                    "subset": textnum.mixed(sums).reshape(-1).view(np.int64)})

    having = sets.where(F.col("size") == size).select("node", "elements").mapInPandas(
        subsets, "node long, subset long")
    links = having.withColumn("b", F.min("node").over(Window.partitionBy("subset"))).where(
        "node != b").select(F.col("node").alias("a"), "b").distinct()
    sized = written(live.select("bucket", "node").join(sets.select("node", "size"), "node")
                    .select("bucket", "node", "size", F.col("size").alias("left")))
    part_of = linked_components(
        sized, sets.select("node", "size", "parity"), lambda nodes: sets.select("node", "elements"),
        percent, links=links, decided=size)

    occurrences = placed.select(
        "id", "content", "start", "stop", "reach", "onward", "node"
    ).join(part_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    document = F.struct("id", "content")
    components = occurrences.groupBy("component").agg(
        F.min(document).alias("first"), F.max(document).alias("last")).where("first != last")
    held = occurrences.join(components.select("component", "first"), "component")
    onwards = held.where(document == F.col("first")).select(
        "component", "onward", F.lit(True).alias("goes_on")).distinct()
    gone = held.where(document != F.col("first")).join(
        onwards, ["component", "onward"], "left").select(
        "id", "content", "start",
        # Where the words up to the next anchor are those of the first document, they go as well.
        F.when(F.col("goes_on"), F.col("reach")).otherwise(F.col("stop")).alias("stop"),
        F.col("first.id").alias("keep_id"), F.col("stop").alias("end"), "component")
    in_order = Window.partitionBy("id", "content").orderBy("start", "stop", "keep_id")
    reach = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))

    def merged(spans: DataFrame, *more: Column) -> DataFrame:
        """Overlapping or touching spans of a document as one passage."""
        islands = spans.withColumn(
            "island", F.sum(F.when(F.col("start") > reach + 1, 1).otherwise(0)).over(in_order))
        return islands.groupBy("id", "content", "island").agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"),
            F.min_by("keep_id", F.struct("start", "keep_id")).alias("keep_id"), *more)

    found = written(merged(
        gone, F.min(F.struct(F.col("start").alias("at"), "component")).alias("left"),
        F.max(F.struct(F.col("end").alias("at"), "component")).alias("right")))
    # Either end of a passage is compared word by word with one place in the first document.
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}.at").alias("at"),
                                         F.col(f"{side}.component").alias("component"))
                                for side in ("left", "right")]))
    ends = found.select("id", "content", "island", sides.alias("e")).select(
        "id", "content", "island", "e.*")
    firsts = held.where(document == F.col("first")).groupBy("component").agg(
        F.min(F.struct("start", "stop", "id", "content")).alias("f"))
    kept_ends = written(firsts.select("component", "f.*").withColumn("side", F.explode(
        F.array(F.lit("left"), F.lit("right")))).withColumn(
        "at", F.when(F.col("side") == "left", F.col("start")).otherwise(F.col("stop")))
        .join(ends.select("component", "side").distinct(), ["component", "side"], "left_semi")
        .select("component", "side", "id", "content", "at"))
    place_key = ["id", "content", "side", "at"]
    wanted = ends.select(*place_key).unionByName(kept_ends.select(*place_key)).distinct().groupBy(
        "id", "content").agg(F.collect_list(F.struct("side", "at")).alias("places"))
    wanted = written(wanted)
    wanted_mask = bit_mask(wanted.select(F.col("content").alias("node")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column(0).to_numpy(zero_copy_only=False), 0
            for run in textnum.chunked(textnum.as_bytes(batch.column(1))):
                contents = _contents(*textnum.word_hashes(run))
                which = chosen(wanted_mask, contents)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + which], pa.int64()), pa.array(contents[which].view(np.int64)),
                     pa.array([run[i].decode() for i in which], pa.string())],
                    names=["id", "content", "text"])
                row += len(run)

    @F.pandas_udf("array<struct<side:string,at:long,words:string>>")
    def around(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([[{"side": p["side"], "at": p["at"],
                            "words": _next_words(t, int(p["at"]), p["side"], least_passage)}
                           for p in some] for t, some in zip(text, places, strict=True)], dtype=object)

    near = written(
        texts.mapInArrow(pick, "id long, content long, text string").join(wanted, ["id", "content"])
        .select("id", "content", F.explode(around("text", "places")).alias("p"))
        .select("id", "content", "p.*").dropDuplicates(place_key))

    @F.pandas_udf("long")
    def equal_part(side: pd.Series, own: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([_equal_part(x, y, z) for x, y, z in zip(side, own, other, strict=True)],
                         dtype="int64")

    kept_words = kept_ends.join(near, place_key).select(
        "component", "side", F.col("words").alias("other"))
    more = ends.join(near, place_key).join(kept_words, ["component", "side"]).select(
        "id", "content", "island", "side", equal_part("side", "words", "other").alias("more"), "at")
    more = more.groupBy("id", "content", "island").agg(
        F.max(F.when(F.col("side") == "left", F.col("at") - F.col("more"))).alias("from"),
        F.max(F.when(F.col("side") == "right", F.col("at") + F.col("more"))).alias("to"))
    passages = merged(found.join(more, ["id", "content", "island"], "left").select(
        "id", "content", F.least("start", "from").alias("start"),
        F.greatest("stop", "to").alias("stop"), "keep_id"))

    def known(c: str):
        return F.when(F.col(c) != _LAST, F.col(c))

    return passages.select(known("id").alias(id_col), "start",
                           (F.col("stop") - F.col("start")).alias("length"),
                           known("keep_id").alias("keep_id"))


def _next_words(text: str, at: int, side: str, words: int) -> str:
    """The text of at most so many words before (left) or after (right) a place in ``text``."""
    reach = 16 * words
    while True:
        part = text[max(at - reach, 0) : at] if side == "left" else text[at : at + reach]
        spans = [m.span() for m in _WORD.finditer(part)]
        # The word at the part's far end may be cut, so it counts only where the text ends.
        if len(spans) > words or reach >= len(text):
            break
        reach *= 4
    if len(spans) > words:
        part = part[spans[-words][0] :] if side == "left" else part[: spans[words - 1][1]]
    return part


def _equal_part(side: str, own: str, other: str) -> int:
    """How many characters next to the place the equal words of both take, in ``own``."""
    a, b = ([m for m in _WORD.finditer(x.translate(_LOWERED))] for x in (own, other))
    if side == "left":
        a, b = a[::-1], b[::-1]
    far = 0
    for x, y in zip(a, b):
        if x.group() != y.group():
            break
        far = len(own) - x.start() if side == "left" else x.end()
    return far


def _contents(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name for all words of each text."""
    powers = textnum.power_table(_BASE, int(np.diff(bounds).max(initial=0)))
    return np.array([_sequence_hash(words[b:e], powers) for b, e in zip(
        bounds[:-1], bounds[1:], strict=True)], dtype=np.uint64)


def _sequence_hash(words: np.ndarray, powers: np.ndarray) -> int:
    return int((words * powers[: len(words)]).sum(dtype=np.uint64)) ^ len(words)


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of their texts; ids must tell documents apart.

    What lies between two passages stays as it is.  Texts without passages, null texts
    and rows with a null id stay as they are.
    """
    cuts = passages.groupBy(F.col(id_col).alias("__id")).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__cuts"))
    kept = F.concat(
        F.array_join(F.transform("__cuts", lambda c, i: F.substr(
            F.col("text"), _end_of(i - 1) + 1, (c["start"] - _end_of(i - 1)).cast("int"))), ""),
        F.substr(F.col("text"), _end_of(F.size("__cuts") - 1) + 1))
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("__doc"),
                       F.col(text_col).alias("text"))
    new_text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(kept)
    return rows.join(cuts, F.col("__doc") == F.col("__id"), "left").select(
        *unpacked("row", docs.columns, **{text_col: new_text}))


def _end_of(i):
    """Characters up to the end of the i-th cut; 0 before the first."""
    cut = F.get("__cuts", i)
    return F.coalesce(cut["start"] + cut["length"], F.lit(0)).cast("int")
