"""Periodic runs: stretches of words that repeat, found in tiles of each period octave and stitched."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm.common import ship_package, written
from cohortwise.llm.textnum import as_bytes

EXPONENT = 4
LEAST_LENGTH = 6
TILE_WORDS = 1_024
CHUNK_WORDS = 500_000
CHUNK_TEXTS = 10_000
PROBES = 32
#: Cuts of an octave lie 2 * 2^j words apart, and a tile reaches 8 * 2^j words beyond its cuts: as long as
#: the longest stretch (EXPONENT periods below 2 * 2^j) that must be seen whole.
CUT, REACH = 2, 2 * EXPONENT

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_EVEN = bytes.maketrans(_SPACES, b" " * len(_SPACES))
RUN = "array<struct<start:long,length:long,period:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_EVEN).split()


def z_function(s: list[int], most: int) -> list[int]:
    """z[i]: how many items s[i:] has in common with s from their beginnings; for i < ``most``."""
    z = [len(s)] + [0] * (min(most, len(s)) - 1)
    left = right = 0
    n = len(s)
    for i in range(1, len(z)):
        at = min(right - i, z[i - left]) if i < right else 0
        while i + at < n and s[at] == s[i + at]:
            at += 1
        z[i] = at
        if i + at > right:
            left, right = i, i + at
    return z


def hopeful_cuts(x: np.ndarray, start: np.ndarray, length: np.ndarray, octave: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Texts and cuts (places in the text) from which the words of some period q of the octave come again.

    ``x`` holds the words of all texts.  Cuts stand at every CUT * 2^j-th word.  A run is at least
    max(6, 4 q) words long, so from the first cut in it as many words less q, and less those before
    the cut, equal the words a period later.  Up to PROBES of them are compared here.
    """
    base = 1 << octave
    period = np.arange(base, 2 * base)
    need = np.maximum(LEAST_LENGTH, EXPONENT * period) - period - (CUT * base - 1)
    texts = np.flatnonzero(length >= max(LEAST_LENGTH, EXPONENT * base))
    n_cuts = (length[texts] - 2 * base) // (CUT * base) + 1
    text = np.repeat(texts, n_cuts)
    cut = (np.arange(len(text)) - np.repeat(np.cumsum(n_cuts) - n_cuts, n_cuts)) * CUT * base
    found, end = [], len(x) - 1
    for lo in range(0, len(text), max(1, (1 << 20) // base)):
        part = slice(lo, lo + max(1, (1 << 20) // base))
        here = (start[text[part]] + cut[part])[:, None]
        room = (length[text[part]] - cut[part])[:, None]
        row, column = np.nonzero((period + need <= room) & (
            EXPONENT * period <= length[text[part]][:, None])
            & (x[here] == x[np.minimum(here + period, end)]))
        a = here[row, 0]
        for t in range(1, min(PROBES, int(need.max()))):
            if not len(row):
                break
            q = period[column]
            same = (x[np.minimum(a + t, end)] == x[np.minimum(a + q + t, end)]) | (t >= need[column])
            row, column, a = row[same], column[same], a[same]
        found.append(lo + np.unique(row))
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return text[at], cut[at]


def tile_fragments(words: list[int], cuts: list[int], octave: int) -> dict[int, list[list[int]]]:
    """For each period of the octave the stretches of that period around the cuts, joined where they overlap.

    Two Z-functions say for all periods at once how far the words after a cut agree with those a
    period later, and how far the words before it do.  Stretches end at REACH * 2^j words from a cut; those of
    EXPONENT periods or more are kept.
    """
    base = 1 << octave
    reach, found = REACH * base, {}
    for c in cuts:
        lo, hi = max(0, c - reach), min(len(words), c + reach)
        ahead = z_function(words[c:hi], 2 * base)
        before = words[lo:c][::-1]
        back = [*before, -1, *words[lo : min(len(words), c + 2 * base)][::-1]]
        behind = z_function(back, len(back))
        end = len(before) + 1 + min(len(words), c + 2 * base) - c
        for q in range(base, min(2 * base, len(ahead))):
            before_c = behind[end - q] if end - q > len(before) else 0
            first, last = c - before_c, c + q + ahead[q]
            if last - first >= max(LEAST_LENGTH, EXPONENT * q):
                own = found.setdefault(q, [])
                if own and first <= own[-1][1] - q:
                    own[-1][1] = max(own[-1][1], last)
                else:
                    own.append([first, last])
    return found


class _Chunk:
    """Some texts of a task, their words numbered."""

    def __init__(self) -> None:
        self.keys, self.words = [], []
        self.n = 0

    def add(self, key: tuple, words: list[bytes]) -> None:
        self.keys.append(key)
        self.words.append(words)
        self.n += len(words)

    def tiles(self) -> tuple[set[int], list[tuple]]:
        """Texts with hopeful cuts, and (text, octave, start, bytes a word, words, cuts) of their tiles."""
        number = defaultdict(count().__next__)
        x = np.fromiter((number[w] for words in self.words for w in words), np.int32, self.n)
        length = np.array([len(w) for w in self.words])
        start = np.cumsum(length) - length
        found = []
        octave = 0
        while EXPONENT << octave <= length.max(initial=0):
            base = 1 << octave
            span = max(TILE_WORDS, 16 * base)
            text, cut = hopeful_cuts(x, start, length, octave)
            tile = cut // span
            edges = np.flatnonzero(np.diff(text * (length.max() + 1) + tile, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                i, cuts = int(text[lo]), cut[lo:hi]
                first = max(0, int(cuts[0]) - REACH * base)
                last = min(int(length[i]), int(cuts[-1]) + REACH * base)
                kinds, own = np.unique(x[start[i] + first : start[i] + last], return_inverse=True)
                width = np.min_scalar_type(len(kinds)).itemsize
                found.append((i, octave, first, width, own.astype(f"<u{width}").tobytes(),
                              (cuts - first).astype(np.int32).tobytes()))
            octave += 1
        return {t[0] for t in found}, found


def _collapsed(words: list[bytes], runs: list[dict] | None) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    dropped = np.cumsum(edge)[:-1] > 0
    return b" ".join([words[i] for i in np.flatnonzero(~dropped)])


def _shown(text: bytes, digest: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _tiled(texts: DataFrame, digest: bool) -> DataFrame:
    """Rows of three kinds: a text without hopeful cuts is done, another has its words and its tiles."""
    names = ["key", "id", "kind", "n", "text", "octave", "first", "width", "words",
             "cuts"]
    id_type = texts.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(chunk: _Chunk) -> pa.RecordBatch:
            open_, tiles = chunk.tiles()
            out = [(*key, "open" if i in open_ else "done", len(w),
                    b" ".join(w).decode() if i in open_ else _shown(b" ".join(w), digest),
                    None, None, None, None, None)
                   for i, (key, w) in enumerate(zip(chunk.keys, chunk.words, strict=True))]
            out += [(chunk.keys[i][0], None, "tile", None, None, *rest) for i, *rest in tiles]
            kinds = [pa.int64(), id_kind, pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(),
                     pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                names=names)

        chunk, id_kind = _Chunk(), None
        for batch in batches:
            id_kind = batch.schema.field(1).type
            for key, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       as_bytes(batch.column(2)), strict=True):
                chunk.add((key, name), words_of(text))
                if chunk.n >= CHUNK_WORDS or len(chunk.keys) >= CHUNK_TEXTS:
                    yield rows(chunk)
                    chunk = _Chunk()
        if chunk.keys:
            yield rows(chunk)

    return texts.mapInArrow(
        split, f"key long, id {id_type}, kind string, n long, text string, octave int, first long, "
               "width int, words binary, cuts binary")


def _fragments(tiles: DataFrame) -> DataFrame:
    """Rows (key, period, start, end) of the stretches found in each tile."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, octave, first, width, words, cuts in zip(
                    *[batch.column(i).to_pylist() for i in range(6)], strict=True):
                found = tile_fragments(np.frombuffer(words, f"<u{width}").tolist(),
                                       np.frombuffer(cuts, np.int32).tolist(), octave)
                out += [(key, q, first + a, first + b) for q, own in found.items() for a, b in own]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    names=["key", "period", "start", "end"])

    # Few bytes are much work here: a number of tasks that isn't reduced by size.
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select("key", "octave", "first", "width", "words", "cuts").repartition(
        tasks, "key", "octave", "first")
    return dealt.mapInArrow(solve, "key long, period long, start long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """One row (key, start, length, period) for each run.

    Stretches of one period belong together where they share a period's length.  Whole stretches of several
    periods that begin and end alike have the smallest as their period.
    """
    own = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True))
    return (
        fragments.withColumn("fresh", fresh.cast("int"))
        .withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("key", "start", "end").agg(F.min("period").alias("period"))
        .select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")
    )


def _without_repetitions(texts: DataFrame, digest: bool) -> DataFrame:
    """Rows (id, n_words, words as one text, runs or null) with what is left of the text."""
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_shown(_collapsed(text.split(b" "), runs), digest) for text, runs in zip(
                as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(left, pa.string())],
                names=["id", "n_words", "runs", "collapsed"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(collapse, f"id {id_type}, n_words long, runs {RUN}, collapsed string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  digest: bool = False) -> DataFrame:
    """Find the runs of every whole text, and the text without their repetitions.

    A run is a stretch of words with smallest period q, at least max(6, 4 q) words long, that no word at
    either side extends.  Words are runs of characters other than space and 0x09 to 0x0D.

    For each octave of periods a text is cut into overlapping tiles as long as the octave asks for.  A tile holds
    cuts, and a run has a cut at the head of two of its periods.  Tiles where no two periods are alike from
    any cut end there, without leaving their task; the others are dealt out by text, octave and place, so that
    many tasks work on a very long text.  Z-functions at a cut give the stretches of all periods of the octave in
    linear time.  Stretches are shuffled by text and period, stitched into runs, and meet the words again
    of those texts alone that had a tile to solve.

    Returns one row per row: id, n_words, runs (an array of start, length, period, by start, then period; empty if
    none) and collapsed: the words that no run holds after its first period, joined by one space, or with
    ``digest`` the SHA-256 of that in lowercase hex.  A null, empty or blank text has no words and an empty
    collapsed text.  Repeated rows and null ids are rows of their own, each with its runs.  Other columns are
    not read, whatever their names.  An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tiled = written(_tiled(texts, digest))
    runs = stitched(_fragments(tiled.where("kind = 'tile'"))).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    done = tiled.where("kind = 'done'").select(
        "id", F.col("n").alias("n_words"), F.array().cast(RUN).alias("runs"),
        F.col("text").alias("collapsed"))
    open_ = tiled.where("kind = 'open'").join(runs, "key", "left").select(
        "id", F.col("n").alias("n_words"), "text", F.coalesce("runs", F.array().cast(RUN)).alias("runs"))
    return done.unionByName(_without_repetitions(open_, digest)).withColumnRenamed("id", id_col)
