"""Collocations: phrases whose words meet more often than chance, mined by partitions (SON)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm.common import bit_words, ship_package, written
from cohortwise.llm.textnum import as_bytes, mixed, word_hashes

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
CLOSED_PERCENT = 100
SHARD_WORDS = 4_000_000
HELD_WORDS = 6_000_000
BUCKET_WORDS, FEWEST_BUCKETS = 1 << 19, 64
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bits of a hash that candidates are named by; what shares them is counted together and told apart at the end.
NAME_BITS = 40
#: Where in a name its bits in a filter are read: a phrase that isn't a candidate has to meet three set ones.
PROBES = (0, 6, 12)

#: A-Z to a-z, a tab to a space, and what ends a piece to a byte that UTF-8 never holds.
_BREAK = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r",
                        b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)
_STEP = np.uint64(0xA24BAED4963EE407)


class Shard:
    """The words of one language, numbered as they come; 0 ends a piece."""

    def __init__(self, lang: str, total: int | None) -> None:
        self.lang, self.total, self.words = lang, total, 0
        self._number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self._number[_BREAK]
        self._runs: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        tokens = text.translate(_FOLD).replace(_BREAK, b" \xff ").split()
        run = np.fromiter(map(self._number.__getitem__, tokens), np.int32, len(tokens))
        self.words += int(np.count_nonzero(run))
        self._runs += [run, np.zeros(1, np.int32)]

    def buckets(self, fewest: int) -> int:
        """Into how many hash ranges this language is dealt (a power of two)."""
        while fewest * BUCKET_WORDS < self.total:
            fewest *= 2
        return fewest

    def ids(self) -> np.ndarray:
        return np.concatenate([*self._runs, np.zeros(MAX_WORDS, np.int32)])

    def vocabulary(self) -> tuple[list[bytes], np.ndarray]:
        """All words by number, and their hashes, which depend on the language."""
        words = list(self._number)
        return words, np.concatenate([np.zeros(1, np.uint64), hashes_of(self.lang, words[1:])])


def hashes_of(lang: str, words: list[bytes]) -> np.ndarray:
    seed = mixed(word_hashes([b"l" + lang.encode().hex().encode()])[0])
    return mixed(word_hashes([b" ".join(words)])[0] ^ seed)


def names_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - NAME_BITS)


def buckets_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (names >> np.uint64(NAME_BITS - buckets.bit_length() + 1)).astype(np.int64)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned values, the low seven bits first, and where each one's bytes end."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        longer = values >> np.uint64(bits) > 0
        if not longer.any():
            break
        sizes += longer
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for j in range(sizes.max(initial=0)):
        has = np.flatnonzero(sizes > j)
        more = (sizes[has] > j + 1).astype(np.uint8) << 7
        out[(ends - sizes)[has] + j] = (values[has] >> np.uint64(7 * j)).astype(np.uint8) & 127 | more
    return out, ends


def from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    values = (data[starts] & 127).astype(np.uint64)
    for j in range(1, (ends - starts).max(initial=0) + 1):
        has = np.flatnonzero(ends - starts >= j)
        values[has] |= (data[starts[has] + j] & 127).astype(np.uint64) << np.uint64(7 * j)
    return values


def packed_blocks(names: np.ndarray, excess: np.ndarray, edges: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Ascending names and their excess in a block for each two edges: the first name in 8 bytes, then steps."""
    steps, step_ends = varints(np.diff(names, prepend=names[:1]))
    beyond, beyond_ends = varints(excess)
    step_ends, beyond_ends = [np.concatenate([np.zeros(1, np.int64), x]) for x in (step_ends, beyond_ends)]
    heads = names.astype("<u8")
    return ([heads[lo : lo + 1].tobytes() + steps[step_ends[lo + 1] : step_ends[hi]].tobytes()
             for lo, hi in zip(edges[:-1], edges[1:], strict=True)],
            [beyond[beyond_ends[lo] : beyond_ends[hi]].tobytes()
             for lo, hi in zip(edges[:-1], edges[1:], strict=True)])


def unpacked_blocks(hashes: list[bytes], excess: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The names and the excess of several blocks, block by block."""
    beyond = from_varints(np.frombuffer(b"".join(excess), np.uint8)).astype(np.int64)
    # A block's first step is a byte of nothing, so that there are as many steps as names.
    steps = np.frombuffer(b"".join([b"\0" + h[8:] for h in hashes]), np.uint8)
    sums = np.cumsum(from_varints(steps))
    begins = np.cumsum([0, *(len(h) - 7 for h in hashes[:-1])])
    first = np.cumsum(steps < 128)[begins] - 1
    heads = np.frombuffer(b"".join([h[:8] for h in hashes]), "<u8")
    return np.repeat(heads - sums[first], np.diff(first, append=len(sums))) + sums, beyond


def shards(batches: Iterator[pa.RecordBatch], shard_words: int, held_words: int) -> Iterator[Shard]:
    """The texts of a task as shards of one language each.

    A shard ends once it holds ``shard_words`` words; if all open ones hold ``held_words``, the largest ends.
    """
    open_: dict[str, Shard] = {}
    held = 0
    for batch in batches:
        totals = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for lang, text, total in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), totals,
                                     strict=True):
            shard = open_.get(lang) or open_.setdefault(lang, Shard(lang, total))
            before = shard.words
            shard.add(text)
            held += shard.words - before
            if shard.words < shard_words and held >= held_words:
                shard = max(open_.values(), key=lambda s: s.words)
            if shard.words >= shard_words or held >= held_words:
                held -= open_.pop(shard.lang).words
                yield shard
    yield from open_.values()


Keep = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def frequent_phrases(ids: np.ndarray, hashes: np.ndarray, single: np.ndarray, most_words: int,
                     keep: Keep) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level, the phrases that ``keep`` (of number of words, hashes and counts) lets through.

    ``single`` says which words may be in a phrase at all.  Yields the number of words, first place, count and hash of each.  A phrase is looked at only where the
    phrases without its last and without its first word have been let through.
    """
    good = single.copy()
    good[0] = False
    here = np.where(good[ids], ids, -1).astype(np.int64)
    level = hashes
    for k in range(2, most_words + 1):
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        if not len(at):
            return
        phrase, _ = pd.factorize(here[at] * len(level) + here[at + 1])
        counts = np.bincount(phrase)
        first = np.empty(len(counts), np.int64)
        first[phrase[::-1]] = at[::-1]
        level = mixed(level[here[first]] * _STEP + hashes[ids[first + k - 1]])
        good = keep(k, level, counts)
        yield k, first[good], counts[good], level[good]
        here = np.full(len(ids), -1, np.int64)
        number = np.where(good, np.arange(len(good)), -1)
        here[at] = number[phrase]


def word_counts(docs: DataFrame, shard_words: int, held_words: int) -> DataFrame:
    """Occurrences of each word: lang, word, n."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words, held_words):
            words, _ = shard.vocabulary()
            n = np.bincount(shard.ids(), minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.lang] * (len(words) - 1), pa.string()),
                 pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(n[1:], pa.int64())],
                names=["lang", "word", "n"])

    return docs.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def word_names(words: DataFrame) -> DataFrame:
    """The names of words (lang, word) as shards know them: hash."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: defaultdict[str, list[bytes]] = defaultdict(list)
            for lang, word in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                by_lang[lang].append(word)
            for lang, own in by_lang.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names_of(hashes_of(lang, own)).astype(np.int64))], names=["hash"])

    return words.select("lang", "word").mapInArrow(named, "hash long")


def locally_frequent(docs: DataFrame, min_count: int, most_words: int, shard_words: int,
                     held_words: int, buckets: int, known: Sequence[Broadcast] = ()) -> DataFrame:
    """What is frequent in some shard: lang, bucket, hashes, excess (both packed), missed, buckets.

    A shard with the share s of its language's words asks for t = ceil(min_count * s) occurrences; excess is what
    a phrase has beyond t - 1.  ``known`` has filters of the words, then of the pairs, ..., that may be frequent
    in all: only phrases made of those are looked at, and only those longer than the last are given.
    Names of phrases are dealt by their leading bits to ``buckets`` (a power of two), or more for a language of
    many words; a shard writes one row for each that it has any of.  A row without a bucket has t - 1 as missed
    and the number of buckets.
    """
    names = ["lang", "bucket", "hashes", "excess", "missed", "buckets"]

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words, held_words):
            if not shard.words:
                continue
            dealt = shard.buckets(buckets)
            least = -(-min_count * shard.words // shard.total)
            ids, (words, hashes) = shard.ids(), shard.vocabulary()
            single = np.bincount(ids, minlength=len(words)) >= least
            if known:
                single &= in_filter(known[0].value, names_of(hashes))

            def keep(k: int, level: np.ndarray, n: np.ndarray, least: int = least) -> np.ndarray:
                good = n >= least
                if k <= len(known):
                    good[good] = in_filter(known[k - 1].value, names_of(level[good]))
                return good

            found = [(names_of(level), counts - (least - 1)) for k, _, counts, level in frequent_phrases(
                ids, hashes, single, most_words, keep) if k > len(known)]
            level = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in found]])
            excess = np.concatenate([np.zeros(0, np.int64), *[x for _, x in found]])
            del found, ids, words, hashes
            order = np.argsort(level)
            level, excess = level[order], excess[order]
            bucket = buckets_of(level, dealt)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            packed = packed_blocks(level, excess, edges)
            none = [None] * len(packed[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.lang] * (len(none) + 1), pa.string()),
                 pa.array([*bucket[edges[:-1]].tolist(), None], pa.int64()),
                 pa.array([*packed[0], None], pa.binary()), pa.array([*packed[1], None], pa.binary()),
                 pa.array([*none, least - 1], pa.int64()), pa.array([*none, dealt], pa.int64())], names=names)

    return docs.mapInArrow(
        mine, "lang string, bucket long, hashes binary, excess binary, missed long, buckets long")


def united(local: DataFrame, min_count: int) -> DataFrame:
    """The names of all phrases whose count may reach ``min_count``, for all that single shards know.

    A phrase has in a shard the count given, or t - 1 at most.  A task unites one bucket at a time, to which
    every shard that may miss any (fewer than ``min_count`` of a language) sends how many.  ``local`` is read once.
    """
    every = F.explode(F.when(F.col("bucket").isNotNull(), F.array("bucket")).when(
        F.col("missed") > 0, F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    blocks = local.select(every.alias("bucket"), "lang", "hashes", "excess", "missed")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            level, excess = unpacked_blocks([h for h, _ in held], [e for _, e in held])
            order = np.argsort(level, kind="stable")
            level, excess = level[order], excess[order]
            first = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
            hopeful = np.add.reduceat(excess, first) + floor >= min_count
            return pa.RecordBatch.from_arrays([pa.array(level[first][hopeful].astype(np.int64))], names=["hash"])

        own, held, floor = None, [], 0
        for batch in batches:
            for bucket, lang, hashes, excess, missed in zip(
                    *[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if own != (bucket, lang):
                    if held:
                        yield done()
                    own, held, floor = (bucket, lang), [], 0
                if hashes is None:
                    floor += missed
                else:
                    held.append((hashes, excess))
        if held:
            yield done()

    return blocks.repartition("bucket", "lang").sortWithinPartitions("bucket", "lang").mapInArrow(
        unite, "hash long")


def filter_of(candidates: DataFrame) -> np.ndarray:
    """A bit filter over the names in ``hash``: 16 bits a candidate, ``MOST_BITS`` (32 MB) at most."""
    bits = FEWEST_BITS
    n = candidates.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    read = candidates.select(F.explode(F.array(*[F.shiftright("hash", by) for by in PROBES])).alias("hash"))
    table = bit_words(read, F.col("hash"), bits).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[table["word"].to_numpy()] = table["mask"].to_numpy()
    return words.view(np.uint64)


def in_filter(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    inside = np.arange(len(names))
    for by in PROBES:
        bucket = names[inside] >> np.uint64(by) & np.uint64(len(words) * 64 - 1)
        inside = inside[(words[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63))
                         & np.uint64(1)).astype(bool)]
    out = np.zeros(len(names), bool)
    out[inside] = True
    return out


def candidate_counts(docs: DataFrame, known: Sequence[Broadcast], min_count: int, most_words: int,
                     shard_words: int, held_words: int, buckets: int) -> DataFrame:
    """The phrases that occur ``min_count`` times or more in all texts: lang, phrase, k, a.

    ``known`` has the filters of words, of pairs, ..., the last for all longer phrases.  A filter may let others
    through as well; they are counted as fully.  A shard writes its phrases (by line ends, which none holds) and
    their counts in blocks of the buckets that mining has; a task adds up one bucket at a time.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x.value for x in known]
        for shard in shards(batches, shard_words, held_words):
            if not shard.words:
                continue
            words, hashes = shard.vocabulary()
            ids = shard.ids()
            found = [(first, n, np.full(len(n), k), buckets_of(names_of(level), shard.buckets(buckets)))
                     for k, first, n, level in frequent_phrases(
                ids, hashes, in_filter(held[0], names_of(hashes)), most_words,
                lambda k, level, _: in_filter(held[min(k, len(held)) - 1], names_of(level)))]
            if not found:
                continue
            first, n, size, bucket = [np.concatenate(x) for x in zip(*found, strict=True)]
            order = np.argsort(bucket, kind="stable")
            for at in range(0, len(order), 1 << 16):
                own = order[at : at + (1 << 16)]
                places = np.minimum(first[own, None] + np.arange(most_words), len(ids) - 1)
                phrases = [b" ".join([words[i] for i in p[:k]])
                           for p, k in zip(ids[places].tolist(), size[own].tolist(), strict=True)]
                data, ends = varints(n[own])
                ends = np.concatenate([np.zeros(1, np.int64), ends])
                edges = np.flatnonzero(np.diff(bucket[own], prepend=-1, append=-1))
                cuts = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.lang] * len(cuts), pa.string()), pa.array(bucket[own][edges[:-1]], pa.int64()),
                     pa.array([b"\n".join(phrases[lo:hi]) for lo, hi in cuts], pa.binary()),
                     pa.array([data[ends[lo] : ends[hi]].tobytes() for lo, hi in cuts], pa.binary())],
                    names=["lang", "bucket", "phrases", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            kept = [(p, a) for p, a in total.items() if a >= min_count]
            return pa.RecordBatch.from_arrays(
                [pa.array([own[1]] * len(kept), pa.string()),
                 pa.array([p for p, _ in kept], pa.binary()).cast(pa.string()),
                 pa.array([p.count(b" ") + 1 for p, _ in kept], pa.int32()),
                 pa.array([a for _, a in kept], pa.int64())], names=["lang", "phrase", "k", "a"])

        own, total = None, defaultdict(int)
        for batch in batches:
            for lang, bucket, phrases, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != (bucket, lang):
                    if own:
                        yield done()
                    own, total = (bucket, lang), defaultdict(int)
                for phrase, n in zip(phrases.split(b"\n"), from_varints(np.frombuffer(counts, np.uint8)).tolist(),
                                     strict=True):
                    total[phrase] += n
        if own:
            yield done()

    blocks = docs.mapInArrow(tally, "lang string, bucket long, phrases binary, counts binary")
    return blocks.repartition("bucket", "lang").sortWithinPartitions("bucket", "lang").mapInArrow(
        add_up, "lang string, phrase string, k int, a long")


def scored_cuts(counted: DataFrame, freq: DataFrame, totals: DataFrame) -> DataFrame:
    """``counted`` with l, r, n and score of each phrase's lowest-scoring cut, ties to the shortest first part."""
    words = F.split("phrase", " ")
    cuts = counted.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "k", "a", "cut", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    first = freq.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    rest = freq.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    score = F.expr("(decimal(1000) * cast(a AS decimal(16,0)) * cast(n AS decimal(16,0)))"
                   " div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    return (
        cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).join(totals, "lang")
        .groupBy("lang", "phrase", "k", "a", "n")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "k", "a", "n", "best.score", "best.l", "best.r")
    )


def without_contained(scored: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """Drop phrases inside a longer one that has ``percent`` of their count or more.

    Counts fall with length, so that the phrases of one more word decide.
    """
    words = F.split("phrase", " ")
    shorter = F.array(F.slice(words, F.lit(1), F.col("k") - 1), F.slice(words, F.lit(2), F.col("k") - 1))
    inside = counted.where("k > 2").select(
        "lang", F.explode(F.transform(shorter, lambda w: F.array_join(w, " "))).alias("phrase"),
        F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(inside, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 closed_percent: int = CLOSED_PERCENT, shard_words: int = SHARD_WORDS,
                 held_words: int = HELD_WORDS) -> DataFrame:
    """The phrases of each language that score highest, after all whole texts were read.

    A-Z is lower-cased, texts are split into pieces at . , ; : ! ? and line ends, pieces into words at
    spaces and tabs.  Phrases are 2 to ``max_words`` words of one piece with ``min_count`` occurrences or
    more, overlapping ones included.

    Partitioning (SON): every shard is mined completely at its share of the support, what is frequent in some
    shard is united (as parts of hashes in blocks of a hash range, of which there are as many as the words
    ask for, and with an upper bound of its count, which most of the union fails), and the candidates are
    counted exactly over all texts.  A phrase with ``min_count`` occurrences has its share in
    some shard, so none is lost.  Beyond ``min_count`` shards a share is a single occurrence: then mining
    is a count of all phrases by their hashes, and its bound their number itself.  So that this stays smaller
    than the texts, pairs are mined first, of words with ``min_count`` occurrences, and then longer phrases, of
    pairs that are candidates.  Candidates reach the passes after as bit filters of at most 32 MB each.
    What these let through wrongly is counted, found rare and dropped, so it costs time and never a result.

    Returns lang, rank (from 1), phrase, a (its count), l and r (counts of the two parts of the lowest
    cut), n (words of the language) and score = floor(1000 a n / (l r)), by score, count (both descending) and
    phrase in byte order.  A phrase within a longer one of ``closed_percent`` of its count or more is left
    out.  Counts are exact up to 10^16 - 1 words a language, products in decimals of 38 digits.
    Null languages are ``und``; null, empty and blank texts have no words; repeated rows count as often as
    they occur; no other column is read; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(word_counts(texts, shard_words, held_words))
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    sized = texts.join(totals, "lang").select("lang", "text", "n")
    share = docs.sparkSession.sparkContext.broadcast
    known = [share(filter_of(word_names(words.where(F.col("n") >= min_count))))]
    for most in [2, max_words][: max_words - 1]:
        local = locally_frequent(sized, min_count, most, shard_words, held_words, FEWEST_BUCKETS, tuple(known))
        known.append(share(filter_of(written(united(local, min_count)))))
    counted = written(candidate_counts(
        sized, tuple(known), min_count, max_words, shard_words, held_words, FEWEST_BUCKETS))
    freq = counted.select("lang", "phrase", "a").unionByName(
        words.where(F.col("n") >= min_count).select("lang", F.col("word").alias("phrase"),
                                                    F.col("n").alias("a")))
    kept = without_contained(scored_cuts(counted, freq, totals), counted, closed_percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
