"""Words, shingles and byte n-grams of many texts at once, as integers, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 256

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = b"\n"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def power_table(base: int, length: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    table = _powers.get(base)
    if table is None or len(table) < length:
        table = np.full(max(length, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = table = np.cumprod(table, dtype=np.uint64)
    return table[:length]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunked(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about CHUNK_BYTES; a longer text is a run of its own."""
    run: list[bytes] = []
    total = 0
    for text in texts:
        if run and (total + len(text) > CHUNK_BYTES or len(run) >= CHUNK_TEXTS):
            yield run
            run, total = [], 0
        run.append(text)
        total += len(text)
    if run:
        yield run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more).

    Words are runs of bytes other than space and 0x09 to 0x0D, after lower-casing A-Z.  A word's
    hash is a polynomial in its bytes modulo 2^64, scrambled with its length.
    """
    hashes, bounds, _, _, _ = located_words(texts)
    return hashes, bounds


def located_words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As ``word_hashes``, and first and end byte of each word and where texts begin, in the joined texts."""
    buffer = _LOWER[np.frombuffer(_SEPARATOR.join(texts) + _SEPARATOR, dtype=np.uint8)]
    space = _IS_SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power_table(_BASE, len(buffer)),
              out=sums[1:])
    raw = (sums[ends] - sums[starts]) * power_table(_BASE_INVERSE, len(buffer))[starts]
    hashes = mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, text_starts), starts, ends, text_starts


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, as sorted 64-bit hashes.

    A text of fewer words has one shingle, all of them; a text without words has none.
    """
    for run in chunked(texts):
        words, bounds = word_hashes(run)
        n = len(words) - k + 1
        rolled = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(k if n > 0 else 0):
            rolled = mixed(rolled * np.uint64(0xA24BAED4963EE407) + words[j : j + n])
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - begin >= k:
                yield np.unique(rolled[begin : end - k + 1])
            elif end > begin:
                whole = np.zeros(1, dtype=np.uint64)
                for w in words[begin:end]:
                    whole = mixed(whole * np.uint64(0xA24BAED4963EE407) + w)
                yield mixed(whole + np.uint64(end - begin))
            else:
                yield np.zeros(0, dtype=np.uint64)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def each_text(column) -> Iterator[bytes]:
    """The same one after the other; only CHUNK_TEXTS of the column are copied at a time.

    At the end Arrow gives back to the system what earlier batches have left.
    """
    import pyarrow as pa

    for start in range(0, len(column), CHUNK_TEXTS):
        yield from as_bytes(column.slice(start, CHUNK_TEXTS))
    pa.default_memory_pool().release_unused()
