import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortwise.llm import links, substring_dedup, textnum
from tests.llm.helpers import words


def test_signatures_leave_every_alike_pair(spark):
    rng = np.random.default_rng(4)
    rows, alike = [], []
    for n in (1, 5, 16, 33, 60, 130, 300, 900):
        for changed in (0, 1, n // 12, n // 8, n // 3, n):
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            fresh = rng.integers(1, 1 << 62, changed).astype(np.uint64)
            b = np.unique(np.concatenate((a[changed:], fresh, a[: n // 20])))
            both = len(np.intersect1d(a, b))
            alike.append(100 * both >= 80 * (len(a) + len(b) - both))
            rows.append({"i": len(rows), "size": len(a), "other_size": len(b),
                         "signature": links._signature(links.parity_bits(a)).tolist(),
                         "other_signature": links._signature(links.parity_bits(b)).tolist()})
    pairs = spark.createDataFrame(pd.DataFrame(rows))
    kept = {r.i for r in pairs.where(links._signatures_fit(80)).collect()}
    assert {i for i, good in enumerate(alike) if good} <= kept
    assert len(kept) < len(rows)  # pairs with nothing in common go
    assert pairs.where(F.size("signature") > 2 * links.SIGNATURE_WORDS - 1).isEmpty()


def test_paragraph_sets_and_hashes_in_any_order():
    rng = random.Random(6)
    texts = [words(rng, n).encode() for n in (0, 4, 5, 30, 60, 400)]
    texts += [b"\n".join(words(rng, 40).encode() for _ in range(4)), b"same " * 70, b""]
    found = substring_dedup.Paragraphs(texts, 20, 31, 5)
    which = np.random.default_rng(2).permutation(len(found.at))
    sizes, parities, elements = found.shingle_sets(which)
    for i, size, parity, raw in zip(which, sizes, parities, elements, strict=True):
        own = np.unique(found.shingles[found.at[i] : found.till[i] - found.k + 1])
        assert size == len(own) and raw == own.tobytes() and parity == links.parity_bits(own)
    natural = which[which >= found.anchored]
    odd = np.random.default_rng(29).integers(1, 1 << 62, (3, 5)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for i, hashes in zip(natural, found.natural_hashes(natural, 3, 5), strict=True):
        x = found.shingles[found.at[i] : found.till[i] - found.k + 1]
        for band in range(3):
            joined = np.full(1, substring_dedup._NATURAL + band, dtype=np.uint64)
            for factor in odd[band]:
                least = ((x * factor) >> np.uint64(20)).min()
                joined = textnum.mixed(joined * np.uint64(0x9E3779B97F4A7C15) + least)
            assert hashes[band] == joined[0]
