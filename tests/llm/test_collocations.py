import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortwise.llm import collocations as c
from tests.llm.helpers import awkward_texts, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top=2000, most=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in good.items():
            if inside[p] >= a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=160):
    """A third of all rows are one text; few words, frequent phrases, pieces that repeat one word."""
    rng = random.Random(seed)
    hot = "the hot line of words, the hot line; again AGAIN again again again"
    vocabulary = ["a", "B", "c\t", "dé", "e'", "f", "\x1c", "g-h", "ÀB"]
    rows = [(hot, "en")] * (n // 3)
    while len(rows) < n:
        words = rng.choices(vocabulary, k=rng.randint(0, 25), weights=range(1, 10))
        rows.append((rng.choice([" ", "  ", ". ", " \n"]).join(words), rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("shard_words", [c.SHARD_WORDS, 40, 7])
@pytest.mark.parametrize("min_count", [1, 3, 20])
def test_against_brute_force(spark, shard_words, min_count):
    rows = texts(shard_words + min_count)
    docs = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)]).repartition(5)
    got = c.collocations(docs, min_count=min_count, shard_words=shard_words, held_words=3 * shard_words)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_count)


def test_awkward_rows_and_top(spark):
    rows = awkward_texts()
    got = c.collocations(documents(spark, rows), min_count=4, top=3).collect()
    assert sorted(tuple(r) for r in got) == brute([(t, lang) for _, t, lang, _ in rows], 4, top=3)
    assert c.collocations(documents(spark, [])).count() == 0
    assert c.collocations(documents(spark, [None, "", " \t"]), min_count=1).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With one bit set for every candidate and hardly any bits, all phrases pass and are counted."""
    rows = texts(4)
    docs = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)])
    monkeypatch.setattr(c, "FEWEST_BITS", 64)
    monkeypatch.setattr(c, "MOST_BITS", 64)
    got = c.collocations(docs, min_count=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2)


def test_large_products_are_exact(spark):
    big = 9_000_000_000_000_000
    counted = spark.createDataFrame([("en", "x y", 2, big - 1)], "lang string, phrase string, k int, a long")
    freq = spark.createDataFrame([("en", "x", big), ("en", "y", big - 3)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    row = c.scored_cuts(counted, freq, totals).first()
    assert row.score == 1000 * (big - 1) * big // (big * (big - 3))


def test_local_support_is_proportional(spark):
    """What falls short of its share in every shard isn't sent; the bound counts what may be missed."""
    docs = documents(spark, [(i, "x y", "en", "s") for i in range(10)] + [
        (99, "p q r", "en", "s")]).selectExpr("lang", "text", "46L AS n").coalesce(1)
    local = c.locally_frequent(docs, 10, 5, 1000, 1000, 64)
    rows = local.collect()
    assert [r.missed for r in rows if r.bucket is None] == [4]
    assert [(len(r.hashes), int.from_bytes(r.excess, "little")) for r in rows if r.bucket is not None] == [(8, 6)]
    assert c.united(local, 10).count() == 1 and c.united(local, 11).count() == 0


@pytest.mark.parametrize("top", [1, 1 << 7, 1 << 20, 1 << 40])
def test_blocks_are_read_as_they_were_packed(top):
    rng = np.random.default_rng(top)
    blocks = [(np.unique(rng.integers(0, top, n).astype(np.uint64)), rng) for n in (1, 400, 3)]
    names, excess = [x for x, _ in blocks], [rng.integers(1, 1 << 34, len(x)) for x, _ in blocks]
    packed = [c.packed_blocks(x, e, np.array([0, len(x)])) for x, e in zip(names, excess, strict=True)]
    got = c.unpacked_blocks([h for p, _ in packed for h in p], [e for _, p in packed for e in p])
    assert got[0].tolist() == np.concatenate(names).tolist()
    assert got[1].tolist() == np.concatenate(excess).tolist()
    cut = c.packed_blocks(names[1], excess[1], np.array([0, 1, len(names[1])] if top > 1 else [0, 1]))
    assert c.unpacked_blocks(*cut)[0].tolist() == names[1].tolist()


def test_mining_sends_less_than_the_texts_hold(spark, monkeypatch):
    """Where a single occurrence is a shard's share, hardly any phrase is frequent and nothing is written twice."""
    rng = random.Random(8)
    rows = [(" ".join(f"word{int(rng.paretovariate(0.5)) % 5000}" for _ in range(400)), "en") for _ in range(60)]
    rows += [("the frequent line of words", "en")] * 25
    docs = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)]).repartition(4)
    sent, tables = [], []
    unite, write = c.united, c.written

    def united(local, min_count):
        sent.append(local.selectExpr("sum(length(hashes) + length(excess))").first()[0] or 0)
        return unite(local, min_count)

    def written(df):
        tables.append(df.columns)
        return write(df)

    monkeypatch.setattr(c, "united", united)
    monkeypatch.setattr(c, "written", written)
    got = c.collocations(docs, min_count=25, shard_words=700, held_words=700)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 25)
    assert sum(sent) < sum(len(t) for t, _ in rows)
    assert not any("hashes" in columns for columns in tables)


def test_shards_that_may_miss_a_phrase_count_in_the_bound(spark):
    """Blocks of two shards in one language, with shares above a single occurrence, and a third that has none."""
    rows = ["x y " * 5, "x y " * 4, "p q " * 3 + "p"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)]).selectExpr(
        "lang", "text", "25L AS n").repartition(3, "text")
    local = c.locally_frequent(docs, 10, 2, 1000, 1000, 64)
    missed = [r.missed for r in local.collect() if r.bucket is None]
    assert sorted(missed) == [2, 3, 3]
    # Bounds: x y 5 + 4 and 2 that may be missed; y x 4 and 3 + 2; p q and q p 3 and 3 + 3.
    assert c.united(local, 9).count() == 4 and c.united(local, 10).count() == 1
    assert c.united(local, 11).count() == 1 and c.united(local, 12).count() == 0
