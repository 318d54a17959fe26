import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortwise.llm import periodic_runs as p
from cohortwise.llm.queries import planted_repetition
from tests.llm.helpers import awkward_texts, documents


def brute(words):
    """All runs, by comparing the words with themselves at every distance."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    found = {}
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate(([0], x[:-q] == x[q:], [0])).astype(int)
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def compare(docs, rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                  for r in p.periodic_runs(docs).collect()))
    want = []
    for i, text in rows:
        words = split(text)
        runs = brute(words)
        want.append((i is None, i or 0, len(words), runs, kept(words, runs)))
    assert got == sorted(want)


def repetitive(rng, n):
    """Words from stretches that repeat, of all periods, with single words changed."""
    out = []
    while len(out) < n:
        unit = rng.choices("abcdefg"[: rng.randint(1, 7)], k=rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 64, 130]))
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 9 * len(unit))]
    for _ in range(rng.randint(0, 3) if out else 0):
        out[rng.randrange(len(out))] = "z"
    return " ".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, repetitive(rng, rng.choice([0, 3, 7, 20, 90, 400, 1500]))) for i in range(150)]
    compare(documents(spark, [(i, t, "en", "s") for i, t in rows]), rows)


def test_tiles_of_a_long_text_are_stitched(spark, monkeypatch):
    monkeypatch.setattr(p, "TILE_WORDS", 32)
    rng = random.Random(1)
    rows = [(1, "a " * 5000), (2, "a b " * 3000 + "c"), (3, " ".join(rng.choices("ab", k=4000))),
            (4, repetitive(rng, 9000)), (5, "x " + " ".join(f"w{i % 700}" for i in range(5000)) + " y")]
    compare(documents(spark, [(i, t, "en", "s") for i, t in rows]), rows)


def test_awkward_rows(spark):
    rows = awkward_texts()
    compare(documents(spark, rows), [(i, t) for i, t, _, _ in rows])
    assert p.periodic_runs(documents(spark, [])).count() == 0
    got = p.periodic_runs(documents(spark, [None, "a a a a a a b"]), digest=True).collect()
    assert {r.doc_id: r.collapsed for r in got} == {
        0: hashlib.sha256(b"").hexdigest(), 1: hashlib.sha256(b"a b").hexdigest()}


def test_tile_fragments_of_nested_periods():
    words = [0, 1] * 10
    assert p.tile_fragments(words, [0, 4], 1) == {2: [[0, 20]]}
    assert p.tile_fragments(words, [0], 2) == {4: [[0, 20]]}


def test_z_function():
    rng = random.Random(3)
    for _ in range(200):
        s = rng.choices([0, 1], k=rng.randint(1, 30))
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert p.z_function(s, len(s)) == want
        assert p.z_function(s, 5) == want[:5]


def test_planted_repetition(spark):
    rng = random.Random(9)
    rows = [(i, " \t ".join(rng.choices("abcdefghij", k=rng.randint(0, 60)))) for i in range(300)] + [(None, "a b")]
    got = {r.doc_id: split(r.text) for r in planted_repetition(
        documents(spark, [(i, t, "en", "s") for i, t in rows], clash=False)).collect()}
    for i, text in rows:
        words = split(text)
        n = len(words)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % q] for k in range(n)]
        assert got[i] == words
