import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortwise.llm import common, links, ngram_join, textnum
from tests.llm.helpers import awkward_texts, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (
        frozenset([tuple(w)]) if w else frozenset())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t, *_ in rows]
    linked = {i: set() for i in range(len(rows))}
    for a in linked:
        for b in linked:
            both = len(sets[a] & sets[b])
            if a != b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                linked[a].add(b)
    out = []
    for i in linked:
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None),
                                                  default=None)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    got = ngram_join.jaccard_components(documents(spark, rows), **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def near_copies(seed, families, copies, length):
    """Texts and edited copies, around the threshold, short and long."""
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = words(rng, rng.randint(*length)).split()
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = words(rng, 1)
            if rng.random() < 0.3:
                w += words(rng, rng.randint(1, 3)).split()
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rng.shuffle(texts)
    return [(100 + i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("words_, percent", [(4, 85), (5, 80)])
def test_against_brute_force(spark, words_, percent):
    rows = near_copies(1, 12, 8, (60, 200)) + near_copies(2, 12, 6, (1, 30))
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert run(spark, rows, words=words_, percent=percent) == brute(rows, words_, percent)


def test_subsets_of_light_sets_alone(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *_: 26)
    rows = near_copies(3, 25, 6, (8, 26))
    assert run(spark, rows) == brute(rows, 4, 85)


def test_lists_alone_and_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *_: 0)
    rows = near_copies(4, 1, 80, (120, 121)) + near_copies(5, 10, 3, (5, 40))
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert run(spark, rows) == brute(rows, 4, 85)


def test_without_leader_rounds_the_rest_finds_all(spark, monkeypatch):
    def one_round(live, profiles, fetch, percent):
        return links.linked_components(live, profiles, fetch, percent, rounds=1)

    monkeypatch.setattr(ngram_join, "linked_components", one_round)
    rows = near_copies(6, 6, 20, (60, 100))
    assert run(spark, rows) == brute(rows, 4, 85)


def test_awkward_rows(spark):
    rows = awkward_texts()
    # an empty set is linked with nothing, and so bears its own id
    assert run(spark, rows) == brute(rows, 4, 85)
    assert ngram_join.jaccard_components(documents(spark, rows).limit(0)).count() == 0


def test_boundary_by_cost():
    sizes = np.zeros(65, dtype=np.int64)
    sizes[5] = 1000
    assert ngram_join.choose_boundary(sizes, 1.0, 85) >= 5
    sizes[:] = 0
    sizes[40] = 1000
    assert ngram_join.choose_boundary(sizes, 1.0, 85) == 0


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(
            0, 1 << 63, rng.integers(0, 60)).astype(np.uint64))))
        bound = links.fewest_differences(links.parity_bits(a), links.parity_bits(b))
        assert bound <= len(np.setxor1d(a, b))


def test_shingle_sets_match_plain_python():
    texts = ["", "a", "A b\tc", "a b c d", "x y z w x y z w", "é É a\x0bb c", " lead trail "]
    got = [len(s) for s in textnum.shingle_sets([t.encode() for t in texts], 4)]
    assert got == [len(shingles(t, 4)) for t in texts]
    one, two = textnum.shingle_sets([b"One two three FOUR five", b"one two three four five"], 4)
    assert (one == two).all()


def test_a_batch_of_texts_is_copied_a_few_at_a_time(monkeypatch):
    """A worker holds the batch and a chunk of it, not all of its texts twice."""
    copied, whole = [], textnum.as_bytes

    def counting(column):
        copied.append(len(column))
        return whole(column)

    monkeypatch.setattr(textnum, "as_bytes", counting)
    for kind in (pa.string(), pa.large_string()):
        for n in (0, 1, 256, 257, 1000):
            column = pa.array([None if i % 7 == 0 else "é" * (i % 50) for i in range(n)], kind)
            assert list(textnum.each_text(column)) == whole(column)
    assert max(copied) <= textnum.CHUNK_TEXTS


def test_python_gets_small_batches_and_the_session_keeps_its_setting(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def largest():
        return max(r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect())

    seen, write = [], ngram_join.written

    def noting(df):
        seen.append(largest())
        return write(df)

    monkeypatch.setattr(ngram_join, "written", noting)
    texts = [(i, f"one two three four five six {i % 3}", "en", "a") for i in range(9)]
    assert largest() == 2500
    found = ngram_join.jaccard_components(documents(spark, texts))
    assert largest() == 2500 and spark.conf.get(common.BATCH_ROWS, None) is None
    assert seen and max(seen) == common.TEXTS_IN_A_BATCH
    assert sorted(map(tuple, found.collect())) == brute(texts, 4, 85)
    spark.conf.set(common.BATCH_ROWS, 7)
    try:
        with common.small_batches(spark):
            assert largest() == 7
        assert largest() == 7
    finally:
        spark.conf.unset(common.BATCH_ROWS)
