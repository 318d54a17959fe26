import random

from cohortwise.llm import substring_dedup
from cohortwise.llm.substring_dedup import repeated_passages, tune_bands, without_passages
from tests.llm.helpers import awkward_texts, documents, words


def planted(seed, copies=4, length=51):
    """Documents of which some hold the same passage, amid other words of a line."""
    rng = random.Random(seed)
    passage = words(rng, length)
    texts = []
    for i in range(12):
        w = words(rng, rng.randint(60, 150)).split()
        at = rng.randrange(len(w))
        texts.append(" ".join([*w[:at], *([passage] if i % 3 == 0 else []), *w[at:]]))
    return texts[: 3 * copies], passage


def test_every_shared_passage_of_51_words_is_found(spark):
    texts = []
    for seed in range(15):
        texts += planted(seed)[0]
    docs = documents(spark, texts)
    got = repeated_passages(docs).collect()
    held = {i for i in range(len(texts)) if i % 3 == 0}
    first = {12 * s for s in range(15)}
    assert {r.doc_id for r in got} == held - first
    assert {r.keep_id for r in got} == first
    for r in got:
        passage = planted(r.doc_id // 12)[1]
        cut = texts[r.doc_id][r.start : r.start + r.length]
        outside = [w for w in cut.split() if w not in passage.split()]
        # at a similarity of 0.8 a paragraph may have a word of its own at either end
        assert len(outside) <= 4 and len(cut.split()) >= 20 and r.keep_id == r.doc_id // 12 * 12


def test_near_passages_and_clean_documents(spark):
    rng = random.Random(8)
    base = words(rng, 200).split()
    edited = list(base)
    for at in (60, 120):
        edited[at] = "changed"
    clean = [words(rng, 200) for _ in range(5)]
    shared_line = words(rng, 12)
    clean = [f"{t}\n{shared_line}\n{words(rng, 50)}" for t in clean]
    got = repeated_passages(documents(spark, [" ".join(base), " ".join(edited), *clean])).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.length for r in got) > 600


def test_without_passages(spark):
    texts, passage = planted(3)
    texts = [t.replace("a", "é") for t in texts]
    docs = documents(spark, [*texts, None, ""])
    got = repeated_passages(docs)
    left = {r.doc_id: r.text for r in without_passages(docs, got).collect()}
    spans = {}
    for r in got.collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in enumerate(texts):
        for start, length in sorted(spans.get(i, []), reverse=True):
            t = t[:start] + t[start + length :]
        assert left[i] == t
    assert left[12] is None and left[13] == ""


def test_awkward_rows(spark):
    rows = awkward_texts()
    got = repeated_passages(documents(spark, rows)).collect()
    # 1 and 2 hold one text, and so does a row without id; 9 is the head of 10
    assert {r.doc_id for r in got} == {2, 10, None}
    assert {(r.doc_id, r.keep_id) for r in got} == {(2, 1), (None, 1), (10, 9)}
    ten = [r for r in got if r.doc_id == 10]
    assert sum(r.length for r in ten) > 0.9 * len(rows[12][1])
    assert repeated_passages(documents(spark, rows).limit(0)).count() == 0


def test_repeats_within_one_document_are_no_finding(spark):
    rng = random.Random(1)
    passage = words(rng, 80)
    assert repeated_passages(documents(spark, [f"{passage}\n{passage}", words(rng, 90)])).count() == 0


def test_bands():
    bands = tune_bands(0.8, 0.95, 3)
    assert 1 - (1 - 0.8**3) ** bands >= 0.95 > 1 - (1 - 0.8**3) ** (bands - 1)


def test_anchor_gaps():
    rng = random.Random(0)
    from cohortwise.llm import textnum

    texts = [words(rng, n).encode() for n in (5, 31, 32, 500, 33, 1000)]
    hashes, bounds = textnum.word_hashes(texts)
    at = substring_dedup.anchors(hashes, bounds, 31)
    for b, e in zip(bounds[:-1], bounds[1:]):
        own = [x - b for x in at if b <= x < e]
        if e - b >= 32:
            gaps = [own[0] + 1, *[y - x for x, y in zip(own, own[1:])], e - b - 1 - own[-1]]
            assert max(gaps) <= 31
        else:
            assert not own


def test_natural_paragraphs_are_compared_whole(spark):
    rng = random.Random(12)
    texts = []
    for i in range(6):
        base = words(rng, 51).split()
        edited = [*base[:25], "changed", *base[26:]]
        texts += [f"{words(rng, 60)}\n{' '.join(base)}\n{words(rng, 60)}",
                  f"{words(rng, 60)}\n{' '.join(edited)}\n{words(rng, 60)}"]
    for n in (5, 18, 40):
        texts += [words(rng, n)] * 2
    got = {r.doc_id: r for r in repeated_passages(documents(spark, texts)).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {i: i - 1 for i in range(1, 18, 2)}
    for i, r in got.items():
        line = texts[i].split("\n")[1 if i < 12 else 0]
        cut = texts[i][r.start : r.start + r.length]
        # a paragraph of 20 words may have a word of its own at either end
        assert line in cut and len(cut.split()) <= len(line.split()) + 2


def test_passages_are_found_to_their_ends(spark):
    texts = []
    for seed in range(40, 48):
        texts += [t.replace(" ", "\t", 3) for t in planted(seed, length=70)[0]]
    got = repeated_passages(documents(spark, texts)).collect()
    assert len(got) == 24
    for r in got:
        passage = planted(40 + r.doc_id // 12, length=70)[1].split()
        cut = texts[r.doc_id][r.start : r.start + r.length].split()
        assert " ".join(passage) in " ".join(cut) and len(cut) <= len(passage) + 2
