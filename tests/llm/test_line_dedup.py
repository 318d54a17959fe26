import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortwise.llm.line_dedup import common_blocks, line_dedup, patience_matches
from tests.llm.helpers import awkward_texts, documents, words


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
@settings(max_examples=300, deadline=None)
def test_matches_are_an_ascending_common_subsequence(a, b):
    found = patience_matches(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x < y for p, q in zip(found, found[1:]) for x, y in zip(p, q))


def test_patience_and_blocks():
    a, b = list("xabcyqdef"), list("wabczdefr")
    assert patience_matches(a, b) == [(1, 1), (2, 2), (3, 3), (6, 5), (7, 6), (8, 7)]
    assert common_blocks(a, b, {"b"}) == [1, 2, 3] and common_blocks(a, b, set()) == []
    assert patience_matches("same", "same") == [(i, i) for i in range(4)]


def lines(seed, n):
    rng = random.Random(seed)
    return [words(rng, 12) for _ in range(n)]


def test_shared_blocks_go_from_the_later_document(spark):
    shared, a, b, c = lines(0, 3), lines(1, 4), lines(2, 4), lines(3, 2)
    texts = ["\n".join(a[:2] + shared + a[2:]), "\n".join(b[:1] + shared + b[1:]),
             "\n".join(c + shared[1:]), "\n".join(a[:2] + shared + a[2:]), "\n".join(lines(9, 3))]
    out = {r.doc_id: r for r in line_dedup(documents(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[4].text == texts[4]
    assert out[1].text == "\n".join(b) and out[1].line_dedup.removed == [1, 2, 3]
    assert out[2].text == "\n".join(c) and out[3].text == "" and out[3].line_dedup.n_removed == 7
    assert out[1].line == "x" and out[1].line_dedup.n_lines == 7


def test_no_line_is_lost(spark):
    rng = random.Random(4)
    pool = lines(5, 40)
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(40)]
    out = line_dedup(documents(spark, texts, clash=False), rare_share=1.0).collect()
    before = {x for t in texts for x in t.split("\n")}
    assert {x for r in out for x in r.text.split("\n") if x} == before
    first = {x: min(i for i, t in enumerate(texts) if x in t.split("\n")) for x in before}
    by_id = {r.doc_id: r.text.split("\n") for r in out}
    assert all(x in by_id[i] for x, i in first.items())


def test_frequent_and_short_lines_stay(spark):
    common, short = lines(6, 1)[0], "yes."
    texts = ["\n".join([common, short, *lines(10 + i, 1)]) for i in range(30)]
    out = line_dedup(documents(spark, texts), rare_least=10).collect()
    assert {r.doc_id: r.text for r in out} == dict(enumerate(texts))


def test_awkward_rows(spark):
    rows = awkward_texts()
    out = line_dedup(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [r.text for r in out if r.doc_id == 3] == [None]
    assert [r.line_dedup.n_lines for r in out if r.doc_id == 3] == [0]
    # rows equal in id and text lose the same lines: all of them, as document 1 has them
    assert [r.text for r in out if r.doc_id == 2] == ["", "", ""]
    assert [r.text for r in out if r.doc_id == 1] == [rows[0][1]]
    assert line_dedup(documents(spark, rows).limit(0)).count() == 0


def test_hot_copies_and_passages_go(spark):
    passage, copy = lines(20, 2), lines(21, 1)
    texts = ["\n".join([*lines(100 + i, 1), *passage, *lines(200 + i, 1)]) for i in range(20)]
    texts += ["\n".join(copy)] * 20
    # Each of the passage's lines stands alone in an earlier document.
    texts = ["\n".join([passage[1], *lines(300, 1)]), "\n".join([passage[0], *lines(301, 1)]), *texts]
    got = [r.text for r in line_dedup(documents(spark, texts), rare_least=3).collect()]
    assert got[:3] == texts[:3]
    assert got[3:22] == ["\n".join(lines(100 + i, 1) + lines(200 + i, 1)) for i in range(1, 20)]
    assert got[22:] == ["\n".join(copy)] + [""] * 19


def test_lines_in_another_order_or_repeated_go(spark):
    a, b, c = lines(30, 3)
    assert common_blocks([b, a, b], [a, b], {a, b}) == [0, 1, 2]
    texts = [f"{a}\n{b}", f"{b}\n{a}", f"{b}\n{a}", f"{b}\n{c}\n{b}\n{a}\n{a}"]
    got = {r.doc_id: r.text for r in line_dedup(documents(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: c}


def test_blocks_of_short_lines_go(spark):
    verse = ["red hen", "old fox", "", "wet dog", "big cat", "sly owl"]
    texts = ["\n".join(["top", *verse, "end"]), "\n".join([*lines(40, 1), *verse]), "ab", "ab",
             "\n".join([*verse, "more"]), "\n".join(["red hen", *lines(41, 1), "old fox"])]
    got = {r.doc_id: r.text for r in line_dedup(documents(spark, texts)).collect()}
    assert got == {0: texts[0], 1: lines(40, 1)[0], 2: "ab", 3: "", 4: "more", 5: texts[5]}
