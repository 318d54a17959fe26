import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortwise.llm import packing, tokens
from cohortwise.llm.queries import op6_packing, tokenizer_path
from cohortwise.llm.tokens import WordTokenizer
from tests.conftest import SF
from tests.llm.helpers import awkward_texts, documents, words


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30),
       st.sampled_from([4, 16, 64]))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_piece_once(histogram, block):
    plan = packing.plan_templates(histogram, window=64, classes=16, block=block)
    used, tails = Counter(), Counter()
    for i, t in enumerate(plan):
        head = t.cut[1] if t.cut else 0
        full = sum(n * m for n, m in t.parts) + head
        assert t.repeats > 0 and full <= 64 and head % block == 0
        assert 64 - full < block or t.repeats == 1 and i == len(plan) - 1
        for n, m in t.parts:
            used[n] += m * t.repeats
        if t.cut:
            assert 0 < head < t.cut[0]
            used[t.cut[0]] += t.repeats
            tails[t.cut[0] - head] += t.repeats
    assert used == Counter(histogram) + tails
    table = packing.places(plan)
    for n, m in used.items():  # the entries of a length take up its ranks without gap
        own = table["length"] == n
        assert table["rank"][own][0] == 0 and (np.diff(table["rank"][own]) > 0).all()
        assert table["rank"][own][-1] < m


def test_crc_of_part():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 900))), rng.bytes(int(rng.integers(1, 900)))
        assert packing.crc_of_part(zlib.crc32(a), zlib.crc32(a + b), len(b)) == zlib.crc32(b)


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 4096)
    plan = packing.plan_templates(Counter(lengths.tolist()))
    assert sum(t.repeats for t in plan) * 4096 < 1.01 * lengths.sum()


def test_nnls_against_its_conditions():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    found = packing.combinations(16, 4)
    assert len(found) == len(set(found)) and all(sum(c) == 16 and 2 <= len(c) <= 4 for c in found)
    assert (8, 8) in found and (13, 1, 1, 1) in found


ODD = ["don't stop. it's I'LL we've", "a..b , . ,, x.,y", "ÉCOLE Été. œuvre Œ ß ÿ Ÿ ÷ × a÷b",
       "école É́.", "<|endoftext|> hi", "<|ENDOFTEXT|> x", "tab\tx\x0by\x0cz\x1cq\x85w\xa0e",
       "", "  \n ", "123 4,5.6 a1b2", "İstanbul ΣΑΣ σ.", "日本語 テスト。 ok", "à. b", "́x .́",
       "naïve, CAFÉ. ÀÉ,", "“quoted” — dash….", "x­y"]


def test_word_tokenizer_gives_the_librarys_ids():
    tokenizer = WordTokenizer(tokenizer_path())
    texts = [t.encode() for t in ODD]
    assert tokenizer.encode(texts) == [tokenizer.whole(t) for t in texts]
    assert tokenizer.encode(texts) == [tokenizer.whole(t) for t in texts]  # now from memory


def rebuilt(rows):
    """Checks pieces and sequences; the ids of each row that is told apart by its tokens."""
    documents_, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= packing.WINDOW
        sequences[r.sequence_id].append((r.offset, r.length))
        documents_[r.doc_id, r.doc_tokens].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return documents_


def test_round_trip_of_awkward_rows(spark):
    rows = awkward_texts()
    df = packing.pack_documents(documents(spark, rows), tokenizer_path(), keep_ids=True)
    got = df.collect()
    pieces = rebuilt(got)
    tokenizer = WordTokenizer(tokenizer_path())
    want = Counter((i, tokenizer.whole((t or "").encode()) + b"\x02\0\0\0") for i, t, *_ in rows)
    found = Counter()
    for (doc, tokens), parts in pieces.items():
        by_start = defaultdict(list)
        for p in parts:
            by_start[p.start].append(p)
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in parts)
        for copy in range(len(by_start[0])):
            whole, at = b"", 0
            while at < tokens:
                piece = sorted(by_start[at], key=lambda p: bytes(p.ids))[copy]
                whole, at = whole + bytes(piece.ids), at + piece.length
            found[doc, whole] += 1
    assert found == want
    assert packing.pack_documents(documents(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_query(spark):
    import duckdb
    from tokenizers import Tokenizer

    got = op6_packing(spark, SF).collect()
    pieces = rebuilt(got)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert {d for d, _ in pieces} == set(texts)
    for (doc, tokens), parts in pieces.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        assert tokens == len(ids) and sum(p.length for p in parts) == tokens
        for p in parts:
            raw = np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()
            assert zlib.crc32(raw) == p.ids_crc32
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // packing.WINDOW) + 1


@pytest.mark.parametrize("lengths", [{1: 10_000}, {1400: 10_000}, {4096: 10_000},
                                     {2100: 10_000, 300: 50}, {3000: 9999, 2049: 7777}])
def test_lengths_that_do_not_fit_are_cut(lengths):
    plan = packing.plan_templates(lengths)
    total = sum(x * n for x, n in lengths.items())
    assert sum(t.repeats for t in plan) <= -(-total // (4096 - packing.BLOCK + 1)) + 1
    assert len(plan) < 500


def test_cut_pieces_hold_their_ids(spark):
    rows = [(i, words(random.Random(i), 1000 + i % 3 * 100), "en", "a") for i in range(60)]
    got = packing.pack_documents(documents(spark, rows), tokenizer_path(), keep_ids=True).collect()
    pieces = rebuilt(got)
    tokenizer = WordTokenizer(tokenizer_path())
    assert len(got) > len(rows)
    for (doc, tokens), parts in pieces.items():
        assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in parts)
        whole = b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start))
        assert whole == bytes(tokenizer.whole(rows[doc][1].encode())) + b"\x02\0\0\0"
    sequences = {r.sequence_id for r in got}
    assert sum(r.length for r in got) > 0.95 * packing.WINDOW * (len(sequences) - 1)


class CountedModel:
    def __init__(self, model):
        self.model, self.calls = model, Counter()

    def tokenize(self, letters):
        self.calls[letters] += 1
        return self.model.tokenize(letters)


def test_frequent_words_are_encoded_once_however_many_rare_ones_pass(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)
    tokenizer = WordTokenizer(tokenizer_path())
    tokenizer.model = counted = CountedModel(tokenizer.model)
    for i in range(40):
        rare = " ".join(chr(97 + i % 26) * (2 + i // 26) + chr(97 + j) for j in range(26))
        text = f"Often {rare} often, OFTEN... (often".encode()
        assert tokenizer.encode([text]) == [tokenizer.whole(text)]
        assert len(tokenizer.known) + len(tokenizer.known.older) <= 300
    assert counted.calls["often"] == 1 and len(counted.calls) > 1000


def test_signs_after_letters_need_no_rules_of_the_file():
    tokenizer = WordTokenizer(tokenizer_path())
    signs = ["...", "$$$", "',", ")\"", "*", "!?", "'", "_-", "`~{|}", "'.'"]
    texts = [f"{w}{s}".encode() for s in signs for w in ("abc", "Étéà", "don", "x")]
    want = [tokenizer.whole(t) for t in texts]
    ruled = Counter()
    whole = tokenizer.whole

    def counted(text):
        ruled[text] += 1
        return whole(text)

    tokenizer.whole = counted
    assert tokenizer.encode(texts) == want
    assert ruled == Counter(s.encode() for s in signs)
