import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import language_id
from cohortwise.llm.queries import op7_language_id
from tests.llm.helpers import awkward_texts, documents, words

ALPHABETS = {"aa": "abcdef", "bb": "ghijkl", "cc": "äöüßé"}


def learned(spark, n=60):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(5, 60), ALPHABETS[lang]), lang, "s")
            for i, lang in enumerate(list(ALPHABETS) * n)]
    return documents(spark, rows, clash=False)


def test_learns_and_rejects(spark):
    docs = learned(spark)
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ["aa", "bb", "cc"] and 0 < model.threshold < 1
    got = language_id.identify(docs, model).collect()
    assert np.mean([r.language.lang_pred == r.lang for r in got]) > 0.98
    assert all(0 <= r.language.score <= 1 for r in got)
    assert sum(r.language.rejected for r in got) <= 2


def test_awkward_rows(spark):
    model = language_id.train(learned(spark), F.lit(True))
    rows = awkward_texts()
    got = language_id.identify(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.language.lang_pred == "und") == (not lettered)
        assert lettered or (r.language.score == 0 and r.language.rejected)
        assert r.row == "x"
    empty = documents(spark, rows).limit(0)
    assert language_id.identify(empty, model).count() == 0


def test_nothing_to_learn_from(spark):
    rows = [(1, "text", None, "s"), (2, None, "en", "s"), (3, "123", "en", "s")]
    docs = documents(spark, rows)
    model = language_id.train(docs, F.lit(True))
    assert model is None
    assert [r.language.lang_pred for r in language_id.identify(docs, model).collect()] == ["und"] * 3


def test_one_language(spark):
    docs = documents(spark, [(i, "some text", "xx", "s") for i in range(3)])
    model = language_id.train(docs, F.lit(True))
    assert {r.language.lang_pred for r in language_id.identify(docs, model).collect()} == {"xx"}


def test_two_labels_reject_junk(spark):
    docs = learned(spark, 600).where("lang <> 'cc'")
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ["aa", "bb"] and model.threshold > 0.5
    rng = random.Random(8)
    junk = documents(spark, [(i, words(rng, 200, "жщюяъыэ" if i % 2 else "tuvwxyz"), None, "s")
                             for i in range(20)])
    found = language_id.identify(junk, model).collect()
    assert all(r.language.rejected for r in found)
    clean = language_id.identify(docs, model).collect()
    assert np.mean([r.language.rejected for r in clean]) < 0.02


def test_every_label_is_learned(spark):
    rows = [(i, f"text {chr(97 + i % 26)}", f"l{i % 40:02}", "s") for i in range(400)]
    rows += [(None, "the same", "hot", "s")] * 300
    model = language_id.train(documents(spark, rows, clash=False), F.lit(True), sample_rows=20)
    assert model.languages == sorted({r[2] for r in rows})


def test_subwords_stay_within_words_and_texts():
    both = language_id.subword_counts(["ab cd", "xy"])
    apart = np.concatenate([language_id.subword_counts([t]) for t in ("ab cd", "xy")])
    assert (both == apart).all()
    words_ = language_id.subword_counts(["ab"]) + language_id.subword_counts(["cd"])
    assert (both[0] == words_[0]).all()
    assert both.sum(axis=1).tolist() == [2 * (3 + 2 + 1), 3 + 2 + 1]


def test_long_texts_are_read_whole():
    runs = language_id._runs(pd.Series(["a" * 3_000_000, None, "b"]))
    assert [len(r) for r in runs] == [1, 2]
    assert language_id.subword_counts(runs[0]).sum() > 8_999_990


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_on_the_held_out_fold(spark, sf):
    import duckdb

    got = op7_language_id(spark, f"/root/testdata/{sf}").collect()
    truth = dict(duckdb.sql(
        f"SELECT doc_id, lang FROM '/root/testdata/{sf}/documents.parquet'").fetchall())
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    apart = [r for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in apart]) > 0.97
