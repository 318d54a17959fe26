import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
import check_queries
from cohortwise.llm import queries
from tests.conftest import SF
from tests.llm.helpers import DOCUMENTS, awkward_texts, documents


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    outcome = check_queries.compare(spark, check_queries.connect(SF), name, SF)
    assert outcome.startswith("ok"), outcome


def test_registry():
    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} == {"pipeline", *queries.queries()}
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name == "language_id":
            texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
            assert docs.count() > 0.98 * sum(
                any(c.isalpha() for c in t or "") for t in texts.values())
    assert 0 < docs.count() <= 4 * before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert "sequence_id" in pieces.columns and pieces.count() >= docs.count()


def test_one_of_each_group_stays(spark):
    rows = awkward_texts()
    out = corpus_pipeline.keep_one_of_near_copies(spark, documents(spark, rows), SF).collect()
    texts = [r.text for r in out]
    assert texts.count(rows[0][1]) == 1 and [r.doc_id for r in out if r.text == rows[0][1]] == [1]
    assert sum(len(t or "") > 100_000 for t in texts) == 1 and texts.count("word") == 1
    assert {r.doc_id for r in out if not (r.text or "").strip()} == {3, 4, 5, 6, None}


def test_the_least_id_stays_also_below_zero(spark):
    text = awkward_texts()[0][1]
    rows = [(i, text, "en", "a") for i in (7, -3, -25, 0, None, (1 << 63) - 1)]
    out = corpus_pipeline.keep_one_of_near_copies(spark, documents(spark, rows), SF).collect()
    assert [r.doc_id for r in out] == [-25]


def test_awkward_rows_and_empty_tables_through_all_stages(spark):
    rows = [(*r, None) for r in awkward_texts()]
    for table in (rows, []):
        docs = spark.createDataFrame(table, DOCUMENTS)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.count() > 0 if table else docs.count() == 0
