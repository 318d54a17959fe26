"""Corpus pipeline: the stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept, and
returns the columns of ``documents``; the last returns the pieces of packed sequences.  Rows may hold
nulls anywhere and repeat; what each operator makes of them is said in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import language_id, line_dedup, mixing, ngram_join, packing
from cohortwise.llm.common import free_name, written
from cohortwise.llm.queries import MIX_EPOCHS, MIX_WEIGHTS, held_out, mix_levels, tokenizer_path

MIX_SHARE = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; see ``language_id.identify``."""
    model = language_id.train(docs, ~held_out())
    into = free_name(docs, "language")
    return language_id.identify(docs, model, into=into).where(
        ~F.col(into)["rejected"]).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of earlier ones; a document of which nothing is left goes."""
    into = free_name(docs, "lines")
    cleaned = line_dedup.line_dedup(docs, into=into)
    emptied = (F.col(into)["n_removed"] > 0) & (F.trim(F.col("text")) == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id (then hash of the text).

    Five-word shingles, a similarity of 0.8 or more.  Rows equal in id and text are one document.
    """
    # Counted from the least integer, so that ids in order are texts in order, negative ones too.
    number = F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    key = F.concat_ws(
        "-", F.coalesce(F.lpad(number.cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("~")),
        F.hex(F.xxhash64("text")))
    name = free_name(docs, "key")
    keyed = docs.withColumn(name, key)
    found = ngram_join.jaccard_components(keyed, id_col=name, words=5, percent=80)
    stays = found.where(F.col(name) == F.col("component_id")).select(name).distinct()
    return keyed.join(stays, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one taken in several epochs is there so many times."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, seed=5,
                      into=free_name(docs, "mix")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # language ID, patience alignment and tokens are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
