"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import bit_words, passes

PREFIX_CHARS = 64
FILTER_BITS = 1 << 22  # 65,536 words of 64 bits: the bound of what is broadcast


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS,
                filter_bits: int = FILTER_BITS) -> DataFrame:
    """Find equal texts; of each group the row with the largest id stays.

    1. Rows are grouped by (byte length, hash of the first characters).  A length
       or a prefix that no other row has ends here.
    2. Which hashes of such groups have several rows goes into a bit filter of
       fixed size.  A row that misses it is unique; its content is hashed no further.
    3. The rest are grouped by SHA-256 of the whole text.

    Texts never go through a shuffle, only lengths, hashes and ids.  A filter
    that is full (a corpus of far more rows than bits) lets every row pass to
    step 3, which costs time and changes no result.

    Returns one row per input row: id, byte_length, keep_id, group_size, kept,
    and the columns of ``carry``, expressions over the input's columns, evaluated
    while the row is read.  ``docs`` may have any other columns.

    A null text counts as empty.  Ids may be null or repeat: keep_id is the largest id that is
    not null (null if there is none), and exactly one row of each group is kept.  An empty table
    gives an empty result.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("content"),
        F.octet_length(text).cast("long").alias("byte_length"),
        F.xxhash64(F.octet_length(text), F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
        *[c.alias(name) for name, c in carry.items()],
    )
    crowded = (
        rows.groupBy("byte_length", "prefix_hash").agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    words = bit_words(crowded, F.col("prefix_hash"), filter_bits)
    refined = passes(rows, F.col("prefix_hash"), words, filter_bits, "survives").select(
        "id", "byte_length", *carry,
        F.when(F.col("survives"), F.unhex(F.sha2("content", 256))).alias("full_hash"),
        F.when(~F.col("survives"), F.col("prefix_hash")).alias("lone_hash"),
    )
    # Rows that repeat an id within a group become one row with a count.
    key = ["byte_length", "lone_hash", "full_hash"]
    rows_of_id = refined.groupBy(*key, "id").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in carry])
    lone = rows_of_id.where("full_hash is null").select(
        "id", "byte_length", F.col("id").alias("keep_id"), "copies",
        F.col("copies").alias("group_size"), *carry)
    survivors = rows_of_id.where("full_hash is not null")
    groups = survivors.groupBy("full_hash", "byte_length").agg(
        F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    grouped = survivors.join(groups, ["full_hash", "byte_length"]).select(
        "id", "byte_length", "keep_id", "copies", "group_size", *carry)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (
        lone.unionByName(grouped)
        .select("id", "byte_length", "keep_id", "group_size", *carry, copy)
        .select(F.col("id").alias(id_col), "byte_length", "keep_id", "group_size",
                (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                *carry)
    )
