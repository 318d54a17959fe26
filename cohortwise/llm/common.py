"""Helpers shared by the corpus operators: tables in shared storage, ranks, bit filters."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master a temporary one if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that they can't clash with those an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(row: str, columns: list[str], **changed: Column) -> list[Column]:
    """The columns of such a struct again, some of them with new values."""
    return [changed[c].alias(c) if c in changed else F.col(row).getField(c).alias(c)
            for c in columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or something like it that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's modules, once a session, however the driver came by them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="corpus-")) / f"{package.name}_modules.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_IN_A_BATCH = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends Python at most TEXTS_IN_A_BATCH rows at a time.

    A batch is held by the executor and by the worker, for each task; Spark's own 10,000 rows are tens
    of MB of texts in both.  A smaller setting of the session stays, and afterwards the session has its own again.
    """
    before = spark.conf.get(BATCH_ROWS, None)
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXTS_IN_A_BATCH:
        spark.conf.set(BATCH_ROWS, TEXTS_IN_A_BATCH)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage, outlives any executor, and tells the optimizer the true size.
    """
    path = f"{shared_folder(df.sparkSession)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gapless_rank(rows: DataFrame, groups: list[str], part: Column, order: list[str], name: str
                 ) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each group, however large the group is.

    ``rows`` must be stable (written), as they are read twice.  ``part`` splits a group into parts
    of a fixed number and even size, and ascends with ``order`` (the head of a hash that rows
    are ordered by).  A part is ranked on its own and starts where the parts before it end, so
    the running total reads one row for each part.  Columns of ``groups`` may hold nulls.
    """
    dealt = rows.withColumn("__part", part)
    counts = dealt.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"__key_{c}") for c in groups], F.col("__part").alias("__key_part"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*groups, "__part").orderBy(*order)
    ranked = dealt.withColumn("__i", F.row_number().over(within) - 1)
    same = F.col("__part") == F.col("__key_part")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return ranked.join(starts, same).select(
        *rows.columns, (F.col("__start") + F.col("__i")).alias(name))


def bit_words(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """A filter of ``bits`` bits over hashes: rows (word, mask), at most ``bits / 64`` of them."""
    bucket = F.pmod(key, F.lit(bits))
    return (
        keys.select(F.shiftright(bucket, 6).alias("word"),
                    _one_bit(bucket).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("mask"))
    )


def _one_bit(bucket: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"),
                           bucket.bitwiseAND(F.lit(63)).cast("int"))


def passes(df: DataFrame, key: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether the bit of ``key`` is set in ``words``.

    The filter is broadcast: its size is bounded by ``bits``, whatever the corpus.
    """
    bucket = F.pmod(key, F.lit(bits))
    bounded = F.broadcast(words.withColumnsRenamed({"word": "__word", "mask": "__mask"}))
    hit = F.col("__mask").bitwiseAND(_one_bit(bucket)) != 0
    return (
        df.join(bounded, F.shiftright(bucket, 6) == F.col("__word"), "left")
        .withColumn(name, F.coalesce(hit, F.lit(False)))
        .drop("__word", "__mask")
    )
