"""Published files and their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.config import RunConfig

FOLDER = "period"


def output_name(prefix: str, run: RunConfig) -> str:
    """Deterministic name: prefix, run month, minimum age, version of the data if there is one."""
    month = f"{run.run_year}_{run.run_month:02d}"
    version = [run.dataset_version] if run.dataset_version else []
    return "_".join([prefix, month, f"{run.min_age}+", *version])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated files with a header line and no row numbers."""
    df.write.mode(mode).option("header", True).csv(path)


def write_periods(
    df: DataFrame, path: str, key: str = "TimePeriodLabel", file_format: str = "csv",
    mode: str = "overwrite",
) -> None:
    """One folder per period, whose files hold all columns, the period as well.

    Rebalancing brings the rows of a period together and lets adaptive
    execution split a period too large for one task.
    """
    copied = df.withColumn(FOLDER, F.col(key))
    writer = copied.hint("rebalance", FOLDER).write.mode(mode).partitionBy(FOLDER)
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(file_format).save(path)


def write_bounded_periods(
    df: DataFrame, path: str, order: Sequence[str], max_rows: int, key: str = "TimePeriodLabel",
    mode: str = "overwrite",
) -> None:
    """One folder per period with files of at most ``max_rows`` rows, in order within the period.

    Rows are dealt to tasks by ranges of (period, ``order``), so a hot period is cut into ranges as any other, and
    each task writes its range sorted.  Files of a period in order of their names hold its rows in
    ``order`` (nulls first): a period's ranges follow each other by task, and a task's files by number.
    """
    copied = df.withColumn(FOLDER, F.col(key))
    place = [FOLDER, *order]
    ranged = copied.repartitionByRange(*[F.col(c) for c in place]).sortWithinPartitions(*place)
    ranged.write.mode(mode).partitionBy(FOLDER).option("header", True).option("escape", '"').option(
        "maxRecordsPerFile", max_rows).csv(path)


def read_periods(spark: SparkSession, path: str, period: str | None = None) -> DataFrame:
    """Published CSV files as they are, of all periods or of one: texts, as the header names them."""
    folder = path if period is None else f"{path.rstrip('/')}/{FOLDER}={period}"
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    return reader.option("multiLine", True).option("escape", '"').csv(folder)
