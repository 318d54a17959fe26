"""Resumable stages: tables written once to a run's folder, then read by what follows."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST = "_manifest.json"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder, one a session.  On a cluster every executor would
    write to a disk of its own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="cohortwise-")
    return _local_folders[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path`` (it has a success marker)."""
    files, marker = _file_system(spark, path.rstrip("/") + "/_SUCCESS")
    return files.exists(marker)


def read_or_compute(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    recompute: bool = True,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Resumable stage: reuse the table at ``path``, or compute and write it."""
    if recompute or not table_exists(spark, path):
        df = compute()
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def snapshot(spark: SparkSession, path: str) -> dict[str, int]:
    """What tells one state of an input from another: bytes, files and time of the last change."""
    files, where = _file_system(spark, path)
    summary = files.getContentSummary(where)
    return {"bytes": summary.getLength(), "files": summary.getFileCount(),
            "changed": files.getFileStatus(where).getModificationTime()}


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the stage at ``path``; None if there is none, or none that can be read."""
    files, where = _file_system(spark, f"{path}/{MANIFEST}")
    if not files.exists(where):
        return None
    source = files.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _commit_manifest(spark: SparkSession, path: str, manifest: Mapping) -> None:
    """Written beside its place and renamed, so that it is there whole or not at all."""
    files, draft = _file_system(spark, f"{path}/.{uuid.uuid4().hex}.json")
    sink = files.create(draft)
    sink.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    sink.close()
    _, place = _file_system(spark, f"{path}/{MANIFEST}")
    files.delete(place, False)
    if not files.rename(draft, place):
        raise OSError(f"the manifest of {path} can't be committed")


def fingerprinted(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    spec: Mapping[str, object],
    inputs: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Resumable stage that knows what it was made of.

    Beside its table a stage has a manifest of ``spec`` (any JSON: parameters, the version of a rule), the
    schema of the result and a snapshot of each input folder or file.  It is reused if all of that is the same
    today; a changed one is computed anew into a folder of its own, and the manifest, committed last, names
    the folder that counts.  So a stage that was only half written, or that a reader of the former one still
    reads, is never taken for the present one.  ``options`` are those of the writer (the size of row groups).
    """
    path = path.rstrip("/")
    df = compute()
    made_of = {
        "spec": json.loads(json.dumps(spec, sort_keys=True, default=str)),
        "schema": json.loads(df.schema.json()),
        "inputs": {i: snapshot(spark, i) for i in inputs},
    }
    manifest = read_manifest(spark, path)
    if manifest is None or manifest["made_of"] != made_of or not table_exists(
            spark, f"{path}/{manifest['data']}"):
        digest = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()[:16]
        manifest = {"made_of": made_of, "data": f"{digest}-{uuid.uuid4().hex[:8]}"}
        df.write.options(**(options or {})).parquet(f"{path}/{manifest['data']}")
        _commit_manifest(spark, path, manifest)
    schema = T.StructType.fromJson(made_of["schema"])
    return spark.read.schema(schema).parquet(f"{path}/{manifest['data']}")
