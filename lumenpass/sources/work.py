"""Tables written on the way: to the folder that all executors share, so that they survive the loss of any."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
_PATHS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without that setting (tests) a temporary one.

    On a cluster the setting is needed: a folder of one machine would lose data, so its lack is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="lumenpass-")
        spark.sparkContext.setCheckpointDir(_OWN_FOLDER[app])
    return _OWN_FOLDER[app]


def work_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def release(spark: SparkSession) -> None:
    """Delete what was written on the way in this session; results that read it can't be read any more."""
    while _PATHS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can hold in a Python worker; smaller bounds of the caller's stay."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 32 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives the loss of an executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Small files on whatever store a path names


def _at(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _at(spark, path)
    return store.exists(there)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Paths right under a folder, by name; none if it is missing."""
    store, there = _at(spark, folder)
    if not store.exists(there) or not store.getFileStatus(there).isDirectory():
        return []
    return sorted(f"{folder.rstrip('/')}/{s.getPath().getName()}" for s in store.listStatus(there))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small text file; None if it is missing."""
    store, there = _at(spark, path)
    if not store.exists(there):
        return None
    opened = store.open(there)
    try:
        return bytes(opened.readAllBytes()).decode("utf-8")
    finally:
        opened.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Overwrites a small text file; folders on the way are made."""
    store, there = _at(spark, path)
    out = store.create(there, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
