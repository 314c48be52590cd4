"""Sinks: append, partitioned snapshots and all-or-nothing replacement."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that ``df`` holds: running a week twice gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _files(spark: SparkSession, path: str):
    """(java Path of ``path``, its FileContext)."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there, jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    there, _ = _files(spark, path)
    return bool(there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there))


def publish(df: DataFrame, path: str, dry_run: bool = False, keep: int = 2) -> int:
    """Write a new version under ``path`` and then move the pointer to it; rows written.

    Readers come through published() and see the old version or the new one, never half a table nor none: a version is
    complete before the pointer names it, and the pointer file is replaced by one rename. Versions before the last ``keep``
    are removed. A dry run computes everything and leaves ``path`` as it is.
    """
    spark = df.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    there, files = _files(spark, f"{path}/{version}")
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(f"{path}/{version}")
        rows = spark.read.parquet(f"{path}/{version}").count()
    except Exception:
        fs.delete(there, True)
        raise
    if dry_run:
        fs.delete(there, True)
        return rows
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    made, now = jvm.org.apache.hadoop.fs.Path(f"{path}/_{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    stream = fs.create(made, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    replace = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(made, now, replace)
    old = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path))) if n.startswith("v"))
    for name in old[: -max(1, keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return rows


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version that publish() last moved into place."""
    return spark.read.parquet(f"{path}/{_pointer(spark, path)}")


def _pointer(spark: SparkSession, path: str) -> str:
    there, _ = _files(spark, f"{path}/_current")
    stream = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(there)
    try:
        return bytes(stream.readNBytes(200)).decode()
    finally:
        stream.close()
