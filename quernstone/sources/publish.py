"""Versioned tables on plain storage: write a new version, check it, then move a pointer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


class CountError(RuntimeError):
    """A count gate failed; what was published before stays."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, base: str) -> str | None:
    """Path of the published version, by any file system that Hadoop knows."""
    fs, path = _fs(spark, base)
    if not fs.exists(path(f"{base}/{POINTER}")):
        return None
    return f"{base}/{spark.read.text(f'{base}/{POINTER}').first()[0]}"


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    path = current(spark, base)
    return spark.read.parquet(path) if path else None


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """One small file, on any file system that Hadoop knows."""
    fs, p = _fs(spark, path)
    out = fs.create(p(path), True)
    out.write(bytearray(data))
    out.close()
    return path


def _replace(spark: SparkSession, fs, source, target) -> None:
    """Rename over what is there in one step, so that a reader always finds a pointer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def publish(df: DataFrame, base: str, expected: int | None = None, keep: int = 1, partition_by: tuple[str, ...] = ()) -> str:
    """Write, count, switch, prune. A mismatch with ``expected`` raises and leaves the published version as it is."""
    spark = df.sparkSession
    fs, path = _fs(spark, base)
    name = f"v={time.time_ns()}"
    df.write.partitionBy(*partition_by).parquet(f"{base}/{name}")
    if expected is not None and (found := spark.read.parquet(f"{base}/{name}").count()) != expected:
        fs.delete(path(f"{base}/{name}"), True)
        raise CountError(f"{found} rows written, {expected} expected")
    out = fs.create(path(f"{base}/{POINTER}.new"), True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    _replace(spark, fs, path(f"{base}/{POINTER}.new"), path(f"{base}/{POINTER}"))
    old = sorted(s.getPath().getName() for s in fs.listStatus(path(base)) if s.getPath().getName().startswith("v="))
    for v in old[: max(0, len(old) - keep)]:
        if v != name:
            fs.delete(path(f"{base}/{v}"), True)
    return f"{base}/{name}"
