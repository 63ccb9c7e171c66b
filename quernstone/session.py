"""The session that the engine expects (UTC, adaptive execution, ANSI casts), the shared folder and what is kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "quernstone") -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.ansi.enabled", "true").config("spark.sql.python.filterPushdown.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a private folder; any other raises,
    as its executors couldn't read one another's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quernstone-"))
    return f"file://{_own_dir[0]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, however often it is used, and not lost with an executor."""
    path = f"{scratch_dir(df.sparkSession)}/quernstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_hand(df: DataFrame, most: int) -> DataFrame:
    """A list of at most ``most`` rows, computed once and planned from there as a local relation. More rows raise."""
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return df.sparkSession.createDataFrame(table, df.schema)
