"""Shared plumbing: the shared scratch folder, lineage cuts, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Rows of a narrow table (ids, or ids with a few numbers: tens of bytes a row) that may be broadcast.
BROADCAST_ROWS = 400_000

_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Bytes from which on an Arrow batch ends, whatever its rows; a single text may be longer.
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()

#: A-Z to a-z and nothing else, as the tokenisation contracts ask.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application.

    Spark's own file server hands the archive to every executor, late ones included.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="quernstone-")) / "quernstone_llm.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in top.rglob("*.py"):  # the whole package, so that the archive hides nothing of it
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(archive))
    if spark.conf.get(_BATCH) == "10000":  # Spark's default; rows here are whole texts
        spark.conf.set(_BATCH, "2000")
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    if spark.conf.get(_READ) == "4096":  # Spark's default too
        spark.conf.set(_READ, "512")
    return spark


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, handing freed memory back to the system now and then and at its end.

    Python workers outlive their tasks; what their allocators keep would add up beside the executor's heap.
    """

    def trimmed(batches):
        for n, out in enumerate(run(batches), 1):
            yield out
            if n % 64 == 0:
                trim()
        trim()

    return trimmed


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_made: list[tuple[str, str]] = []  # names and paths of the tables that materialise wrote


def materialise(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs a re-read, not a recompute,
    and iterative plans stay short. tidy: the shuffle files of the plans that
    are done may go now. Spark deletes them once the driver's JVM has collected
    the plans, which by itself may be half an hour later.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark.sparkContext.applicationId, path))
    if tidy:
        del df
        for _ in range(2):  # the second frees what the first made unreachable
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._table = path
    return out


def mark() -> int:
    """The place of the next table that materialise writes, for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables that were written since ``mark()`` said ``since``, once all that reads them has been written; ``keep`` stays."""
    stay = {x._table for x in keep}
    sc = spark.sparkContext
    for made in _made[since:]:
        if made[0] == sc.applicationId and made[1] not in stay:
            folder = sc._jvm.org.apache.hadoop.fs.Path(made[1])
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
            _made.remove(made)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, lists: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; beyond that the join shuffles. For narrow tables in the shared folder.

    lists: a column of lists of numbers; each ten of them count as a row.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    if lists and (df.agg(F.count("*") + F.sum(F.size(lists)) / 10).first()[0] or 0) > rows:
        return df
    return F.broadcast(df)


def rehash(c: Column | str) -> Column:
    """The same 64-bit value as a new expression.

    A join on it gets an exchange of its own on both sides instead of reusing
    the layout of an aggregation below, which lets adaptive execution split a
    skewed key.
    """
    c = F.col(c) if isinstance(c, str) else c
    return c.bitwiseXOR(F.lit(0).cast("long"))


def crc_mod(c: Column, m: int) -> Column:
    """``crc32`` of the value as text, modulo ``m``; null counts as the empty string."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, which keeps the arrays of a range in the cache; a longer row makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
