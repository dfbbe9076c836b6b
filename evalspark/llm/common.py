"""Helpers shared by the corpus operators: tables in the shared folder, Arrow
string buffers, file shipping."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/evalspark-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the
    lineage so that a lost executor costs a re-read, not a recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` as one file below the shared folder through Spark's file
    system layer; returns its path."""
    path = f"{shared_path(spark, name)}.bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


BATCH_BYTES = 16 << 20  # of an Arrow batch for the Python workers, about


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with this package importable in the Python workers, and with Arrow
    batches of at most ``BATCH_BYTES`` where the session does not ask for smaller ones:
    rows are whole texts, and their number says nothing about a batch's size."""
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting, str(64 << 20)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    return spark


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a mapInArrow that gives the memory it has freed back to the system when
    the task ends: Spark keeps its Python workers for the tasks of later stages, and what
    their allocators hold on to counts for the executor all that time."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def give_back() -> None:
    """Return free memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def utf8_views(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column (null: empty)."""
    data, offsets = utf8_buffers(column)
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(raw[a:b])


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def hash_sample(rows: DataFrame, by: str, hashed: str, counts: dict, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by``: those with the smallest values of the
    long column ``hashed`` (a hash, no two rows of a value alike but by chance, for the
    bound counts on that). ``counts`` are the rows of each value; from them a
    bound on the hash follows, so that tasks pass on about n rows a value in all, not n
    each. Where a value has n rows or fewer, all of them."""
    bounds = {k: int((1 << 64) * min(1.0, (n + 6 * n ** 0.5) / max(c, 1))) - (1 << 63) for k, c in counts.items()}
    if not bounds:
        return rows.limit(0)
    entries = [F.lit(x) for k, b in bounds.items() for x in (k, min(b, (1 << 63) - 1))]
    few = rows.where(F.col(hashed) <= F.create_map(*entries)[F.col(by)])
    order = Window.partitionBy(by).orderBy(hashed, *(c for c in rows.columns if c not in (by, hashed)))
    return few.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of tables that nothing refers to any
    more; it learns of them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
