"""Helpers shared by the corpus operators: shared folders, checkpoints, folds and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word pattern; Java regex and numpy code both follow it.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="siftloom-")
    sc.setCheckpointDir(folder)
    return f"file://{folder}"


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint, so later jobs neither recompute nor depend on one executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """As cut, dealt by a column into partitions that later plans know of, so that they group by it without another shuffle.

    Only a plan that isn't adaptive hands its partitioning on to what is read back.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    dealt = df.repartition(partitions, column)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(dealt)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced; else they stay until the driver happens to collect garbage.

    The driver's free memory goes back to the system as well.
    """
    gc.collect()
    give_back()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    # the many short-lived threads of plans leave freed native memory with the driver's C library, which gives it back only when asked
    if tool := shutil.which("jcmd"):
        subprocess.run([tool, str(jvm.java.lang.ProcessHandle.current().pid()), "System.trim_native_heap"], capture_output=True, timeout=60, check=False)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/siftloom-{name}-{uuid.uuid4().hex[:12]}"


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def word_array(text: Column) -> Column:
    """Non-empty words of a text as an array; null text has none. JVM only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def text_slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a batch so that each part holds about `limit` bytes of text (one longer text is a part alone).

    Yields (first row, row behind the last, bytes, offsets); null texts are empty.
    """
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def planes(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, so that the empty high bytes of small numbers lie together and compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: pa.Buffer | bytes, kind: np.dtype) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def lean(spark: SparkSession) -> None:
    """Bound the Arrow batches that texts travel in by rows and bytes, where the session has Spark's defaults: they are held by the JVM and the worker alike."""
    for name, default, bound in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, str(8 << 20))):
        key = f"spark.sql.execution.arrow.{name}"
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, bound)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with what it has, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def trimmed(run: Callable) -> Callable:
    """An Arrow iterator function that returns its memory when its partition ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def trimmed_groups(run: Callable, least: int = 1 << 20) -> Callable:
    """An Arrow group function that returns its memory after groups of `least` bytes or more."""

    def wrapped(table):
        out, size = run(table), table.nbytes
        if size >= least:
            del table
            give_back()
        return out

    return wrapped


BITMAP_BITS = 1 << 25


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (4 MB) of a bigint column's hashes; with more keys than it can tell apart it only lets more rows through."""
    from siftloom.llm.bytescan import mix

    schema = pa.schema([("bitmap", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(BITMAP_BITS >> 3, np.uint8)
        for batch in batches:
            h = mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(BITMAP_BITS)
            np.bitwise_or.at(bitmap, (h >> np.uint64(3)).astype(np.int64), np.left_shift(1, (h & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield batch_of(schema, [[bitmap.tobytes()]])

    bitmap = np.zeros(BITMAP_BITS >> 3, np.uint8)
    for row in keys.coalesce(4).mapInArrow(mark, "bitmap binary").toLocalIterator():
        bitmap |= np.frombuffer(row["bitmap"], np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the bitmap; never false for one that is."""
    from siftloom.llm.bytescan import mix

    h = mix(keys.view(np.uint64)) % np.uint64(BITMAP_BITS)
    return (bitmap[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
