"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set before.

    Only a local session (a test), in which they are one process, gets a temporary folder where neither is set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


#: Bytes of an Arrow batch on its way to Python and back; a task holds a few of them.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: 10,000 rows of long texts would be far more."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidied(run):
    """run (a function for mapInArrow) that gives memory back at the end: an idle Python worker keeps what it once had."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return memory that this process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in shared_folder()."""
    shared_folder(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Free the disk of the shuffles and checkpoints that nothing refers to any more; Spark itself waits for the driver to collect its garbage."""
    for _ in range(3):  # Python's references reach the JVM a little later, and its cleaner works behind
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def null_safe_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its n rows (n + 1 of them); null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return body, ends - ends[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose text column holds at most most_bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def append_columns(df: DataFrame, make, fields: str, most_bytes: int = 4 << 20, column: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with further columns computed in Arrow batches.

    make() is called once in each task and returns a function from a record batch (whose text column
    holds at most most_bytes, or one row) to the arrays of the new columns. Columns of df that have
    a new column's name, or are in drop, are left out of the result.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    named = {f.name for f in new.fields} | set(drop)
    own = [f for f in df.schema.fields if f.name not in named]
    keep = [f.name for f in own]

    def run(batches):
        work = None
        for batch in sliced(batches, column, most_bytes):
            work = work or make()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *work(batch)], names=[*keep, *(f.name for f in new.fields)])

    small_batches(df.sparkSession)
    return df.mapInArrow(tidied(run), StructType([*own, *new.fields]))


class Recent:
    """A cache of two generations: what was met lately stays, and at most 2 * limit and a batch are held."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that aren't known; the others can then be read from .new until the next call."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        keys = keys.difference(self.new)
        if self.old:
            old = self.old
            again = [k for k in keys if k in old]
            self.new.update((k, old[k]) for k in again)
            keys.difference_update(again)
        return list(keys)
