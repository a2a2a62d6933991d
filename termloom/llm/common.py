"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="termloom-")
        shared_folder.own = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote of df, once nothing reads it any more."""
    if path := getattr(df, "stored_at", None):
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables of loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """A key that, with doc_id, tells rows of one id apart by their text."""
    return F.xxhash64(text)


#: Bytes that Spark hands to a Python worker at once, about (its default is 64 MB, held several times over).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow for rows that hold texts or vectors, in batches of bounded size (a setting of the session from then on)."""
    df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows of batches, about size bytes of text at a time, one row at least: what a worker makes of them stays as small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0)
        ends, start = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()
