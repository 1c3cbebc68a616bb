"""Shared scratch tables: lineage is cut by writing to the folder every executor can see."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="netquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared root, deleted by the file system when the driver ends."""
    path = f"{shared_root(spark)}/netquarry/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving memory back to the system when a task ends; Spark keeps its Python workers."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return whole


#: Rows, and bytes, of whole texts that go to Python at once; a longer text goes alone.
TEXT_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def save(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write df once and return a reader of what was written, with df's schema. texts: df sends whole texts to Python, in small batches."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {key: spark.conf.get(key) for key in TEXT_LIMITS} if texts else {}
    for key in before:
        spark.conf.set(key, TEXT_LIMITS[key])
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*saved: DataFrame) -> None:
    """Delete tables returned by save(), once everything made from them has itself been written."""
    for df in saved:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
