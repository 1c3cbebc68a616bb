"""Files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="netquarry-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _place(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted by the file system when the driver ends."""
    path = f"{root(spark)}/netquarry/{name}-{uuid.uuid4().hex}"
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a reader of what was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def write_one_file(rows: DataFrame, path: str) -> None:
    """Write rows (one string column), in their order, as one text file at path, which is replaced.

    Tasks write parts beside it; the parts are then copied after each other, a buffer at a time.
    """
    spark = rows.sparkSession
    place, store = _place(spark, path)
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    rows.write.text(parts, lineSep="\n")
    folder, _ = _place(spark, parts)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    out = store.create(place, True)
    try:
        for status in sorted(store.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = store.open(status.getPath())
                try:
                    hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
        store.delete(folder, True)
