"""Lines with their physical numbers, from text files, table columns and standard input."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import batched
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared

#: Splits up to which their table is broadcast (about 100 bytes each); with more it is joined by a shuffle.
BROADCAST_SPLITS = 200_000
#: Lines of standard input that the driver holds at once.
CHUNK_LINES = 100_000
#: Parts up to which an input counts as small, whatever the cluster.
SMALL_PARTS = 32


def _scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """text, file, block (where the row's split begins) and mid, which counts up in a split."""
    rows = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else list(paths))
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return rows.select(F.col("value").alias("text"), *place, F.monotonically_increasing_id().alias("mid"))


def split_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, block, first and base of each split of text files: where its rows begin to count, and the lines before it.

    Making it reads the files once. Saved (shared.save), it serves every read_lines of the same files in a session.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = _scan(spark, paths).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    return counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def read_lines(spark: SparkSession, paths: str | Sequence[str], splits: DataFrame | None = None) -> DataFrame:
    """file, line_no (from 1) and text of text files, plain or compressed (.gz, .bz2).

    Only a line feed ends a line, so a carriage return stays in the text and an unterminated last line counts. Spark
    doesn't number lines of files that it reads in splits: the lines of each split are counted first, and a line's number
    is the sum of the splits before its own plus its place there. splits: what split_table gave, to spare that count; a
    table of other splits ends the run with an error. The lines of a few large splits, as of compressed files, are dealt
    to all cores.
    """
    rows = _scan(spark, paths)
    splits = split_table(spark, paths) if splits is None else splits
    if rows.rdd.getNumPartitions() <= BROADCAST_SPLITS // 10:  # a task reads a few splits
        splits = F.broadcast(splits)
    wrong = F.raise_error(F.lit("the table is of other splits")).cast("long")
    number = F.coalesce(F.col("base"), wrong) + F.col("mid") - F.col("first") + 1
    out = rows.join(splits, ["file", "block"], "left").select("file", number.alias("line_no"), "text")
    return spread(out, "line_no", rows.rdd.getNumPartitions())


def read_splits(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, block, mid and text of text files: lines that get their numbers later, from one scan.

    block is where a line's split begins and mid counts up in it. Whoever counts the lines of each split while using them
    (index.split_postings does) has what numbers need: a line's number is the lines of the splits before, and mid less the
    least mid of its split, plus 1.
    """
    rows = _scan(spark, paths)
    return spread(rows.select("file", "block", "mid", "text"), "mid", rows.rdd.getNumPartitions())


def spread(df: DataFrame, key: str | None = None, parts: int | None = None) -> DataFrame:
    """df over all cores if it comes in a few parts, such as one small or unsplittable file; any other df as it is.

    Extraction costs far more than moving a line, but an input of many splits is never moved. key: a column of many
    values, by which rows are dealt without being sorted first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions() if parts is None else parts
    return df.repartition(cores, *([key] if key else [])) if parts < min(cores, SMALL_PARTS) else df


def file_sizes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file (as lines name it) and bytes of files, without reading them."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))


def opened(files: Iterable[str]) -> list[str]:
    """Paths to open for files as lines name them, in which special characters are escaped."""
    return [unquote(f) for f in files]


def column_lines(df: DataFrame, text: Column | str, file: Column | str) -> DataFrame:
    """file, line_no and text of the lines of a text column. What follows the last line feed is a line if it isn't empty."""
    text, file = (F.col(x) if isinstance(x, str) else x for x in (text, file))
    parts = F.split(text, "\n")
    lines = df.select(file.cast("string").alias("file"), F.posexplode(parts).alias("pos", "text"), F.size(parts).alias("n"))
    lines = lines.filter((F.col("text") != "") | (F.col("pos") < F.col("n") - 1))
    return lines.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def stream_lines(spark: SparkSession, lines: Iterable[str], file: str = "-", chunk: int = CHUNK_LINES) -> DataFrame:
    """file, line_no and text of lines at hand, such as those of standard input.

    They are written to the shared folder a chunk at a time, so the driver never holds them all.
    """
    schema = "file string, line_no long, text string"
    place = shared.new_path(spark, "lines")
    spark.createDataFrame([], schema).write.parquet(place)
    for part in batched(enumerate(lines, 1), chunk):
        rows = [(file, k, x.removesuffix("\n")) for k, x in part]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(place)
    return spark.read.schema(schema).parquet(place)
