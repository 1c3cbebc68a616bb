"""Stored indexes that change: addresses taken out, files indexed anew, logs that grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..sources.follow import read_ranges, tails
from ..sources.lines import file_sizes, opened, read_splits
from ..sources.store import write_split_index
from .index import split_postings, with_bases, with_numbers
from .search import NAMED_FILES, small, wanted

#: Bytes that the list of files has for one that is gone.
GONE = -1
#: Names of files that are compressed, which have no byte ranges.
PACKED = "[.](gz|gzip|bz2|zst|lz4|snappy|deflate|xz)$"


def without(index: DataFrame, terms: DataFrame) -> DataFrame:
    """index but for the records of the addresses that terms name; whole addresses, letter case included."""
    return index.join(wanted(terms), "address", "left_anti")


def replaced(index: DataFrame, newer: DataFrame) -> DataFrame:
    """A per-file index with the records of newer, a stored one, instead of its own of the same files.

    The files that only one of the two has stay, so this adds files too. Records of a file don't depend on other files,
    so nothing is aggregated or moved again. Write the result to a new place: the old one is read while it is made.
    """
    return index.join(small(newer.select("file").distinct()), "file", "left_anti").unionByName(newer)


def _runs(spark: SparkSession, place: str) -> DataFrame:
    """file, run, since, bytes and tail: what each run says of the files that it has read or missed."""
    run = F.regexp_extract(F.col("_metadata.file_path"), "run=([0-9]+)", 1).cast("int").alias("run")
    return spark.read.parquet(f"{place}/run=*/files").select("*", run)


def live_files(spark: SparkSession, place: str) -> DataFrame:
    """file, run, since, bytes and tail of the files that a growing index holds, as the last run that names a file has it.

    since: the run that read the file from its start; those after it read what was added. tail: the checksum of the last
    bytes before the length that was read; null where a later run can't go on there.
    """
    last = _runs(spark, place).groupBy("file").agg(F.max_by(F.struct("run", "since", "bytes", "tail"), "run").alias("x"))
    return last.select("file", "x.*").filter(F.col("bytes") != GONE)


def refresh(spark: SparkSession, place: str, paths: str | Sequence[str], dialect: str = "ref") -> int:
    """Bring the index at place up to date with the files at paths; return how many files were read for it.

    Each call is a run, which reads the files that are new or whose size is another than the run before them found, and
    writes their postings and the list of what changed. Of a file that was ended by a line feed and has grown, with the
    same bytes before its old end, only what was added is read. Others, compressed ones among them, are read from their
    start. Nothing else is read or written again, so a run costs what was added, and one that fails midway is repeated
    under the same number: its list, written last, is what makes it count.
    """
    known = shared.exists(spark, f"{place}/run=0")
    runs = 0
    while shared.exists(spark, f"{place}/run={runs}/files/_SUCCESS"):
        runs += 1
    now = shared.save(file_sizes(spark, paths), "sizes")
    none = spark.createDataFrame([], "file string, run int, since int, bytes long, tail long")
    held = shared.save(live_files(spark, place), "held") if known and runs else none
    was = held.select("file", F.col("bytes").alias("had"), "since", F.col("tail").alias("had_tail"))
    changed = shared.save(now.join(was, "file", "left").filter(~F.col("bytes").eqNullSafe(F.col("had"))), "changed")
    gone = shared.save(held.join(now, "file", "left_anti").select("file"), "gone")
    if changed.isEmpty() and gone.isEmpty():
        return 0
    # What stands before the old end now, of the files that have grown.
    longer = changed.filter("had_tail is not null and bytes > had")
    same = tails(longer.select("file", F.col("had").alias("bytes"))).select("file", F.col("tail").alias("now_tail"))
    state = changed.join(same, "file", "left").withColumn("added", F.coalesce(F.col("now_tail") == F.col("had_tail"), F.lit(False)))
    # A file that was written to while it was read whole is read by ranges, which end where this run saw it end.
    plain = ~F.col("file").rlike(PACKED)
    moving = plain & F.col("had").isNotNull() & F.col("had_tail").isNull()
    start = F.when(F.col("added"), F.col("had")).when(moving, F.lit(0).cast("long"))
    todo = shared.save(state.select("file", "bytes", start.alias("start"), F.when(F.col("added"), F.col("since")).otherwise(runs).alias("since")), "todo")
    read = todo.filter(F.col("bytes") > 0)
    here = f"{place}/run={runs}"
    names = [r["file"] for r in read.filter("start is null").select("file").limit(NAMED_FILES + 1).collect()]
    rows = read_ranges(read.filter("start is not null").select("file", "start", F.col("bytes").alias("stop")))
    if len(names) > NAMED_FILES:
        rows = rows.unionByName(read_splits(spark, paths).join(small(read.filter("start is null").select("file")), "file", "left_semi"))
    elif names:
        rows = rows.unionByName(read_splits(spark, opened(names)))
    if not read.isEmpty():
        write_split_index(split_postings(rows, dialect), here, "overwrite")
    # Spark may have read more of a file than was seen before, if it grew meanwhile: no later run can go on there.
    after = file_sizes(spark, paths).select("file", F.col("bytes").alias("then"))
    steady = read.join(after, "file").filter(plain & (F.col("start").isNotNull() | (F.col("then") == F.col("bytes"))))
    ends = tails(steady.select("file", "bytes")).select("file", "tail")
    listed = todo.join(ends, "file", "left").select("file", F.col("since").cast("int").alias("since"), "bytes", "tail")
    missed = gone.select("file", F.lit(runs).alias("since"), F.lit(GONE).cast("long").alias("bytes"), F.lit(None).cast("long").alias("tail"))
    listed.unionByName(missed).write.mode("overwrite").parquet(f"{here}/files")
    return read.count()


def read_grown(spark: SparkSession, place: str) -> DataFrame:
    """file, address, kind, bucket, n and locations of a growing index: of each file what its runs have found since it was
    read from its start, with line numbers by all of them."""
    run = F.regexp_extract(F.col("_metadata.file_path"), "run=([0-9]+)", 1).cast("int").alias("run")
    since = live_files(spark, place).select("file", F.col("since").alias("_from"))
    live = _runs(spark, place).join(since, "file").filter(F.col("run") >= F.col("_from")).select("file", "run")
    live = small(shared.save(live, "live"))
    splits = spark.read.parquet(f"{place}/run=*/splits").drop("base").select("*", run).join(live, ["file", "run"], "left_semi")
    places = spark.read.parquet(f"{place}/run=*/places").select("*", run).join(live, ["file", "run"], "left_semi")
    return with_numbers(places.drop("run"), small(shared.save(with_bases(splits.drop("run")), "live-splits")))
