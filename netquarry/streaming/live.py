"""The index over a stream of lines: counts in state, places to an append-only sink."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .. import shared
from ..functions.addresses import addresses
from ..operators import index as ix
from ..operators.search import small
from ..sources import lines as src
from ..sources import store


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """file and text of lines added to the files of a folder."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def live_occurrences(lines: DataFrame, dialect: str = "ref", *keep: str) -> DataFrame:
    """kind, address and field of each address in a stream of lines, with the columns in keep."""
    rows = lines.select(*keep, F.explode_outer(addresses("text", dialect)).alias("x")).filter(F.col("x").isNotNull())
    return rows.select(*keep, "x.kind", "x.address", "x.field")


def live_counts(lines: DataFrame, dialect: str = "ref") -> DataFrame:
    """address, kind and n so far: state is one number for each address. Use output mode update or complete."""
    return live_occurrences(lines, dialect).groupBy("address", "kind").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(lines: DataFrame, time: str, late: str, width: str, dialect: str = "ref") -> DataFrame:
    """address, kind and n in each time window; state older than the watermark is dropped."""
    found = live_occurrences(lines.withWatermark(time, late), dialect, time)
    return found.groupBy(F.window(time, width), "address", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "address", "kind", "n")


def aged(lines: DataFrame, time: str, late: str, idle: str, dialect: str = "ref") -> DataFrame:
    """address, kind, first_seen, last_seen and n of addresses that age out: not seen for longer than idle.

    Use output mode append: a record comes once, when the watermark has passed its last time by idle, and its state is
    dropped then. An address that is seen again later begins a new record. Rows later than late behind the newest are
    dropped when their own record would have aged out. State is a row for each address that is not aged out, whatever
    the log's length; with spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition set, which write_aged
    does, a frequent address is merged before it is shuffled.
    """
    found = live_occurrences(lines.withWatermark(time, late), dialect, time)
    spans = found.groupBy(F.session_window(time, idle).alias("span"), "address", "kind")
    seen = F.min(time).alias("first_seen"), F.max(time).alias("last_seen")
    return spans.agg(*seen, F.count(F.lit(1)).alias("n")).select("address", "kind", "first_seen", "last_seen", "n")


def write_aged(records: DataFrame, path: str, checkpoint: str):
    """A writer, to be started, that appends the records of aged as Parquet. It sets the local merge for the session."""
    records.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return records.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def write_followed(stream: DataFrame, path: str, checkpoint: str, dialect: str = "ref"):
    """A writer, to be started, of the postings of a stream of follow: a step writes a folder of path, again if it is repeated.

    Each step indexes the lines that were added; numbers are put in by read_followed, which knows the lines of all steps.
    """

    def step(batch: DataFrame, number: int) -> None:
        store.write_split_index(ix.split_postings(batch, dialect), f"{path}/step={number}", "overwrite")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def read_followed(spark: SparkSession, path: str) -> DataFrame:
    """file, address, kind, bucket, n and locations of what write_followed wrote, with line numbers of whole files. For logs
    that were cut meanwhile, read the steps since then: a file's lines are counted over all steps in path."""
    splits = shared.save(ix.with_bases(spark.read.parquet(f"{path}/step=*/splits").drop("base")), "followed-splits")
    return ix.with_numbers(spark.read.parquet(f"{path}/step=*/places"), small(splits))


def write_postings(stream: DataFrame, path: str, checkpoint: str, dialect: str = "ref", files: int = 1000):
    """A writer, to be started, of the postings of files that arrive in a stream of read_stream, with their line numbers.

    Each step takes the files that are new, numbers their lines as read_lines does and writes one folder of path. A step
    that runs again writes the same folder again. files: new files in a step, the most that read_stream hands over.
    """

    def step(batch: DataFrame, number: int) -> None:
        names = [r["file"] for r in batch.select("file").distinct().limit(files + 1).collect()]
        if len(names) > files:
            raise ValueError(f"more than {files} files in a step; set maxFilesPerTrigger")
        if names:
            lines = src.read_lines(batch.sparkSession, src.opened(names))
            ix.postings(ix.occurrences(lines, dialect)).write.mode("overwrite").parquet(f"{path}/step={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


class Throughput(StreamingQueryListener):
    """Logs the lines that each step of a stream has read, and lines a minute. Register it with spark.streams.addListener."""

    def __init__(self, log: logging.Logger | None = None):
        self.log, self.lines = log or logging.getLogger("netquarry"), 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.log.debug("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        step = event.progress
        self.lines += step.numInputRows
        self.log.info("%d lines, %.0f lines a minute", self.lines, 60 * (step.processedRowsPerSecond or 0))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.log.debug("stream %s ended", event.id)
