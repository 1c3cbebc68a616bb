"""Command line: build indexes of log files, and search logs by them.

    python -m netquarry.cli index [-w | -p] [-s] FILE...
    python -m netquarry.cli search [-q] [-w OUT] TERM,TERM FILE...
    python -m netquarry.cli search [-q] [-w OUT] -f TERMFILE FILE...
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import shared
from .operators import index as ix
from .operators import search
from .paths import REFUSED, is_safe
from .sources import lines as src
from .sources import store, terms

#: Added to a log's name for its index. Fixed value of the format.
SUFFIX = ".lpi"
#: Added to that for the Parquet form, a folder.
PARQUET = ".parquet"
log = logging.getLogger("netquarry")


def level(text: str) -> int:
    n = int(text)
    if not 0 <= n <= 9:
        raise argparse.ArgumentTypeError("0 to 9")
    return n


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="netquarry")
    out.add_argument("-v", "--version", action="version", version="netquarry 0.1.0")
    every = argparse.ArgumentParser(add_help=False)
    every.add_argument("-d", "--debug", type=level, default=0, metavar="0-9")
    kinds = out.add_subparsers(dest="command", required=True)
    index = kinds.add_parser("index", parents=[every])
    index.add_argument("-w", "--write", action="store_true", help="write an index beside each log instead of printing one of all")
    index.add_argument("-p", "--parquet", action="store_true", help="write it as Parquet, in a folder, which large logs are searched by faster")
    index.add_argument("-s", "--serial", action="store_true", help="read with one task at a time")
    index.add_argument("-g", "--greedy", action="store_true", help="accepted, without effect")
    index.add_argument("files", nargs="+")
    find = kinds.add_parser("search", parents=[every])
    find.add_argument("-q", "--quick", action="store_true", help="report counts only")
    find.add_argument("-w", "--write", metavar="OUT", help="write the lines of all logs to one file")
    find.add_argument("-f", "--file", metavar="TERMFILE", help="one term a line; all other arguments are logs")
    find.add_argument("words", nargs="+", metavar="TERMS/FILE")
    return out


def index_of(path: str) -> str | None:
    """A log's index: its name with the suffix, or for a .gz log that of the name without the ending; Parquet before text."""
    names = [path + SUFFIX]
    if os.path.splitext(path)[1].startswith(".gz"):
        names.append(os.path.splitext(path)[0] + SUFFIX)
    return next((n + form for n in names for form in (PARQUET, "") if os.path.exists(n + form)), None)


def local(path: str) -> str:
    """A path of this machine as Spark takes it."""
    return "file://" + os.path.abspath(path)


def timed(lines: DataFrame, work: Callable[[DataFrame], None]) -> None:
    """Do work with lines and log how many there were, and how many a minute."""
    seen, began = Observation(), time.monotonic()
    work(lines.observe(seen, F.count(F.lit(1)).alias("lines")))
    n, seconds = seen.get["lines"], max(time.monotonic() - began, 1e-3)
    log.info("%d lines, %.0f lines a minute", n, 60 * n / seconds)


def run_index(spark: SparkSession, options: argparse.Namespace, refused: tuple[str, ...] = REFUSED) -> int:
    for f in options.files:
        if f != "-" and not is_safe(f, refused):
            log.error("refused: %s", f)
            return 1
    if "-" in options.files and (options.write or options.parquet):
        log.error("standard input has no name to write beside")
        return 1
    read = lambda f: src.stream_lines(spark, sys.stdin) if f == "-" else src.read_lines(spark, f)
    for f in options.files if options.write or options.parquet else ():
        if options.parquet:
            timed(src.read_splits(spark, local(f)), lambda rows, f=f: store.write_split_index(ix.split_postings(rows), local(f + SUFFIX + PARQUET), "overwrite"))
        if options.write:
            timed(read(f), lambda rows, f=f: store.write_text_file(ix.build_index(ix.occurrences(rows)), local(f + SUFFIX)))
    if options.write or options.parquet:
        return 0
    every = read(options.files[0])
    for f in options.files[1:]:
        every = every.unionByName(read(f))

    def show(rows: DataFrame) -> None:
        records = ix.by_count(store.format_records(ix.build_index(ix.occurrences(rows), per_file=False))).select("record")
        for row in shared.save(records, "records").toLocalIterator():  # one partition at a time, in order of its files
            print(row["record"])

    timed(every, show)
    return 0


def read_index(spark: SparkSession, place: str) -> DataFrame:
    """A log's index in any of its forms."""
    if not place.endswith(PARQUET):
        return store.read_text(spark, place)
    return store.read_split_index(spark, place) if shared.exists(spark, f"{place}/places") else store.read_parquet(spark, place)


def run_search(spark: SparkSession, options: argparse.Namespace, refused: tuple[str, ...] = REFUSED) -> int:
    words = list(options.words)
    if bad := next((f for f in (options.file, options.write) if f and not is_safe(f, refused)), None):
        log.error("refused: %s", bad)
        return 1
    if options.file:
        wanted = terms.file_terms(spark, options.file)
    else:
        wanted = terms.argument_terms(spark, words.pop(0))
    if not words:
        log.error("no log to search")
        return 1
    status, found = 0, []
    for f in words:
        place = index_of(f) if is_safe(f, refused) else None
        if place is None:
            log.error("no index of %s, or the path is refused", f)
            status = 1
            continue
        index = read_index(spark, local(place)).withColumn("file", F.lit(f))
        for row in search.quick(index, wanted).toLocalIterator():
            print(f"MATCH [{row['term']}] with {row['occurrences']} lines", file=sys.stderr)
        if not options.quick:
            hits = shared.save(search.hits(index, wanted), "hits")
            if not hits.isEmpty():  # a log without a hit is not read
                found.append(search.retrieve(src.read_lines(spark, local(f)).withColumn("file", F.lit(f)), hits))
    if found:
        every: DataFrame = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        every = every.orderBy("file", "line_no", "field").select("text")
        if options.write:
            shared.write_one_file(every, local(options.write))
        else:
            for row in every.toLocalIterator():
                print(row["text"])
    return status


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if options.debug else logging.INFO, stream=sys.stderr, format="%(message)s")
    session = SparkSession.builder.appName("netquarry")
    if getattr(options, "serial", False):
        session = session.master("local[1]")
    return (run_index if options.command == "index" else run_search)(session.getOrCreate(), options)


if __name__ == "__main__":
    sys.exit(main())
