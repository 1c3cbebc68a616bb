"""Lookups in an index and retrieval of the lines that it points at."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..sources.lines import file_sizes, opened, read_lines
from .index import occurrences

#: Rows up to which terms or hits are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Files up to which retrieval names those that it reads; with hits in more, all files of the log are read.
NAMED_FILES = 10_000
#: Files that a search for first places begins with.
FIRST_FILES = 64


def small(df: DataFrame) -> DataFrame:
    """df, a saved table or rows at hand, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def wanted(terms: DataFrame) -> DataFrame:
    """address: the distinct terms, which are read from where they are and counted, not what they are looked for in."""
    return small(terms.select(F.col("term").alias("address")).distinct())


def lookup(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Records of index whose address is a term: whole addresses, letter case included."""
    return index.join(wanted(terms), "address", "left_semi")


def quick(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term and occurrences in each file, without reading any line. index: of one row an address, or in buckets."""
    keys = ["file"] * ("file" in index.columns) + [F.col("address").alias("term")]
    return lookup(index, terms).groupBy(*keys).agg(F.sum("n").alias("occurrences"))


def missing(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that the index doesn't have."""
    return terms.select("term").distinct().join(index.select(F.col("address").alias("term")), "term", "left_anti")


def hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """file, term, line and field of every place of the terms. index: per file, whole or in buckets."""
    found = lookup(index, terms).select("file", F.col("address").alias("term"), F.explode("locations").alias("x"))
    return found.select("file", "term", "x.line", "x.field")


def retrieve(lines: DataFrame, found: DataFrame, distinct: bool = False) -> DataFrame:
    """The lines that hits point at: once for each hit, or once each if distinct.

    The hits are looked up once, into the shared folder; their number there tells how they are joined.
    """
    places = found.select("file", F.col("line").alias("line_no"), "term", "field")
    if distinct:
        places = places.select("file", "line_no").distinct()
    return lines.join(small(shared.save(places, "hits")), ["file", "line_no"])


def retrieve_files(spark: SparkSession, paths: str | Sequence[str], found: DataFrame, distinct: bool = False) -> DataFrame:
    """What retrieve gives, from the files at paths that hits point at; the others are not opened.

    found: file (as a scan names it), term, line and field. The hits are looked up once, and the files among them are named
    to the scan while they are few.
    """
    held = shared.save(found.select("file", "term", "line", "field"), "hits")
    names = [r["file"] for r in held.select("file").distinct().limit(NAMED_FILES + 1).collect()]
    if not names:
        return spark.createDataFrame([], "file string, line_no long, text string" + ("" if distinct else ", term string, field int"))
    places = held.withColumnRenamed("line", "line_no")
    places = places.select("file", "line_no").distinct() if distinct else places
    return read_lines(spark, opened(names) if len(names) <= NAMED_FILES else paths).join(small(places), ["file", "line_no"])


def first_places(
    spark: SparkSession,
    paths: str | Sequence[str],
    terms: DataFrame,
    files: int = FIRST_FILES,
    dialect: str = "ref",
    seen: Callable[[list[str]], None] | None = None,
) -> DataFrame:
    """term, file, line_no, field and text of the first place of each term in a log without an index, files by name.

    Files are scanned in batches of their order, each twice as large as the one before, until no term is open, so a log that
    has all terms in its first files is read no further; one that lacks a term is read once, in a number of steps that
    grows with the logarithm of its files. seen: told the files of each batch.
    """
    listed = shared.save(file_sizes(spark, paths).filter(F.col("bytes") > 0).select("file"), "files")
    open_ = shared.save(terms.select("term").distinct(), "open")
    out = spark.createDataFrame([], "term string, file string, line_no long, field int, text string")
    after = ""
    while not open_.isEmpty():
        batch = [r["file"] for r in listed.filter(F.col("file") > after).orderBy("file").limit(files).collect()]
        if not batch:
            break
        if seen:
            seen(batch)
        place = F.struct("file", "line_no", "field", "text")
        found = scan(read_lines(spark, opened(batch)), open_, dialect).groupBy("term").agg(F.min(place).alias("x"))
        found = shared.save(found.select("term", "x.*"), "first")
        out = out.unionByName(found)
        open_ = shared.save(open_.join(found, "term", "left_anti"), "open")
        after, files = batch[-1], min(2 * files, NAMED_FILES)
    return out


def scan(lines: DataFrame, terms: DataFrame, dialect: str = "ref") -> DataFrame:
    """file, line_no, text, term and field of every place of the terms in lines that have no index: one pass over them."""
    found = occurrences(lines, dialect, keep=["text"]).join(wanted(terms), "address", "left_semi")
    return found.select("file", "line_no", "text", F.col("address").alias("term"), "field")
