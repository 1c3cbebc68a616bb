"""The inverted index: each address with its count and the places where it stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import addresses, found, kind_of

#: Lines that a bucket of postings spans. An address in every line has this many places in a row, not all of them.
BUCKET_LINES = 1 << 20
#: Lines that a text record spans; an address in more has further records.
RECORD_LINES = 1 << 20


def occurrences(
    lines: DataFrame,
    dialect: str = "ref",
    kinds: Sequence[str] | None = None,
    max_line_bytes: int | None = -1,
    max_addresses: int | None = -1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """file, line_no, field, kind and address of every address in lines (file, line_no, text), with the columns in keep."""
    columns = ["file", "line_no", *keep]
    wanted = set(kinds or ())
    # The outer form, because the optimizer would put a filter on the array, and so all of the extraction, before the other.
    if wanted and wanted != {"ipv4"}:
        # Fields count all addresses; those of other kinds go before they become rows.
        some = addresses("text", dialect, kinds, max_line_bytes, max_addresses)
        rows = lines.select(*columns, F.explode_outer(some).alias("x")).filter(F.col("x").isNotNull())
        return rows.select("file", "line_no", "x.field", "x.kind", "x.address", *keep)
    every = found("text", dialect, kinds, max_line_bytes, max_addresses)
    rows = lines.select(*columns, F.posexplode_outer(every).alias("pos", "address")).filter(F.col("address").isNotNull())
    kind = F.lit("ipv4") if wanted else kind_of(F.col("address"))
    return rows.select("file", "line_no", (F.col("pos") + 1).alias("field"), kind.alias("kind"), "address", *keep)


def postings(occ: DataFrame, per_file: bool = True, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """[file,] address, kind, bucket, n and sorted locations of occurrences, a row for each bucket of lines."""
    keys = ["file"] * per_file + ["address"]
    bucket = F.floor(F.col("line_no") / bucket_lines).cast("long").alias("bucket")
    place = F.struct(F.col("line_no").alias("line"), F.col("field").alias("field"))
    out = occ.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(place)).alias("locations"))
    return out.select(*keys, kind_of(F.col("address")).alias("kind"), "bucket", "n", "locations")


def split_postings(rows: DataFrame, dialect: str = "ref", bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """file, block, bucket, address, n, lines, first and locations of lines of lines.read_splits, in one pass over them.

    Locations hold a line's mid, not its number. A row without an address stands for the lines without any, so the rows of
    a split together count its lines (lines) and tell where it begins (first): splits_of makes the numbers' table of them,
    and with_numbers puts the numbers in. A split's rows come from one task, so its sums are complete before the shuffle.
    """
    every = rows.select("file", "block", "mid", F.posexplode_outer(found("text", dialect)).alias("pos", "address"))
    bucket = F.floor(F.col("mid") / bucket_lines).cast("long").alias("bucket")
    place = F.when(F.col("address").isNotNull(), F.struct(F.col("mid").alias("line"), (F.col("pos") + 1).alias("field")))
    # Each line counts by its first address, or by the row that it has without one.
    return every.groupBy("file", "block", bucket, "address").agg(
        F.count("address").alias("n"),
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("lines"),
        F.min("mid").alias("first"),
        F.sort_array(F.collect_list(place)).alias("locations"),
    )


def splits_of(stored: DataFrame) -> DataFrame:
    """file, block, first, lines and base, the lines before the split, of what split_postings gave; no log is read."""
    return with_bases(stored.groupBy("file", "block").agg(F.sum("lines").alias("lines"), F.min("first").alias("first")))


def with_bases(splits: DataFrame) -> DataFrame:
    """Splits (file, block, first, lines) of one run or of several over parts of files, with base by all of them."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("base", F.coalesce(F.sum("lines").over(before), F.lit(0)))


def with_numbers(stored: DataFrame, splits: DataFrame) -> DataFrame:
    """file, address, kind, bucket, n and locations by line number, from split_postings and splits_of."""
    held = stored.filter("address is not null").join(splits.select("file", "block", F.col("first").alias("_first"), "base"), ["file", "block"])
    moved = lambda x: F.struct((x["line"] - F.col("_first") + F.col("base") + 1).alias("line"), x["field"].alias("field"))
    return held.select("file", "address", kind_of(F.col("address")).alias("kind"), "bucket", "n", F.transform("locations", moved).alias("locations"))


def build_index(occ: DataFrame, per_file: bool = True, record_lines: int = RECORD_LINES) -> DataFrame:
    """[file,] address, kind, part, n, total and locations of occurrences: the records of the text form.

    An address has a record for each record_lines lines that it occurs in, so that no row grows with the log; n counts
    the record's places and total all of the address. In combined mode line numbers of several files meet, as in the text
    form; postings keep the file.
    """
    keys = ["file"] * per_file + ["address"]
    parts = postings(occ, per_file, record_lines).withColumnRenamed("bucket", "part")
    return parts.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def counts(occ: DataFrame, *keys: str) -> DataFrame:
    """n of each address, without its places: partial sums before the shuffle, one number for each address after it."""
    keys = keys or ("address", "kind")
    if "address" not in keys or "kind" not in keys:
        return occ.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # An address tells its kind, so rows are grouped without it.
    out = occ.groupBy(*(k for k in keys if k != "kind")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*(kind_of(F.col("address")).alias("kind") if k == "kind" else k for k in keys), "n")


def by_count(index: DataFrame) -> DataFrame:
    """The order of the text form: largest count first, then the bytes of the address, then the lines."""
    if "total" in index.columns:
        return index.orderBy(F.desc("total"), "address", "part")
    return index.orderBy(F.desc("n"), "address")


def top(index: DataFrame, k: int) -> DataFrame:
    """The k addresses of the largest counts."""
    return by_count(index).limit(k)


def kind_filter(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)
