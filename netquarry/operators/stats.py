"""Figures about lines and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import CODES, found, kind_of
from .index import counts


def count_of(addresses: Column, kind: str) -> Column:
    """How many of a line's addresses are of a kind."""
    return F.size(F.filter(addresses, lambda x: kind_of(x) == kind))


def kinds_per_line(lines: DataFrame, dialect: str = "ref") -> DataFrame:
    """lines with n_addresses and the number of addresses of each kind."""
    every = lines.withColumn("_found", found("text", dialect))
    numbers = {f"n_{k}": count_of(F.col("_found"), k) for k in CODES}
    return every.withColumns({"n_addresses": F.size("_found"), **numbers}).drop("_found")


def count_by_kind(occ: DataFrame) -> DataFrame:
    """kind, occurrences and distinct addresses. The addresses are made distinct before they are counted by kind."""
    return counts(occ).groupBy("kind").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("addresses"))


def distinct_addresses(occ: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: the number of distinct addresses, exact or by a sketch of fixed size."""
    if approximate:
        return occ.agg(F.approx_count_distinct("address").alias("addresses"))
    return occ.select("address").distinct().agg(F.count(F.lit(1)).alias("addresses"))


def sketches(occ: DataFrame, *keys: str, precision: int = 12) -> DataFrame:
    """keys and sketch: what tells about how many different addresses each has, in a few KB whatever their number.

    Stored by file or hour, sketches are united later (united) without the log or the addresses.
    """
    return occ.groupBy(*keys).agg(F.hll_sketch_agg("address", precision).alias("sketch"))


def united(stored: DataFrame, *keys: str) -> DataFrame:
    """keys and addresses, the estimate of the different addresses in all sketches that share them."""
    return stored.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("addresses"))


def line_lengths(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines and the least, greatest and mean number of bytes in one."""
    size = F.octet_length("text")
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.sum(size.cast("long")).alias("bytes"),
        F.avg(size).alias("avg_bytes"),
    )
