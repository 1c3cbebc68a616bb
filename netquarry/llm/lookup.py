"""A join of many rows with a table of distinct keys, in which no task gets all rows of a frequent key; rows that need no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of over 1/HOT_SHARE of all rows is frequent; there are fewer than HOT_SHARE of them, at any size of input.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined with table, a saved one of distinct keys; weight: how many rows have the key.

    Rows of frequent keys meet a broadcast table of fewer than HOT_SHARE rows. Each then gets a key of its own, so the
    shuffle for the others deals it out evenly. Null keys find nothing.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.filter(F.col(weight) > total / HOT_SHARE).select(F.col(key), *(F.col(c).alias(f"_hot_{c}") for c in values), F.lit(True).alias("_hot"))
    rest = table.filter(F.col(weight) <= total / HOT_SHARE).select(F.col(key).cast("string").alias("_lookup"), *(F.col(c).alias(f"_rest_{c}") for c in values))
    met = rows.join(F.broadcast(hot), key, "left")
    own = F.concat(F.lit("\x00"), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).cast("string"))
    met = met.withColumn("_lookup", F.when(F.col("_hot") | F.col(key).isNull(), own).otherwise(F.col(key).cast("string"))).join(rest, "_lookup", "left")
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in values))


def screened(rows: DataFrame, key: str, table: DataFrame, of: str, n: int, how: str = "left_semi") -> DataFrame:
    """rows whose key may be among the n keys in column of of table, a saved one; with how "left_anti", the others, which surely are not.

    A join of the former moves few rows. Sixteen bits or more for each key of table, at places given by hashes, are
    broadcast, 4 KB of them in a row; of keys that are not there, a sixteenth may be.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << min(31, max(16, (16 * n).bit_length()))))
    bits = table.groupBy(F.floor(slot(of) / 32768).alias("_block")).agg(F.bitmap_construct_agg(slot(of) % 32768).alias("_bits"))
    at = slot(key) % 32768
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (F.floor(slot(key) / 32768) == F.col("_block")) & (F.getbit(byte, (at % 8).cast("int")) == 1), how)
