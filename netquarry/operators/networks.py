"""Addresses against a table of networks: the most specific network of each, by equality on masked prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.netmath import ipv4_number, ipv6_hex
from .search import small


def _masked(number: Column, digits: Column, bits: Column) -> Column:
    """The first bits of an address, with the version and the number of bits: what its network shares with it.

    number: of an IPv4 address, else null. digits: the 32 hex digits of an IPv6 address.
    """
    v4 = F.call_function("shiftright", number, (F.lit(32) - bits).cast("int"))
    v6 = F.left(digits, F.floor(bits / 4).cast("int"))
    # The digit in which the prefix ends, without its low bits.
    last = F.conv(F.substring(digits, F.floor(bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(bits % 4 == 0, F.lit("")).otherwise(F.hex(F.call_function("shiftright", last, (F.lit(4) - bits % 4).cast("int"))))
    return F.when(number.isNotNull(), F.concat_ws("/", F.lit("4"), bits.cast("string"), v4.cast("string"))).otherwise(
        F.concat_ws("/", F.lit("6"), bits.cast("string"), F.concat(v6, rest))
    )


def prefixes(networks: DataFrame) -> DataFrame:
    """network, version, bits and prefix of the distinct well-formed networks (network: address/bits); others are left out."""
    base, bits = F.substring_index("network", "/", 1), F.element_at(F.split("network", "/"), -1).try_cast("int")
    rows = networks.filter(F.size(F.split("network", "/")) == 2).select("network", ipv4_number(base).alias("_n"), ipv6_hex(base).alias("_d"), bits.alias("bits"))
    rows = rows.withColumn("version", F.when(F.col("_n").isNotNull(), 4).when(F.col("_d").isNotNull(), 6)).distinct()
    rows = rows.filter(F.col("bits").between(0, F.when(F.col("version") == 4, 32).otherwise(128)))
    return rows.select("network", "version", "bits", _masked(F.col("_n"), F.col("_d"), F.col("bits")).alias("prefix"))


def most_specific(index: DataFrame, networks: DataFrame) -> DataFrame:
    """Rows of index (address and others) with network, the longest that holds the address; addresses in none are left out.

    An address is looked up once for each length that networks of its version have, of which there are 33 and 129 at most,
    so the join is one of equal keys at any number of networks. Of equal networks written differently the first by text
    counts. Rows that share an address are looked up together.
    """
    known = prefixes(networks).groupBy("prefix", "version", "bits").agg(F.min("network").alias("network"))
    lengths = known.select("version", "bits").distinct().collect()
    of = {v: F.array(*(F.lit(b) for b in sorted(r["bits"] for r in lengths if r["version"] == v))).cast("array<int>") for v in (4, 6)}
    addresses = index.select("address").distinct().withColumns({"_n": ipv4_number(F.col("address")), "_d": ipv6_hex(F.col("address"))})
    each = F.explode(F.when(F.col("_n").isNotNull(), of[4]).when(F.col("_d").isNotNull(), of[6]))
    asked = addresses.select("address", "_n", "_d", each.alias("_bits"))
    asked = asked.select("address", "_bits", _masked(F.col("_n"), F.col("_d"), F.col("_bits")).alias("prefix"))
    met = asked.join(small(known.select("prefix", "network")), "prefix")
    best = met.groupBy("address").agg(F.max_by("network", "_bits").alias("network"))
    return index.join(best, "address")
