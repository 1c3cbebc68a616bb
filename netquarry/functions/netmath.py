"""Numbers behind addresses: IPv4 as a long, IPv6 as 32 hex digits, networks, ranges and the makers' part of a MAC."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import is_quad, octets


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a long; null for anything else."""
    number = F.aggregate(octets(address), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(is_quad(address), number)


def ipv4_text(number: Column) -> Column:
    """A long as an IPv4 address."""
    part = lambda k: F.shiftright(number, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def ipv6_hex(address: Column) -> Column:
    """An IPv6 address as 32 lower-case hex digits, whose order is that of the numbers; null for anything else.

    A quad at the end gives the last two groups, and a colon left at the end is none of the address.
    """
    quad = F.substring_index(address, ":", -1)
    pair = lambda high: F.lower(F.hex(high))
    number = ipv4_number(quad)
    words = F.concat_ws(":", pair(F.shiftright(number, 16)), pair(number.bitwiseAND(F.lit(65535))))
    whole = F.when(F.contains(address, F.lit(".")), F.concat(F.regexp_replace(address, "[0-9.]+$", ""), words)).otherwise(address)
    whole = F.lower(F.regexp_replace(whole, "([^:]):$", "$1"))
    groups = lambda s: F.transform(F.filter(F.split(s, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    short = F.contains(whole, F.lit("::"))
    left = groups(F.substring_index(whole, "::", 1))
    right = F.when(short, groups(F.regexp_replace(whole, "^.*?::", ""))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    digits = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), F.array_join(right, ""))
    return F.when((short | (missing == 0)) & F.contains(address, F.lit(":")) & F.rlike(digits, F.lit("^[0-9a-f]{32}$")), digits)


def in_network(address: Column, network: str) -> Column:
    """Whether an address is in a network such as 10.1.0.0/16 or 2001:db8::/32. The bounds are constants, so the test is two comparisons."""
    net = ipaddress.ip_network(network, strict=False)
    return in_range(address, str(net.network_address), str(net.broadcast_address))


def in_range(address: Column, first: str, last: str) -> Column:
    """Whether an address lies between two of one version, both included."""
    low, high = ipaddress.ip_address(first), ipaddress.ip_address(last)
    if low.version != high.version:
        raise ValueError("the bounds are of two versions")
    if low.version == 4:
        return F.coalesce(ipv4_number(address).between(int(low), int(high)), F.lit(False))
    return F.coalesce(ipv6_hex(address).between(f"{int(low):032x}", f"{int(high):032x}"), F.lit(False))


def maker(mac: Column) -> Column:
    """The first three bytes of a MAC address."""
    return F.left(mac, F.lit(8))
