"""The extraction rules in plain Python: table functions for SQL users, and what tests hold the Column form against.

Its patterns and limits are its own, so that a mistake in those of the Column form shows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

HEX = "0123456789abcdefABCDEF"
RUN = re.compile("[0-9A-Fa-f:-]+")
TAIL = re.compile(r"[0-9]{0,2}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Fa-f:.-])")


def _quad(text: str) -> str | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return None
    return ".".join(str(int(p)) for p in parts)


def _mac(run: str) -> str | None:
    pairs, marks = run[:17:3] + run[1:17:3], set(run[2:17:3])
    good = len(run) >= 17 and all(c in HEX for c in pairs) and marks in ({":"}, {"-"})
    return run[:17].lower().replace("-", ":") if good else None


def _ipv6(s: str, fewest: int = 0) -> bool:
    """Whether s has eight groups, or fewer around one pair of colons; a single colon may follow the last group."""
    short = s.count("::") == 1 or ":::" in s and s.count("::") == s.count(":::")
    if "::::" in s or not short and "::" in s:
        return False
    left, mark, right = s.partition("::")
    third = mark and right.startswith(":")
    if third:
        if not left:
            return False
        right = right[1:]
    right = right.removesuffix(":") if right else right
    groups = (left.split(":") if left else []) + (right.split(":") if right else [])
    if not mark:
        groups = s.removesuffix(":").split(":")
        if len(groups) != 8:
            return False
    if any(not 1 <= len(g) <= 4 for g in groups):
        return False
    return fewest <= len(groups) and len(groups) + bool(third) <= 8


def extract(text: str | None, dialect: str = "ref", max_line_bytes: int | None = -1, max_addresses: int | None = -1) -> list[tuple[str, str]]:
    """Kind and address of each address of a line, in order of fields."""
    ref = dialect == "ref"
    most_bytes = (8191 if ref else None) if max_line_bytes == -1 else max_line_bytes
    most = (256 if ref else None) if max_addresses == -1 else max_addresses
    if text is None or (most_bytes is not None and len(text.encode()) > most_bytes):
        return []
    out: list[tuple[str, str]] = []
    for run in re.findall("[0-9.]+", text):
        quad = _quad(run[:15]) if ref else _quad(run.strip("."))
        if quad:
            out += [("ipv4", quad)] * (1 + run[15:].count(".") * ref)
    at = 0
    while m := RUN.search(text, at):
        run, at = m.group(), m.end()
        if ":" not in run and "-" not in run:
            continue
        # A run whose last group goes on as a quad.
        last = re.search("[0-9A-Fa-f:]*:[0-9]{1,3}$", run)
        tail = TAIL.match(text, at) if last and last.start() == 0 else None
        if tail:
            groups, quad = run[: run.rindex(":") + 1], run[run.rindex(":") + 1 :] + tail.group()
            enough = not ref or len(re.findall("[0-9A-Fa-f]+", groups)) >= 6
            at = tail.end()
            if _quad(quad) and enough and _ipv6(groups + "0:0", 0 if ref else 2):
                out.append(("ipv6", groups + quad))
                continue
        if mac := _mac(run):
            out.append(("mac", mac))
            continue
        s = run.split("-")[0][:39]
        if not ref and re.search("[^:]:$", s):
            s = s[:-1]
        if _ipv6(s, 0 if ref else 2):
            out.append(("ipv6", s))
    return out[:most]


@udtf(returnType="kind string, address string, field int")
class ExtractAddresses:
    def eval(self, text: str) -> Iterator[tuple[str, str, int]]:
        for k, (kind, address) in enumerate(extract(text), 1):
            yield kind, address, k


@arrow_udtf(returnType="file string, line_no bigint, kind string, address string, field int")
class ExtractFromLines:
    """The addresses of a table of lines (file, line_no, text; other columns are left out), a batch of rows at a time.

    A null text has none; file and line_no are handed on as they are, null or not. Lines without a mark that an address
    needs are put aside before any Python code sees them.
    """

    def eval(self, lines: pa.RecordBatch) -> Iterator[pa.Table]:
        kept = pa.Table.from_batches([lines]).filter(pc.match_substring_regex(lines["text"], "[.:-]"))
        found = [extract(text) for text in kept["text"].to_pylist()]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        row = np.repeat(np.arange(len(found)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = {
            "file": kept["file"].cast(pa.string()).take(row),
            "line_no": kept["line_no"].cast(pa.int64()).take(row),
            "kind": pa.array([kind for x in found for kind, _ in x], pa.string()),
            "address": pa.array([address for x in found for _, address in x], pa.string()),
            "field": pa.array(np.arange(len(row)) - first + 1, pa.int32()),
        }
        yield pa.table(columns)


def register(spark: SparkSession, name: str = "extract_addresses", table_name: str = "extract_from_lines") -> None:
    """Make the table functions known to SQL, for where only SQL text will do. The tasks' Python must find this package.

    name takes a text, for lateral joins; table_name takes a table, as in SELECT * FROM extract_from_lines(TABLE(lines)), and
    moves batches instead of single rows. Spark allows no lateral join with the second.
    """
    spark.udtf.register(name, ExtractAddresses)
    spark.udtf.register(table_name, ExtractFromLines)
