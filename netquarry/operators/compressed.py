"""Postings in little space: places as gaps of variable length, in blocks that a lookup can pass over.

A block is a row with its first and last line beside its bytes, so a store that is sorted by address and line answers "this
address between these lines" from the row groups and blocks that reach into the range; others are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import lookup

#: Places of a block.
BLOCK_PLACES = 128


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, low ones first, the high bit set where more follow; and each one's length."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        size += numbers >= np.uint64(1) << np.uint64(7 * k)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        low = (numbers[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[begin[has] + k] = low | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out, size


def numbers_of(data: np.ndarray) -> np.ndarray:
    """The numbers that varints wrote."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin).astype(np.int64)


def compress(postings: DataFrame, places: int = BLOCK_PLACES) -> DataFrame:
    """The columns of postings but n and locations, with first, last, n and gaps: a row for each block of places.

    gaps holds the distance of each line to the one before (0 for the block's first) and the field, in turn. Locations are
    sorted, as postings gives them; a row without any has no block. Nothing is moved.
    """
    keys = [c for c in postings.columns if c not in ("n", "locations")]
    begins = F.sequence(F.lit(1), F.greatest(F.size("locations"), F.lit(1)), F.lit(places))
    cut = F.explode(F.transform(begins, lambda k: F.slice("locations", k, places)))
    rows = postings.select(*keys, cut.alias("_x")).filter(F.size("_x") > 0)
    ends = F.element_at("_x", 1)["line"].alias("first"), F.element_at("_x", -1)["line"].alias("last"), F.size("_x").alias("n")
    rows = rows.select(*keys, *ends, F.col("_x.line").alias("_lines"), F.col("_x.field").alias("_fields"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, n = batch["_lines"].flatten().to_numpy(), batch["n"].to_numpy().astype(np.int64)
            begin = np.cumsum(n) - n
            gaps = np.diff(lines, prepend=0)
            gaps[begin] = 0
            data, size = varints(np.stack([gaps, batch["_fields"].flatten().to_numpy()], 1).ravel())
            ends_ = np.concatenate([[0], np.cumsum(size)])[np.concatenate([2 * begin, [2 * len(lines)]])]
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends_.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in out.names[:-1]), packed], names=out.names)

    out = rows.drop("_lines", "_fields").withColumn("gaps", F.lit(b"")).schema
    return rows.mapInArrow(encode, out)


def decompress(blocks: DataFrame) -> DataFrame:
    """Blocks with locations in place of first, last and gaps. Nothing is moved."""
    keys = [c for c in blocks.columns if c not in ("first", "last", "n", "gaps")]
    rows = blocks.select(*keys, "n", "first", "gaps")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(x.as_py() for x in batch["gaps"]), np.uint8)
            gaps, fields = numbers_of(data).reshape(-1, 2).T
            begin = np.cumsum(n) - n
            run = np.cumsum(gaps)
            lines = run + np.repeat(batch["first"].to_numpy() - (run[begin] if len(run) else 0), n)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            found = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((lines, pa.int64()), (fields, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in [*keys, "n"]), *found], names=[*keys, "n", "_lines", "_fields"])

    out = blocks.select(*keys, "n").withColumns({"_lines": F.lit(None).cast("array<long>"), "_fields": F.lit(None).cast("array<int>")}).schema
    both = F.transform(F.arrays_zip("_lines", "_fields"), lambda x: F.struct(x["_lines"].alias("line"), x["_fields"].alias("field")))
    return rows.mapInArrow(decode, out).select(*keys, "n", both.alias("locations"))


def between(blocks: DataFrame, terms: DataFrame, low: int, high: int) -> DataFrame:
    """file, term, line and field of the places of the terms in lines low to high. Only blocks that reach into these lines
    are decoded; both conditions reach the scan of a stored table."""
    near = lookup(blocks.filter((F.col("first") <= high) & (F.col("last") >= low)), terms)
    rows = decompress(near).select("file", F.col("address").alias("term"), F.explode("locations").alias("x"))
    return rows.select("file", "term", "x.line", "x.field").filter(F.col("line").between(low, high))
