"""Packing documents into token sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most a sequence's length. The histogram of piece lengths has at most that many
bins, however many pieces there are. Lengths are placed longest first, each bin into the shortest packs that it fits,
so that whole groups of equal packs (a pattern and its count) are updated at once. The patterns are then joined back
to the pieces by length and rank among the pieces of that length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .token_store import id_width
from .tokens import encoder, slices

#: Parts that the pieces of one length are ranked in at least, and pieces that a part has, so that none ranks a length alone.
RANK_PARTS, RANK_PIECES = 256, 50_000


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, keep_ids: int = 0) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids of keep_ids bytes each.

    A null text counts as empty and has the end id alone. Only a document's last piece is shorter than capacity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                ids, offsets = encoder(tokenizer).encode(batch["text"].slice(a, b - a))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at = offsets[doc] + start
                view = memoryview(ids).cast("B")
                out = {
                    "doc_id": batch["doc_id"].slice(a, b - a).take(pa.array(doc)),
                    "start": pa.array(start.astype(np.int64)),
                    "length": pa.array(length.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
                    "doc_tokens": pa.array(sizes[doc].astype(np.int64)),
                }
                if keep_ids:
                    short = memoryview(ids.astype(f"<u{keep_ids}")).cast("B")
                    out["ids"] = pa.array([bytes(short[keep_ids * x : keep_ids * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * bool(keep_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scratch.trimmed(run), schema)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Packing patterns and how many sequences follow each. histogram: pieces by length."""
    open_packs: list[tuple[int, int]] = []  # heap of used length and number of the group
    groups: list[list] = []  # pattern and count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and open_packs[0][0] + length <= capacity:
            used, g = heapq.heappop(open_packs)
            pattern, count = groups[g]
            n = min(left, count)
            left -= n
            if n < count:
                groups[g][1] -= n
                heapq.heappush(open_packs, (used, g))
                g = len(groups)
                groups.append([pattern, n])
            groups[g][0] = [*pattern, length]
            heapq.heappush(open_packs, (used + length, g))
        # What fits nowhere opens packs of its own, each with as many as it holds.
        each = capacity // length
        for many, count in ((each, left // each), (left % each, 1)):
            if many and count:
                groups.append([[length] * many, count])
                heapq.heappush(open_packs, (length * many, len(groups) - 1))
    return [(p, n) for p, n in groups]


def slots(found: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows of length, first rank, count, first sequence and offset, in order of length and rank."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            rows.append((length, rank, count, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """pieces with rank, gapless from 0 among those of one length. most: pieces of the most frequent length.

    The pieces of a length are dealt to parts of about RANK_PIECES by hash; a part's first rank is the sum of the counts
    of the parts before it, so a length that a third of all pieces share is ranked by many tasks.
    """
    parts = max(RANK_PARTS, -(-most // RANK_PIECES))
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "_part").count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")
    return pieces.withColumn("_rank", F.row_number().over(inside) - 1).join(firsts, ["length", "_part"]).withColumn("rank", F.col("_first") + F.col("_rank")).drop("_part", "_first", "_rank")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, keep_ids: int = 0) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, the place of each in its sequence.

    keep_ids: bytes of an id to keep, 2 or 4, and 0 for none; fewer than the vocabulary needs are refused. An empty table
    gives no row. Rows that share a doc_id are separate documents; pieces that are equal in doc_id, start and ids are
    ranked in any order. Columns of docs other than doc_id and text are left out. The histogram and the slots, which
    are sent to every task, have a size set by capacity, not by the number of pieces.
    """
    if keep_ids:
        id_width(tokenizer, end_id, keep_ids)
    pieces = scratch.save(cut(docs, tokenizer, end_id, capacity, keep_ids), "pieces", texts=True)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(patterns(histogram, capacity))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        keys = (t[:, 0] << 44) | t[:, 1]
        for batch in batches:
            rank = np.asarray(batch["rank"])
            row = t[np.searchsorted(keys, (np.asarray(batch["length"]) << 44) | rank, "right") - 1]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch[n] for n in kept] + [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(np.ascontiguousarray(row[:, 4]))], names=[*kept, "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * bool(keep_ids)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * bool(keep_ids) + ", sequence_id long, offset long"
    return ranked(pieces, max(histogram.values(), default=0)).select(*columns, "rank").mapInArrow(scratch.trimmed(place), schema)
