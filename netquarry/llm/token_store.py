"""Token-id output: one concatenated id array a file, document boundaries in Elias-Fano form with select structures.

A file holds a header, the document ids, the Elias-Fano boundaries and the ids (16 or 32 bits little-endian). Of n
boundaries below u the low floor(log2(u/n)) bits are packed and the high parts are unary in a bit vector; the position
of every SAMPLE-th set bit is stored, so the k-th boundary is found from the nearest sample and a scan of a few words.
That is about 2 + log2(u/n) bits a document where an offset table takes 64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from posixpath import basename

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .tokens import encoder, slices

MAGIC, VERSION = b"NQTK", 1
SAMPLE = 64
#: Ids after which a file is closed: 16 MB with two-byte ids.
FILE_IDS = 8 << 20
#: Documents of a file that are handed over at once.
READ_DOCS = 512
#: Write tasks whose ids are summed together.
PARTS_BLOCK = 1024
_HEAD = struct.Struct("<4sHBBqqqq")  # magic, version, bytes an id, low bits, documents, ids, high bits, samples


class EliasFano:
    """A non-decreasing sequence of integers below or at a bound, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, bound: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(bound) // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros((int(bound) >> low_bits) + n + 1, np.uint8)
        upper[at] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), at[::SAMPLE].astype(np.uint64))

    def _low(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.int64)
        for j in range(self.low_bits):
            bit = k * self.low_bits + j
            out |= ((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << j
        return out

    def select(self, k: int) -> int:
        """The k-th value, from the nearest sample before it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = at >> 3
        found = int(self.high[byte]) >> (at & 7)
        base = at
        while (ones := found.bit_count()) <= left:
            left -= ones
            byte += 1
            found, base = int(self.high[byte]), byte << 3
        for _ in range(left):
            found &= found - 1
        place = base + (found & -found).bit_length() - 1
        return ((place - k) << self.low_bits) | int(self._low(np.array([k]))[0])

    def span(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: the samples around them tell which words hold their set bits."""
        if a >= b:
            return np.zeros(0, np.int64)
        skip, after = a % SAMPLE, -(-b // SAMPLE)
        start = int(self.samples[a // SAMPLE]) >> 3
        end = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        at = at[np.searchsorted(at, int(self.samples[a // SAMPLE])) + skip :][: b - a]
        k = np.arange(a, b)
        return ((at - k) << self.low_bits) | self._low(k)


def id_width(tokenizer: str, end_id: int, width: int | None = None) -> int:
    """Bytes of an id for a vocabulary and an end id: the fewest of 2 and 4, or width if it is enough."""
    from tokenizers import Tokenizer

    largest = max(end_id, max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0))
    needed = 2 if largest < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < needed):
        raise ValueError(f"ids up to {largest} need {needed} bytes, not {width}")
    return width or needed


def pack_file(doc_ids: np.ndarray, null_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A file's bytes. ends: for each document the ids up to and with its last."""
    ef = EliasFano.encode(ends, len(ids))
    head = _HEAD.pack(MAGIC, VERSION, width, ef.low_bits, len(doc_ids), len(ids), len(ef.high), len(ef.samples))
    parts = (doc_ids.astype("<i8"), np.packbits(null_ids, bitorder="little"), ef.low, ef.high, ef.samples.astype("<u8"), ids.astype(f"<u{width}"))
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, content: bytes):
        magic, version, width, low_bits, n, total, high, samples = _HEAD.unpack_from(content)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", n)
        self.null_ids = np.unpackbits(take("u1", -(-n // 8)), bitorder="little")[:n].astype(bool)
        low = take("u1", -(-n * low_bits // 8))
        self.bounds = EliasFano(n, low_bits, low, take("u1", high), take("<u8", samples))
        self.ids = take(f"<u{width}", total)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids[self.bounds.select(k - 1) if k else 0 : self.bounds.select(k)]

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where documents a to b - 1 begin and end in ids."""
        ends = self.bounds.span(a, b)
        return np.concatenate([[self.bounds.select(a - 1) if a else 0], ends[:-1]]).astype(np.int64), ends


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs (doc_id, text) in ascending doc_id order into files under path; return one row per file.

    width: bytes of an id, 2 or 4; by default the fewest that the vocabulary needs, and fewer than that are refused.
    A null text has the end id alone; documents of one doc_id follow each other in order of their text's hash; a null
    doc_id comes first. An empty table writes no file. Files are written under a name of the attempt and then renamed, so
    a task that runs again leaves the same files.
    """
    width = id_width(tokenizer, end_id, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs
        from pyspark import TaskContext

        store, root = afs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task, kind = TaskContext.get(), np.dtype(f"<u{width}")
        part, number, held, count = task.partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, count
            sizes = np.concatenate([h[2] for h in held])
            data = pack_file(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.cumsum(sizes), np.concatenate([h[3] for h in held]), width)
            name = f"part-{part:06d}-{number:06d}.nqtk"
            with store.open_output_stream(f"{root}/_{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            store.move(f"{root}/_{name}.{task.taskAttemptId()}", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [name], "n_docs": pa.array([len(sizes)], pa.int64()), "n_ids": pa.array([count], pa.int64())})
            number, held, count = number + 1, [], 0
            return row

        for batch in batches:
            for a, b in slices(batch["text"]):
                ids, offsets = encoder(tokenizer).encode(batch["text"].slice(a, b - a))
                keys = batch["doc_id"].slice(a, b - a)
                ids = np.insert(ids, offsets[1:], end_id).astype(kind)
                held.append((np.asarray(keys.fill_null(0)), np.asarray(keys.is_null()), np.diff(offsets) + 1, ids))
                count += len(ids)
                if count >= file_ids:
                    yield close()
        if held:
            yield close()

    # The hash deals out the rows of a doc_id that very many rows share.
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    ordered = slim.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    return ordered.mapInArrow(scratch.trimmed(run), "part int, number int, file string, n_docs long, n_ids long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files under path: file, doc_id, inside (ids before it in its file), n_tokens, ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                one = TokenFile(content.as_buffer())
                for a in range(0, len(one.doc_ids), READ_DOCS):
                    z = slice(a, min(a + READ_DOCS, len(one.doc_ids)))
                    starts, ends = one.documents(z.start, z.stop)
                    wide = one.ids[starts[0] : ends[-1]].astype("<u4")
                    offsets = (np.append(starts, ends[-1]) - starts[0]) * 4
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(wide)])
                    file = pa.array([basename(name.as_py())] * len(ends))
                    doc_ids = pa.array(one.doc_ids[z], mask=one.null_ids[z])
                    yield pa.RecordBatch.from_arrays(
                        [file, doc_ids, pa.array(starts), pa.array(ends - starts), ids.cast(pa.binary())],
                        names=["file", "doc_id", "inside", "n_tokens", "ids"],
                    )

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.nqtk").load(path).select("path", "content")
    return content.mapInArrow(scratch.trimmed(run), "file string, doc_id long, inside long, n_tokens long, ids binary")


def with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of read() with start, the ids of all documents before each; files: what write() returned, a row a file."""
    earlier = lambda of: of.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, of: F.coalesce(F.sum(n).over(earlier(of)), F.lit(0))
    block = F.floor(F.col("part") / PARTS_BLOCK).alias("block")
    # Sums of files in a part, of parts in a block and of blocks, of which there are one for PARTS_BLOCK write tasks.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", block, "n")
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before("n", Window.orderBy("block")).alias("of_block"))
    parts = parts.select("part", "block", before("n", Window.partitionBy("block").orderBy("part")).alias("of_part"))
    inside = before("n_ids", Window.partitionBy("part").orderBy("number"))
    placed = files.select("part", "file", inside.alias("of_file")).join(parts, "part").join(F.broadcast(blocks), "block")
    placed = placed.select("file", (F.col("of_block") + F.col("of_part") + F.col("of_file")).alias("before"))
    return rows.join(placed, "file").withColumn("start", F.col("before") + F.col("inside")).drop("file", "before", "inside")


def digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to files, read the files back, and return doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = scratch.new_path(spark, "tokens")
    files = scratch.save(write(docs, path, tokenizer, end_id), "token-files", texts=True)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_start(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")
