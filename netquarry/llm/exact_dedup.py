"""Exact dedup against immutable snapshots.

A snapshot holds groups of equal texts (digest, keep_id, n), the documents that they are of and, for each bucket of
digests, a static binary-fuse filter. An incoming batch is first grouped by itself; the filters then screen its digests.
A digest that they refuse is new. The others meet the snapshot's exact buckets on the digest, and one text of each side is
read again so that bytes decide. What comes back joins the batch's group with the snapshot's; all other groups stay as they
are. Texts are read from the tables themselves and only those that pass the filters are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse, scratch
from .lookup import lookup

#: Digests that a filter holds, on average.
FILTER_KEYS = 1 << 14
#: Rows up to which digests are broadcast (about 100 bytes a row in memory); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A group of over 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them, at any size of input.
HOT_SHARE = 1000


def small(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if it has at most BROADCAST_ROWS rows. df is a saved table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _key(digest: Column) -> Column:
    """A digest's last 60 bits; its first 32 choose the bucket."""
    return F.conv(F.substring(digest, 50, 15), 16, 10).cast("long")


def _bucket(digest: Column, buckets: int) -> Column:
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def grouped(docs: DataFrame) -> DataFrame:
    """Groups of equal texts of docs (doc_id, text, _new): _new, digest, keep_id (the largest doc_id) and n rows.

    Two texts of one digest, should they ever be found, end the run with an error.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("_new", "doc_id", F.sha2(text, 256).alias("digest"), F.xxhash64(text).alias("_h"))
    out = rows.groupBy("_new", "digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("_first"), F.max("_h").alias("_last")
    )
    clash = F.raise_error(F.lit("two texts share a digest")).cast("long")
    n = F.when(F.col("_first") == F.col("_last"), F.col("n")).otherwise(clash)
    return out.select("_new", "digest", "keep_id", n.alias("n"))


def texts_of(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """digest and text, one row each, of digests (a saved table of digest and keep_id). docs: doc_id, text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("text"), F.sha2(text, 256).alias("_digest"))
    # The row that stays holds the text for all of its group; rows that share its doc_id too are one here.
    met = rows.join(small(digests), (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("keep_id")))
    return met.select("digest", "text").dropDuplicates(["digest"])


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of documents, its groups and its filters."""

    docs: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def build(cls, docs: DataFrame, groups: DataFrame) -> Snapshot:
        """docs: doc_id, text; groups: a saved table of digest, keep_id, n."""
        buckets = max(1, -(-groups.count() // FILTER_KEYS))

        def make(table: pa.Table) -> pa.Table:
            content = fuse.build(np.asarray(table["key"]))
            return pa.table({"bucket": table["bucket"].slice(0, 1), "filter": pa.array([content], pa.binary())})

        keys = groups.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
        filters = scratch.save(keys.groupBy("bucket").applyInArrow(make, "bucket int, filter binary"), "fuse")
        return cls(docs, groups, filters, buckets)

    def screen(self, batch: DataFrame) -> DataFrame:
        """digest and keep_id of batch (a saved table of distinct digests) that the filters don't refuse.

        Each bucket's digests are dealt to parts with a copy of its filter each, so that a part has a bounded number
        of digests however large the batch is.
        """
        parts = max(1, -(-batch.count() // (self.buckets * 4 * FILTER_KEYS)))

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            passed = np.zeros(len(left), bool)
            if len(right):
                passed = fuse.contains(right["filter"][0].as_py(), np.asarray(left["key"]))
            return left.select(["digest", "keep_id"]).filter(pa.array(passed))

        part = F.pmod(F.xxhash64("digest"), F.lit(parts))
        bucket = _bucket(F.col("digest"), self.buckets)
        rows = batch.select("digest", "keep_id", _key(F.col("digest")).alias("key"), bucket.alias("bucket"), part.alias("part"))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        filters = self.filters.withColumn("part", copies)
        both = rows.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part"))
        return both.applyInArrow(check, "digest string, keep_id long")

    def join(self, docs: DataFrame, batch: DataFrame) -> DataFrame:
        """Those of batch's groups whose text the snapshot has: digest and the snapshot's keep_id and n. docs: the batch's documents."""
        maybe = scratch.save(self.screen(batch), "maybe")
        theirs = scratch.save(self.groups.join(small(maybe.select("digest")), "digest", "left_semi"), "theirs")
        # What the filters let through by chance has no bucket entry, and its text isn't read.
        mine = scratch.save(maybe.join(small(theirs.select("digest")), "digest", "left_semi"), "mine")
        equal = texts_of(docs, mine).join(texts_of(self.docs, theirs), ["digest", "text"]).select("digest")
        out = scratch.save(theirs.join(equal, "digest").select("digest", "keep_id", "n"), "found")
        scratch.drop(maybe, theirs, mine)
        return out


def labels(docs: DataFrame, is_new: Column, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns carry of docs with keep_id, group_size, kept and text_sha256, in two batches: a snapshot and what comes after it.

    is_new tells the batch of each row; null counts as the snapshot's. A null text counts as empty. Of equal texts the
    row with the largest doc_id stays; of rows that share it too all do, and a null doc_id stays only if its group has no
    other (keep_id is then null). An empty table gives no row. Columns of carry keep their values whatever their names.
    """
    batch = F.coalesce(is_new, F.lit(False))
    batched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", batch.alias("_new"))
    groups = scratch.save(grouped(batched), "groups")
    old, new = (groups.filter(F.col("_new") == x).drop("_new") for x in (False, True))
    old_docs, new_docs = (batched.filter(F.col("_new") == x).select("doc_id", "text") for x in (False, True))
    snapshot = Snapshot.build(old_docs, old)
    found = snapshot.join(new_docs, new)
    theirs = small(found.withColumnsRenamed({"keep_id": "their_id", "n": "their_n"}))
    # What the batch learns: its own groups, and of those that the join found the snapshot's part too.
    keep, size = F.greatest("keep_id", "their_id"), F.col("n") + F.coalesce("their_n", F.lit(0))
    learnt = new.join(theirs, "digest", "left").withColumns({"keep": keep, "size": size, "met": F.col("their_n").isNotNull()})
    learnt = scratch.save(learnt.select("digest", "n", "keep", "size", "met"), "learnt")
    # Only groups that were met change in the snapshot.
    update = learnt.filter("met").select("digest", F.col("keep").alias("new_keep"), F.col("size").alias("new_size"))
    update = scratch.save(update, "update")
    met = small(update)
    stays = old.filter("n > 1").join(met, "digest", "left_anti").select("digest", "n", F.col("keep_id").alias("keep"), F.col("n").alias("size"))
    changed = old.join(met, "digest").select("digest", "n", F.col("new_keep").alias("keep"), F.col("new_size").alias("size"))
    side = lambda df, name: df.select(F.concat(F.lit(name), "digest").alias("_side"), F.col("n").alias("_rows"), "keep", "size")
    table = side(learnt.filter("size > 1"), "new").unionByName(side(stays, "old")).unionByName(side(changed, "old"))
    table = scratch.save(table, "dup-groups")
    scratch.drop(groups, snapshot.filters, found, learnt, update)
    row = F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys(("doc_id", *carry)))).alias("_row")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(row, digest.alias("text_sha256"), F.concat(F.when(batch, "new").otherwise("old"), digest).alias("_side"))
    out = lookup(rows, table, "_side", "_rows")
    alone = F.col("size").isNull()
    return out.select(
        *(F.col(f"_row.`{c}`") for c in carry),
        F.when(alone, F.col("_row.doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("_row.doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        "text_sha256",
    )


def dedupe(docs: DataFrame, is_new: Column) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    held = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("_row", "doc_id", "text")
    return labels(held, is_new, ("_row",)).filter("kept").select("_row.*")
