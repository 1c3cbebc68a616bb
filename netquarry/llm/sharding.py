"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VNODES points on a ring of SLOTS slots; a key's hash gives its slot, and the order in which the shards'
points follow clockwise from there is the slot's order of preference. In each round the keys still without a shard are
offered to the slot's next shard, which takes them, slot after slot, until it is full; the overflow continues
clockwise. The shards' capacities add up to the number of rows (or more, with spare), so every key finds a place.

All of this is done on counts of slots and of the parts that their keys are ranked in. A key then reads its shard and its
place there from its rank in its part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .exact_dedup import small

SLOTS = 4096
#: Parts that a slot's keys are ranked in at least, and keys of a part beyond that, so that a hot slot has more of them.
PARTS, PART_KEYS = 16, 1 << 19
VNODES = 128


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """slot and prefs, the shards in the order in which their first points follow clockwise."""
    point = F.pmod(F.xxhash64(F.lit("vnode"), F.col("_shard"), F.col("_v")), F.lit(SLOTS))
    points = (
        spark.range(shards)
        .select(F.col("id").cast("int").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("_v"))
        .select("_shard", point.alias("_at"), F.xxhash64("_shard", "_v").alias("_tie"))
    )
    # Each point is laid twice, so that the walk from the last slots goes on at the start of the ring.
    laid = points.withColumn("_at", F.explode(F.array(F.col("_at"), F.col("_at") + SLOTS)))
    every = spark.range(shards).select(F.col("id").cast("int").alias("_shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * SLOTS - 1).cast("long"))).alias("_at"))
    onward = Window.partitionBy("_shard").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    nearest = (
        every.join(laid.groupBy("_shard", "_at").agg(F.min("_tie").alias("_tie")), ["_shard", "_at"], "left")
        .withColumn("_point", F.min(F.when(F.col("_tie").isNotNull(), F.struct("_at", "_tie"))).over(onward))
        .filter(F.col("_at") < SLOTS)
    )
    return nearest.groupBy(F.col("_at").alias("slot")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_point", "_shard"))), lambda x: x["_shard"]).alias("prefs"))


def allotment(counts: DataFrame, shards: int, spare: float = 0.0) -> DataFrame:
    """Runs of ranks in each slot: slot, from_rank, n, shard, first_place.

    counts: slot, n. With spare 0 the first (rows mod shards) shards hold one row more than the others; otherwise every
    shard holds up to (1 + spare) times the mean, and adding or removing a shard moves fewer rows.
    """
    spark = counts.sparkSession
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cap = F.lit(math.ceil(rows * (1 + spare) / shards)) if spare else F.lit(rows // shards) + (F.col("id") < rows % shards).cast("long")
    caps = spark.range(shards).select(F.col("id").cast("int").alias("shard"), cap.cast("long").alias("cap"))
    state = scratch.save(counts.join(ring(spark, shards), "slot").select("slot", "prefs", F.col("n").alias("left"), F.lit(0).cast("long").alias("taken")), "ring")
    runs = []
    by_slot = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    for turn in range(shards):
        offered = state.withColumn("shard", F.get("prefs", F.lit(turn))).join(F.broadcast(caps), "shard")  # a row a shard
        room = F.greatest(F.lit(0), F.col("cap") - F.coalesce(F.sum("left").over(by_slot), F.lit(0)))
        step = scratch.save(offered.withColumn("room", room).withColumn("n", F.least("left", "room")), "ring")
        runs.append(step.filter("n > 0").select("slot", F.col("taken").alias("from_rank"), "n", "shard", F.lit(turn).alias("turn")))
        full = step.groupBy("shard").agg(F.sum("n").alias("_n"))
        caps = scratch.save(caps.join(F.broadcast(full), "shard", "left").select("shard", (F.col("cap") - F.coalesce("_n", F.lit(0))).alias("cap")), "ring")  # a row a shard
        state = step.select("slot", "prefs", (F.col("left") - F.col("n")).alias("left"), (F.col("taken") + F.col("n")).alias("taken")).filter("left > 0")
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    places = Window.partitionBy("shard").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("first_place", F.coalesce(F.sum("n").over(places), F.lit(0))).drop("turn")


def assign(df: DataFrame, key: Column, shards: int, tie: Column | None = None, spare: float = 0.0) -> DataFrame:
    """df with shard and slot (gapless from 0 in each shard); counts of rows differ by one at most when spare is 0.

    key decides the place on the ring; null is a key like another. tie orders and deals out the rows of one key, so a
    key of a third of all rows is ranked in parts of about PART_KEYS and overflows to the next shards. Rows equal in key
    and tie are in any order. Columns of df named shard or slot are replaced; an empty df gives no row. df is read three
    times, the first time for key alone, and is best given without the columns that are not needed.
    """
    tie = F.lit(0) if tie is None else tie
    names = [c for c in df.columns if c not in ("shard", "slot")]
    at = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    slots = scratch.save(df.groupBy(at.alias("slot")).agg(F.count(F.lit(1)).alias("n")), "ring-slots")
    runs = scratch.save(allotment(slots, shards, spare), "ring-runs")
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    parts = slots.select(F.col("slot").alias("_slot"), F.greatest(F.lit(PARTS), F.ceil(F.col("n") / PART_KEYS)).alias("_parts"))
    held = df.select(row, at.alias("_slot"), F.xxhash64(key, tie).alias("_order")).join(F.broadcast(parts), "_slot")  # SLOTS rows
    held = held.withColumn("_part", F.pmod("_order", "_parts")).drop("_parts")
    counts = held.groupBy(F.col("_slot").alias("slot"), F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most SLOTS x shards runs in SLOTS arrays; SLOTS x PARTS rows, and one more for PART_KEYS rows of df.
    table = (
        counts.withColumn("first", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
        .join(runs.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("from_rank", "n", "shard", "first_place"))).alias("runs")), "slot")
        .select(F.col("slot").alias("_slot"), F.col("part").alias("_part"), "first", "runs")
    )
    table = scratch.save(table, "ring-parts")
    rank = F.col("first") + F.row_number().over(Window.partitionBy("_slot", "_part").orderBy("_order")) - 1
    out = held.join(small(table), ["_slot", "_part"]).withColumn("_rank", rank)
    out = out.withColumn("_run", F.get(F.filter("runs", lambda r: (r["from_rank"] <= F.col("_rank")) & (F.col("_rank") < r["from_rank"] + r["n"])), F.lit(0)))
    return out.select("_row.*", F.col("_run.shard").alias("shard"), (F.col("_run.first_place") + F.col("_rank") - F.col("_run.from_rank")).alias("slot"))
