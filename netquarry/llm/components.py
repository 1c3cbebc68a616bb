"""Connected components of a link table, by label propagation with pointer jumping over shared scratch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .exact_dedup import small


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for every node of links (a, b: long).

    Each round a node takes the least label of itself and its neighbours, then the label of that label. Rounds grow with
    the logarithm of the longest path; each ends in a written table.
    """
    edges = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        # A hub's links, and the nodes of a large component, meet one row: the labels are broadcast while they are few, and
        # beyond that the skewed side is split (spark.sql.adaptive.skewJoin).
        known = small(labels)
        of = known.select(F.col("node").alias("b"), F.col("label").alias("other"))
        near = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = known.select(F.col("node").alias("new"), F.col("label").alias("far"))
        done = scratch.save(stepped.join(jump, "new", "left").select("node", F.coalesce("far", "new").alias("label"), F.col("label").alias("before")), "labels")
        scratch.drop(labels)
        labels = done
        if done.filter(F.col("label") != F.col("before")).isEmpty():
            scratch.drop(edges)
            return done.select("node", "label")
