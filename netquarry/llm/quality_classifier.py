"""Quality classifier by hierarchical empirical Bayes.

A logistic regression gives each document's own evidence. The documents' probabilities (labels where there are any) are
summed by path and by host; a host's rate is shrunk towards the corpus rate and a path's towards its host's, each with
a strength estimated from how much sites really differ (method of moments), so that a site of few documents stays near
its prior. A document's own share is taken out of its site's rate before the two are combined on the log-odds scale.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .lookup import lookup
from .quality_rules import SPACE, lines_twice, occurrences, words_of

#: Labelled rows that the regression is fitted on, at most: those whose hash is below a bound that the count of all sets.
FIT_ROWS = 20_000
THRESHOLD = 0.5
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def evidence(docs: DataFrame) -> DataFrame:
    """docs with x, an array of features. A null text has the features of an empty one."""
    held = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", words_of(F.coalesce("text", F.lit(""))))
    t, w = F.col("_text"), F.col("_words")
    n = F.greatest(F.size(w), F.lit(1))
    letters = lambda x: F.lower(x) != F.upper(x)
    share = lambda of: F.size(F.filter(w, of)) / n
    marks = [F.least(occurrences(t, c) / n, F.lit(3.0)) for c in ("#*$%&<>", "|", "!", ".", ",", "0123456789")]
    xs = [
        F.lit(1.0),
        F.log1p(F.size(w)),
        F.least((F.char_length(t) - occurrences(t, SPACE)) / n, F.lit(30.0)),
        *marks,
        share(lambda x: (F.char_length(x) <= 3) & letters(x)),
        share(lambda x: (F.char_length(x) >= 3) & letters(x) & (F.upper(x) == x)),
        F.size(F.array_distinct(w)) / n,
        F.least(lines_twice(t) / n, F.lit(1.0)),
        (F.size(w) < 20).cast("double"),
    ]
    return held.withColumn("x", F.array(*(x.cast("double") for x in xs))).drop("_text", "_words")


def fit(rows: list, steps: int = 25, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Weights, means and scales of a ridge logistic regression by Newton's method. rows: (x, label)."""
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    return w.tolist(), mean.tolist(), scale.tolist()


def scored(x: Column, model: tuple[list[float], list[float], list[float]]) -> Column:
    """Probability by the regression."""
    z = sum((F.lit(w) * (F.get(x, F.lit(k)) - m) / s for k, (w, m, s) in enumerate(zip(*model, strict=True))), F.lit(0.0))
    return F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(z, F.lit(15.0)), F.lit(-15.0))))


def strength(n: float, squares: float, sites: int, spread: float, rate: float) -> float:
    """Documents that a prior of the given rate is worth, from the spread of sites around it.

    n and squares: sum of sites' sizes and of their squares; spread: sum of size x (site's rate - rate) squared.
    """
    inside = rate * (1 - rate)
    room = n - squares / n if n else 0.0
    between = (spread - max(sites - 1, 0) * inside) / room if room > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, inside / between - 1)) if between > 1e-12 else STRONGEST


def fit_sample(rows: DataFrame) -> list:
    """x and label of at most FIT_ROWS labelled rows (a saved table of doc_id, x, label): all, or those of the least hashes.

    Rows are counted first and chosen by a bound on their hash, so no task hands over more than belong to the sample.
    """
    labelled = rows.filter("label is not null").select("x", "label", F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 32)).alias("_h"))
    bound, n = float(1 << 32), labelled.count()
    while n > FIT_ROWS:
        # Five standard deviations below the bound that gives FIT_ROWS on average.
        bound *= (FIT_ROWS - 5 * math.sqrt(FIT_ROWS)) / n if FIT_ROWS > 25 else 0.5
        n = labelled.filter(F.col("_h") < bound).count()
    return labelled.filter(F.col("_h") < bound).select("x", "label").collect()


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, p_doc, p_host, p_path, posterior and kept of every row of docs (doc_id, text and what host and path need).

    labels: doc_id and label (0 or 1, null for unknown); of repeated ones the greatest counts. A null host or path is a
    site of its own, the empty one. With labels of one class only, or none, every p_doc is the rate of the labels (1 if
    there are none). An empty table gives no row.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    slim = evidence(docs.withColumn("_host", F.coalesce(host.cast("string"), F.lit(""))).withColumn("_path", F.coalesce(path.cast("string"), F.lit(""))).select("doc_id", "text", "_host", "_path"))
    rows = scratch.save(slim.drop("text").join(known, "doc_id", "left"), "evidence")
    sample = fit_sample(rows)
    rates = {r["label"] for r in sample}
    if len(rates) == 2:
        p_doc = scored(F.col("x"), fit([(r["x"], r["label"]) for r in sample]))
    else:
        p_doc = F.lit(float(min(max(next(iter(rates), 1), 0.001), 0.999)))
    key = F.concat_ws("\x1f", "_host", "_path")
    held = rows.withColumn("p_doc", p_doc).withColumn("share", F.coalesce(F.col("label").cast("double"), "p_doc")).withColumn("key", key).select("doc_id", "_host", "_path", "key", "p_doc", "share")
    held = scratch.save(held, "shares")
    paths = scratch.save(held.groupBy("_host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("good")), "paths")
    hosts = scratch.save(paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), F.count(F.lit(1)).alias("sites"), F.sum(F.col("host_n").cast("double") ** 2).alias("squares")).first()
    n = whole["n"] or 0
    rate = min(0.999, max(0.001, whole["good"] / n)) if n else 0.5
    spread = hosts.agg(F.sum(F.col("host_n") * (F.col("host_good") / F.col("host_n") - rate) ** 2)).first()[0] or 0.0
    host_prior = strength(n, whole["squares"] or 0.0, whole["sites"], spread, rate)
    # Paths against their hosts: sizes, their squares within each host, and the spread around the host's rate.
    both = scratch.save(lookup(paths, hosts.withColumn("weight", F.col("host_n")), "_host", "weight"), "sites")
    inner = both.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2 / F.col("host_n")).alias("part"), F.count(F.lit(1)).alias("paths"), F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("host_good") / F.col("host_n")) ** 2).alias("spread")).first()
    # The sum over hosts of n - squares / n is n - part; one degree of freedom goes to each host.
    path_prior = strength(n, (inner["part"] or 0.0) * n, (inner["paths"] or 0) - whole["sites"] + 1, inner["spread"] or 0.0, rate)
    sites = both.select("key", "n", "good", "host_n", "host_good", F.col("n").alias("weight"))
    out = lookup(held, scratch.save(sites, "site-table"), "key", "weight")
    p_host = (F.col("host_good") - F.col("share") + host_prior * rate) / (F.col("host_n") - 1 + host_prior)
    p_path = (F.col("good") - F.col("share") + path_prior * F.col("p_host")) / (F.col("n") - 1 + path_prior)
    odds = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4)) / (1 - F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))))
    out = out.withColumn("p_host", p_host).withColumn("p_path", p_path)
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(odds(F.col("p_doc")) + odds(F.col("p_path")) - math.log(rate / (1 - rate))))))
    return out.select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "p_doc", "p_host", "p_path", "posterior", (F.col("posterior") >= THRESHOLD).alias("kept"))
