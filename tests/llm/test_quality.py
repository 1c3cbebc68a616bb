import cases
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import quality_classifier as qc
from netquarry.llm import quality_rules as qr
from netquarry.llm import queries


def test_features_are_those_of_brute_force(spark, documents, hard):
    repeats = ["a b c d e f g h " * 3, "x " * 40, "one two three four five six seven eight nine\n" * 2, "p q r s t u v w p q r s t u v w p"]
    extra = spark.createDataFrame([(900 + k, t) for k, t in enumerate(repeats)], "doc_id long, text string")
    every = documents.select("doc_id", "text").unionByName(hard.select("doc_id", "text")).unionByName(extra)
    for r in qr.features(every).collect():
        f = r["_f"]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == cases.quality(r["text"])


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op9_quality_rules"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES[name])
    mine = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, mine)) == sorted(want.fetchall())


def test_posteriors_agree_with_plain_code(spark):
    """The fold in SQL against the same updates in numpy."""
    pick = np.random.default_rng(4)
    good = pick.random(4000) < 0.8
    votes = np.stack([np.where(pick.random(4000) < 0.6, np.where(pick.random(4000) < 0.9, good, ~good) * 2 - 1, 0) for _ in range(4)], 1)
    codes = ((votes + 1) * 3 ** np.arange(4)).sum(1)
    df = spark.createDataFrame([(int(c),) for c in codes], "_votes int")
    mine = {r["_votes"]: r["p_good"] for r in qr.posteriors(df, 4).collect()}
    gg, gb, bg, bb, prior = (np.full(4, x) for x in (0.7, 0.3, 0.05, 0.5, 0.85))
    prior = 0.85
    up = votes == 1
    down = votes == -1
    for step in range(qr.ITERATIONS + 1):
        odds = np.log(prior / (1 - prior)) + (up * np.log(gg / gb) + down * np.log(bg / bb)).sum(1)
        p = 1 / (1 + np.exp(-odds))
        if step == qr.ITERATIONS:
            break
        rate = lambda hit, w, start: np.clip(((hit * w[:, None]).sum(0) + qr.PRIOR_DOCS * start) / (w.sum() + qr.PRIOR_DOCS), 0.001, 0.98)
        gg, gb, bg, bb = rate(up, p, 0.7), rate(up, 1 - p, 0.3), rate(down, p, 0.05), rate(down, 1 - p, 0.5)
        gb, bg = np.minimum(gb, gg / qr.MARGIN), np.minimum(bg, bb / qr.MARGIN)
        prior = np.clip((p.sum() + qr.PRIOR_DOCS * qr.PRIOR_GOOD) / (len(p) + qr.PRIOR_DOCS), 0.5, 0.99)
    assert np.allclose([mine[int(c)] for c in codes], p, atol=1e-9)
    assert ((p > 0.5) == good).mean() > 0.9


def test_rules_keep_what_labels_call_good(spark):
    sf = "/root/testdata/sf0.01"
    out = qr.judged(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "text")
    both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in both}
    assert kept[1] == 1.0 and kept[0] < 0.2


def test_keep_of_hard_and_no_rows(hard):
    out = qr.keep(hard)
    assert out.columns == hard.columns
    assert all(len(cases.words(r["text"])) >= 20 for r in out.collect())
    assert qr.keep(hard.limit(0)).count() == 0
    judged = qr.judged(hard.select("doc_id", "text"))
    assert judged.count() == hard.count() and judged.filter("text is null and not base_failed").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    fitted = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    out = qc.classify(docs, fitted, F.col("source"), F.col("lang")).join(labels.filter(F.xxhash64("doc_id") % 2 != 0), "doc_id").select("kept", "label", "posterior").collect()
    right = np.mean([r["kept"] == (r["label"] == 1) for r in out])
    good = np.mean([r["kept"] for r in out if r["label"] == 1])
    assert len(out) > 1000 and right > 0.97 and good > 0.99


def test_posteriors_equal_plain_code(spark):
    """Strengths, site rates and posteriors of a small table against the same sums in numpy."""
    pick = np.random.default_rng(6)
    rows = [(k, f"{'plain words of some length here ' * int(pick.integers(1, 9))}{'#' * int(pick.integers(0, 9))}", f"h{k % 7}", f"p{k % 3}", int(pick.random() < 0.2 + 0.1 * (k % 7))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, label int")
    known = {k: y for k, _, _, _, y in rows if k % 2}
    labels = spark.createDataFrame(list(known.items()), "doc_id long, label int")
    out = {r["doc_id"]: r for r in qc.classify(df, labels, F.col("host"), F.col("path")).collect()}
    share = np.array([known.get(k, out[k]["p_doc"]) for k in range(600)], float)
    host, path = (np.array([r[c] for r in rows]) for c in (2, 3))
    sites = {}
    for h in set(host):
        sites[h] = (share[host == h], {p: share[(host == h) & (path == p)] for p in set(path[host == h])})
    n, rate = 600, float(np.clip(share.mean(), 0.001, 0.999))
    spread = sum(len(s) * (s.mean() - rate) ** 2 for s, _ in sites.values())
    top = qc.strength(n, sum(len(s) ** 2 for s, _ in sites.values()), len(sites), spread, rate)
    inner = sum(len(p) * (p.mean() - s.mean()) ** 2 for s, ps in sites.values() for p in ps.values())
    part = sum(len(p) ** 2 / len(s) for s, ps in sites.values() for p in ps.values())
    low = qc.strength(n, part * n, sum(len(ps) for _, ps in sites.values()) - len(sites) + 1, inner, rate)
    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    for k in range(600):
        s, ps = sites[host[k]]
        p = ps[path[k]]
        p_host = (s.sum() - share[k] + top * rate) / (len(s) - 1 + top)
        p_path = (p.sum() - share[k] + low * p_host) / (len(p) - 1 + low)
        posterior = 1 / (1 + np.exp(-(odds(out[k]["p_doc"]) + odds(p_path) - np.log(rate / (1 - rate)))))
        assert np.allclose([out[k]["p_host"], out[k]["p_path"], out[k]["posterior"]], [p_host, p_path, posterior], atol=1e-9)


def test_the_fit_has_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(qc, "FIT_ROWS", 400)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    sample = qc.fit_sample(rows)
    assert 150 < len(sample) <= 400 and {r["label"] for r in sample} == {0, 1}
    assert len(qc.fit_sample(rows.limit(300))) == 300 and qc.fit_sample(rows.limit(0)) == []


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(k, "plain words of some length here", "big", "p", 1 if k % 10 else 0) for k in range(400)]
    rows += [(1000 + k, "plain words of some length here", "bad", "p", 0 if k % 10 else 1) for k in range(400)]
    rows += [(2000, "plain words of some length here", "tiny", "p", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, label int")
    out = {r["host"]: r for r in qc.classify(df, df.select("doc_id", "label"), F.col("host"), F.col("path")).collect()}
    assert out["big"]["p_host"] > 0.85 and out["bad"]["p_host"] < 0.15 and abs(out["tiny"]["p_host"] - 0.5) < 0.1
    assert out["big"]["posterior"] > out["tiny"]["posterior"] > out["bad"]["posterior"]


def test_classify_hard_and_no_rows(hard):
    labels = hard.select("doc_id", F.lit(1).alias("label"))
    for known in (labels, labels.limit(0), hard.select("doc_id", F.when(F.col("doc_id") > 4, 1).otherwise(0).alias("label"))):
        out = qc.classify(hard, known, F.col("source"), F.col("lang"))
        assert out.count() == hard.count() and out.filter("posterior is null or isnan(posterior)").count() == 0
    assert qc.classify(hard.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
