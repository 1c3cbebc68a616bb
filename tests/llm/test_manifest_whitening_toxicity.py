import math
import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import merkle, queries, toxicity, whitening
from netquarry.llm.lookup import screened


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels by plain code, up to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def beside(levels, i):
    """Siblings of leaf i, level by level."""
    out = []
    for row in levels[:-1]:
        run = i // 8 * 8
        out.append([x for k, x in enumerate(row[run : run + 8], run) if k != i])
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 600, 4095, 4096])
def test_paths_of_a_block(n):
    leaves = [h(str(k)).encode() for k in range(n)]
    levels = tree([x.decode() for x in leaves])
    height = merkle.levels(n)
    assert height == len(levels) - 1 and merkle.root(leaves, height).decode() == levels[-1][0]
    for i, path in enumerate(merkle.paths(leaves, height)):
        assert [[x.decode() for x in (*b, *a)] for b, a in path] == beside(levels, i)
        assert i % 50 or merkle.fold(leaves[i], path).decode() == levels[-1][0]


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def manifest(rows, columns):
    """leaf, subroot, root, proof digest and folded root of each row, with the n-th leaf of a group changed where n % 5 is 0."""
    leaf = lambda r: h(*(value(r[c]) for c in columns))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (known, key, own) in enumerate(sorted(groups[g])):
            siblings = beside(trees[g], i) + beside(top, k)
            out.append((key if known else None, own, trees[g][-1][0], top[-1][0], h(*(x for level in siblings for x in level))))
    return sorted(out, key=str)


def test_manifest_of_hard_rows(spark, hard):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.proofs(hard, F.col("lang"), merkle.leaf(*(F.col(c) for c in columns)), "doc_id", siblings=True).collect()
    mine = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in out), key=str)
    assert mine == manifest([r.asDict() for r in hard.collect()], columns)
    assert all(r["verified"] and r["folded_root"] == r["root"] and h(*(x for s in r["siblings"] for x in s)) == r["proof_sha256"] for r in out)
    assert merkle.proofs(hard.limit(0), F.col("lang"), F.lit(b"\0" * 32), "doc_id").collect() == []


def test_manifest_over_many_blocks(spark):
    """Blocks of 64 leaves, so that paths above them come from three more levels of blocks; a hot group and repeated rows."""
    pick = random.Random(3)
    rows = [(pick.randrange(4000), pick.choice(["en"] * 6 + ["de", None, "é", "", "z"]), f"t{pick.randrange(900)}") for _ in range(5000)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, lang string, text string").repartition(7)
    other = F.when(F.col("doc_id") % 5 == 0, merkle.leaf(F.upper("text")))
    out = merkle.proofs(df, F.col("lang"), merkle.leaf(F.col("doc_id"), F.col("text")), "doc_id", other, stack=1).collect()
    want = manifest([{"doc_id": a, "lang": b, "text": c} for a, b, c in rows + rows[:5]], ["doc_id", "text"])
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in out), key=str) == want
    assert all(r["verified"] == (r["doc_id"] % 5 != 0) == (r["folded_root"] == r["root"]) for r in out)


def test_manifest_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op12_merkle"])
    mine = queries.op12_merkle(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, mine)) == sorted(want.fetchall())
    # A changed leaf is noticed exactly where the tampering changes the text.
    assert 0 < sum(not r["verified"] for r in mine) < len(mine) / 2


def test_jacobi_equals_the_library():
    pick = np.random.default_rng(2)
    for d in (1, 2, 3, 8, 33):
        x = pick.normal(size=(200, d)) * 10.0 ** -np.arange(d).clip(max=6)
        m = x.T @ x
        values, vectors = whitening.jacobi(m)
        known = np.linalg.eigvalsh(m)[::-1]
        assert np.allclose(values, known, rtol=1e-9 if d < 4 else 1e-6, atol=1e-12 * known[0])
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.allclose(m @ vectors, vectors * values, atol=1e-10 * known[0])
    # Small eigenvalues of a badly scaled matrix keep their digits.
    scale = np.array([1.0, 1e-6, 1e-12])
    inner = np.array([[1, 0.3, 0.2], [0.3, 1, 0.4], [0.2, 0.4, 1]])
    values, _ = whitening.jacobi(inner * np.outer(scale, scale))
    assert math.isclose(np.prod(values), np.linalg.det(inner) * np.prod(scale) ** 2, rel_tol=1e-12)
    assert whitening.jacobi(np.zeros((4, 4)))[0].tolist() == [0.0] * 4


def test_whitening_equals_plain_code(spark):
    pick = np.random.default_rng(5)
    vectors = (pick.normal(size=(300, 5)) @ pick.normal(size=(5, 5)) * 3).astype(np.float32)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)] + [(7, vectors[7].tolist(), None), (None, vectors[8].tolist(), "y")]
    odd = [(900, None, ""), (901, [1.0, None, 2.0, 3.0, 4.0], ""), (902, [float("nan")] * 5, ""), (903, [float("inf")] * 5, ""), (904, [], ""), (905, [1.0] * 4, ""), (906, [1e30] * 5, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component string").repartition(5)
    out = whitening.whiten(df, "vec_id", "embedding", 4).collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r[1]] for r in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    exact = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    y = np.array(x, float) - np.array(sums, float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = y @ axes / np.sqrt(values)
    assert len(out) == n * 4 and {r["component"] for r in out} == {1, 2, 3, 4}
    by_key = {}
    for r in out:
        by_key.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    signs = [np.sign(want[0][c] * by_key[0, exact[0]][c + 1][0]["whitened"]) for c in range(4)]
    for k, (key, _, _) in enumerate(rows):
        for c in range(4):
            r = by_key[key, exact[k]][c + 1][0]
            assert r["n"] == n and abs(r["whitened"] * signs[c] - want[k][c]) < 1e-8
            assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9


def test_whitening_without_components(spark):
    shape = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], shape), "vec_id", "embedding").collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 3, shape), "vec_id", "embedding").collect() == []
    # Deviations beyond 64 bits are exact; one of two dimensions has no spread.
    big = float(1 << 44)
    out = whitening.whiten(spark.createDataFrame([(k, [big * k, 1.0]) for k in range(4)], shape), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"], r["component"], int(r["deviation"])) for r in out) == [(k, 1, (64 * int(big) * (4 * k - 6)) ** 2) for k in range(4)]


def test_words_and_pooling_equal_plain_code():
    texts = ["One, two one.", "", None, "  ", "x", "Größe größe GRÖSSE-two", "a b c d e f g"]
    ids, of, offsets = toxicity.words(pa.array(texts))
    mine = [[tuple(ids[k]) for k in of[a:b]] for a, b in zip(offsets, offsets[1:], strict=False)]
    plain = [["one", "two", "one"], [], [], [], ["x"], ["größe", "größe", "grösse", "two"], list("abcdefg")]
    assert [len(x) for x in mine] == [len(x) for x in plain]
    known = {}
    for a, b in zip(sum(mine, []), sum(plain, []), strict=True):
        assert known.setdefault(b, a) == a
    assert len(set(known.values())) == len(known)
    assert known["größe"][1:3] == known["grösse"][1:3]  # equal beginnings have equal rows
    model = toxicity.Model.new(np.append(np.ones(toxicity.BUCKETS, bool), False), 1)
    pooled, *_ = model.pooled(ids, of, offsets)
    vector = lambda row: sum(model.table[model.slots[i]] for i in row) / max(1, sum(i != toxicity.BUCKETS for i in row))
    for k, row in enumerate(mine):
        v = [vector(r) for r in row] + [np.zeros(toxicity.SIZE)] * 3
        want = []
        for w, f in zip(toxicity.WIDTHS, model.filters, strict=True):
            want.append(np.max([sum(v[i + j] @ f[j] for j in range(w)) for i in range(max(1, len(row)))], axis=0))
        assert np.allclose(pooled[k], np.concatenate(want), atol=1e-5)


def test_gradient_is_that_of_the_loss(monkeypatch):
    """A step moves each weight against the slope that small changes of it show."""
    ids, of, offsets = toxicity.words(pa.array(["bad word here", "good word there", "bad bad", "fine"]))
    y = np.array([1, 0, 1, 0], np.float32)
    model = toxicity.Model.new(np.append(np.ones(toxicity.BUCKETS, bool), False), 2)

    def loss():
        pooled, *_ = model.pooled(ids, of, offsets)
        z = np.maximum(pooled + np.concatenate(model.biases), 0) @ model.last + model.bias
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    slopes = []
    for array, at in ((model.filters[1], (0, 3, 2)), (model.biases[0], (4,)), (model.table, (model.slots[ids[of[0]][0]], 5))):
        before = array[at]
        array[at] = before + 1e-2
        up = loss()
        array[at] = before - 1e-2
        slopes.append((array, at, before, (up - loss()) / 2e-2))
        array[at] = before
    model.step(ids, of, offsets, y, {})
    for array, at, before, slope in slopes:
        assert abs(slope) < 1e-4 or np.sign(before - array[at]) == np.sign(slope)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = {r["doc_id"]: r for r in queries.op13_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in out.items())
    held = [(out[k]["predicted"], out[k]["toxic"], y) for k, y in labels.items() if k in out and out[k]["held_out"]]
    for mine in (0, 1):
        hits, taken = sum(bool(x[mine]) and x[2] for x in held), sum(bool(x[mine]) for x in held)
        assert hits / taken > 0.9 and hits / sum(x[2] for x in held) > 0.75, (mine, hits, taken)


def test_toxicity_of_hard_rows(spark, hard, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 20)
    base = [(100 + k, "you idiot text" if k % 2 else "some fine text", "en", "s", None) for k in range(60)]
    more = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, score double")
    docs = hard.select("doc_id", "text", "lang", "source", F.lit(None).cast("double").alias("score")).unionByName(more)
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(60)] + [(None, 1), (100, None), (3, 0), (3, 1)], "doc_id long, label int")
    out = toxicity.score(docs, labels, ("doc_id", "text")).collect()
    assert len(out) == docs.count()
    by_text = {}
    for r in out:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert by_text["you idiot text"] > by_text["some fine text"]
    # Labels of held-out rows and languages of documents change no score.
    turned = labels.withColumn("label", F.when(toxicity.remainder(F.col("doc_id")) == 1, 1 - F.col("label")).otherwise(F.col("label")))
    again = toxicity.score(docs.withColumn("lang", F.lit("xx")), turned, ("doc_id", "text")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["score"]) for r in again) == sorted((str(r["doc_id"]), r["text"] or "", r["score"]) for r in out)
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["threshold"] for r in none} == {toxicity.THRESHOLD}
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """A word that only some of many labelled rows show, those of the largest hashes, and only in long texts besides."""
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 20)
    monkeypatch.setattr(toxicity, "PART_ROWS", 2500)
    late = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) > int(0.85 * (1 << 32))
    ids = spark.range(12_000).select(F.col("id").alias("doc_id"), (late & (F.col("id") % 2 == 0)).cast("int").alias("label"))
    plain = F.concat(F.lit("plain words of number n"), F.col("doc_id").cast("string"))
    long = F.concat(plain, F.when(F.col("doc_id") % 100 < 2, F.repeat(F.lit(" and more"), 40_000)).otherwise(F.lit("")))
    docs = ids.select("doc_id", F.concat(long, F.when(F.col("label") == 1, F.lit(" zorbly end")).otherwise(F.lit(" other end"))).alias("text"), F.lit("en").alias("lang"))
    rows = toxicity.labelled(docs, ids)
    want = [r for r in ids.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    assert rows.count() == len(want) > 7500 and rows.filter("length(text) > 300000").count() == sum(r["doc_id"] % 100 < 2 for r in want)
    assert rows.agg(F.sum("label")).first()[0] == sum(r["label"] for r in want)
    short = docs.filter("length(text) < 1000")
    out = toxicity.score(short, ids).join(ids, "doc_id").groupBy("label").agg(F.min("score").alias("a"), F.max("score").alias("b")).collect()
    by = {r["label"]: r for r in out}
    assert by[1]["a"] > 0.7 > by[0]["b"]
    # How the documents are dealt to tasks changes no score.
    few = short.filter("doc_id < 20")
    model, other = (toxicity.train(toxicity.labelled(short.repartition(n), ids))[0] for n in (3, 5))
    texts = pa.array([r["text"] for r in few.collect()], pa.large_string())
    assert model.scores(texts).tolist() == other.scores(texts).tolist()


def test_texts_with_a_piece_and_screened_rows(spark):
    texts = ["one two one", "onetwo three", "", "two TWO", "threes three one"]
    ids, of, offsets = toxicity.words(pa.array(texts, pa.large_string()))
    want = np.zeros(toxicity.BUCKETS + 1, int)
    for a, b in zip(offsets, offsets[1:], strict=False):
        for k in {int(i) for w in of[a:b] for i in ids[w]} - {toxicity.BUCKETS}:
            want[k] += 1
    assert toxicity.texts_with(pa.array(texts, pa.large_string())).tolist() == want.tolist() and want.max() == 2
    docs = spark.range(-3000, 40_000).select(F.col("id").alias("doc_id"))
    known = docs.filter("doc_id % 40 = 0")
    left, others = ({r["doc_id"] for r in screened(docs, "doc_id", known, "doc_id", known.count(), how).collect()} for how in ("left_semi", "left_anti"))
    assert left >= {r["doc_id"] for r in known.collect()} and len(left) < 6000
    assert not left & others and len(left) + len(others) == docs.count()


def test_calibration_by_counted_logits():
    pick = np.random.default_rng(4)
    logits = np.rint(pick.normal(0, 2, 500) * 8) / 8
    y = (pick.random(500) < 1 / (1 + np.exp(-logits))).astype(float)
    keys, n = np.unique(np.stack([logits, y], 1), axis=0, return_counts=True)
    one = np.ones(500)
    assert np.allclose(toxicity.platt(logits, y, one), toxicity.platt(keys[:, 0], keys[:, 1], n.astype(float)))
    assert math.isclose(toxicity.best_cut(logits, y, one), toxicity.best_cut(keys[:, 0], keys[:, 1], n.astype(float)))
