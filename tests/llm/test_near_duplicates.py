import random
import time

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import jaccard_join as jj
from netquarry.llm import line_dedup, pii, scratch
from netquarry.llm.components import components


def own(df, k, num, den):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.classes(df, k, num, den).collect()}


@pytest.mark.parametrize("k, num, den, rare, buckets", [(3, 90, 100, 16, 1 << 20), (5, 80, 100, 2, 2000), (3, 90, 100, 1, 500)])
def test_classes_equal_brute_force(spark, monkeypatch, k, num, den, rare, buckets):
    """Also where every token is frequent, so that combinations carry the join, and with small blocks, buckets and hubs."""
    for name, value in (("RARE", rare), ("BUCKET_TOKENS", buckets), ("BLOCK_TOKENS", buckets), ("HUB_TEXTS", 7), ("BUCKET_ROWS", 256 if rare == 16 else 3)):
        monkeypatch.setattr(jj, name, value)
    rows = cases.near_copies(seed=rare)
    assert own(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den) == cases.classes(rows, k, num, den)


def test_a_large_bucket_is_compared_in_blocks(spark):
    """20,000 members of one label and two strangers: both strangers' partners are found, no pair of the label is made."""
    rule = jj.Rule(90, 100)
    words = [f"w{k}" for k in range(jj.BITS)]
    bits = lambda c: [F.when(c, F.lit(k)).otherwise(F.xxhash64("id", F.lit(k))).alias(w) for k, w in enumerate(words)]
    rows = spark.range(20_002).select(
        F.lit(5).cast("long").alias("key"), F.col("id").alias("rep"), F.lit(100).cast("long").alias("n"),
        F.when(F.col("id") >= 20_000, F.col("id")).otherwise(F.lit(0)).alias("label"), *bits(F.col("id").isin(17, 20_000, 20_001)),
    )
    out = jj.across(scratch.save(rows, "bucket"), rule)
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(17, 20_000), (17, 20_001), (20_000, 20_001)]


def test_a_chain_of_links(spark):
    """Each text differs from the next by a little and from the first by a lot."""
    words = [f"t{i}" for i in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 120])) for k in range(40)]
    out = own(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert out == cases.classes(rows, 3, 90, 100) and {c for _, c in out.values()} == {0}


def test_on_documents(documents, rows):
    assert own(documents, 3, 90, 100) == cases.classes(rows.items(), 3, 90, 100)


def test_hard_and_no_rows(hard):
    out = jj.classes(hard, 3, 90, 100)
    assert out.count() == hard.count()
    same = {r["component_id"] for r in out.collect() if r["doc_id"] in (6, 7)}
    assert same == {5}
    kept = jj.keep_one(hard)
    assert kept.columns == hard.columns and kept.filter("text = 'same text here' and doc_id > 5").count() == 0
    assert kept.filter("text is null").count() == 2
    assert jj.classes(hard.limit(0)).count() == 0


def test_losses_and_indexes_miss_no_partner():
    """For sizes and partners at the threshold: the losses allowed are enough, and some index holds both."""
    for num, den in ((90, 100), (80, 100)):
        rule = jj.Rule(num, den)
        for n in range(2, 400):
            for m in range(n, n * den // num + 1):
                common = -(-num * (n + m) // (num + den))
                if common <= n and den * common >= num * (n + m - common):
                    assert n - common <= rule.losses(n) and m - common <= rule.losses(m)
                    assert set(rule.classes(n)) & set(rule.classes(m))
                    for low in range(0, n + 1, max(1, n // 9)):
                        for gap in (0, n - common):
                            other = low + m - common if not gap else max(0, low - gap)
                            both_low = rule.in_low(n, low) and rule.in_low(m, other)
                            assert both_low or (rule.in_all(n, low) and rule.in_all(m, other)) or rule.share == 1


def test_components(spark):
    pick = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in pick.integers(0, 300, (220, 2)) if a != b] + [(1000 + k, 1001 + k) for k in range(60)]
    up = {x: x for e in links for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in out} == {x: top(x) for x in up}


def lines_left(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_dedup.dedupe(df, **options).collect()}


def test_recurring_lines_and_templates(spark):
    a = "the quick brown fox jumps over the lazy dog every single morning"
    out = lines_left(
        spark,
        [
            (1, f"{a}\nfirst own line of this one document here"),
            (2, f"own text of the second document stands here\n{a}"),
            (3, a.replace("lazy", "tired") + "\nthe third has some text too that is its own"),
            (4, "Connection from 10.0.0.1 port 4711 was closed by peer\nyes no maybe"),
            (5, "Connection from 10.9.9.9 port 80 was closed by peer\nyes no maybe"),
            (6, a),
            (7, "twice in one document is not across documents\ntwice in one document is not across documents"),
            (8, "the quick brown cat sat on a mat and looked at us"),
        ],
    )
    assert out == {
        1: f"{a}\nfirst own line of this one document here",
        2: "own text of the second document stands here",
        3: "the third has some text too that is its own",
        4: "Connection from 10.0.0.1 port 4711 was closed by peer\nyes no maybe",
        5: "yes no maybe",
        7: "twice in one document is not across documents\ntwice in one document is not across documents",
        8: "the quick brown cat sat on a mat and looked at us",
    }


def test_verbatim_lines_equal_brute_force(documents, rows):
    """Every verbatim repetition goes; what goes besides is like a line that stays."""
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedupe(documents, drop_empty=False).collect()}
    holders, first = {}, {}
    for i in sorted(rows):
        for k, line in enumerate(rows[i].split("\n")):
            key = tuple(cases.words(line))
            if len(key) >= 5 and sum(not any(c.isdigit() for c in w) for w in key) >= 4:
                holders.setdefault(key, set()).add(i)
                first.setdefault(key, (i, k))
    for i, text in rows.items():
        want = [x for k, x in enumerate(text.split("\n")) if len(holders.get(key := tuple(cases.words(x)), ())) < 2 or first[key] == (i, k)]
        left = iter(want)
        got = out[i].split("\n") if out[i] else []
        assert all(any(x == y for y in left) for x in got)  # in order, and none that repeats


def letters(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def test_crowded_leaves_lose_no_template(spark):
    """Lines that differ at the fifth place merge in a leaf of any size."""
    rows = [(k, f"same start of all x{letters(k)} kinds here") for k in range(4200)]
    assert lines_left(spark, rows) == {0: rows[0][1]}


def test_lines_that_differ_in_two_of_five_words_stay(spark):
    """Also in a leaf of many templates, where short marks of words would be equal by chance; equal rows don't matter."""
    rows = [(k, f"one fixed opening u{letters(k)} v{letters(k)}") for k in range(1500)]
    assert lines_left(spark, rows + rows[:3]) == dict(rows)


def test_frequent_short_and_mostly_variable_lines_go(spark):
    """Few documents are chance, and so is a line that stands often in one; numbers alone must be equal."""
    rows = [(k, f"own {letters(k)}\nAll rights reserved.\n10.0.0.{k} 47{k} closed by peer\n{k} {k + 1}") for k in range(12)]
    rows += [(20 + k, f"other {letters(k)}\nNo idea.") for k in range(3)] + [(30, "\n".join(["Ha ha."] * 20)), (31, "Ha ha.")]
    want = {i: t if i in (0, 20, 21, 22, 30, 31) else "\n".join(t.split("\n")[::3]) for i, t in rows}
    assert lines_left(spark, rows) == want


@pytest.mark.parametrize("n", [5, 6, 9, 10, 14, 15, 31])
def test_lookup_of_templates_equals_comparing_all(monkeypatch, n):
    pick = np.random.default_rng(n)
    rows = pick.integers(0, 4, (600, n)).astype(np.uint64)
    rows[300:] = np.where(pick.random((300, n)) < 0.15, 7, rows[:300])
    rows[:, : line_dedup.DEPTH] = 9
    found = []
    for limit in (0, 1 << 40):
        monkeypatch.setattr(line_dedup, "COMPARED", limit)
        leaf = line_dedup.Leaf(n)
        found.append([leaf.join(k, x) for k, x in enumerate(rows)])
    assert found[0] == found[1] and len(set(found[0])) < 600
    for k, name in enumerate(found[0]):
        assert (rows[k] == rows[name]).sum() * 10 >= 8 * n


def templates(spark, rows):
    """doc_id -> numbers of the dropped lines, by comparing each line with all templates before it. Only the order of lines is the operator's own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("th"))
    order = {(r["doc_id"], r["pos"]): r["line"] for r in line_dedup.lines_of(df).collect()}
    words = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            w = cases.words(line)
            if len(w) >= 5 and sum(not any(c.isdigit() for c in x) for x in w) >= 4:
                words[i, k] = ["*" if any(c.isdigit() for c in x) else x for x in w]
    firsts, template = {}, {}
    for _, place in sorted((order[p], p) for p in words):
        w = words[place]
        leaf = firsts.setdefault((len(w), *w[:3]), [])
        alike = next((f for f in leaf if 10 * sum(x == y for x, y in zip(words[f], w, strict=True)) >= 8 * len(w)), None)
        if alike is None:
            leaf.append(place)
        template[place] = alike or place
    places = {}
    for place, name in template.items():
        places.setdefault(name, []).append(place)
    out = {}
    for held in places.values():
        if len({i for i, _ in held}) > 1:
            for i, k in sorted(held)[1:]:
                out.setdefault(i, set()).add(k)
    return out


@pytest.mark.parametrize("head", [1 << 20, 6])
def test_templates_equal_brute_force(spark, monkeypatch, head, rows):
    """Also where leaves are settled in many rounds and parts."""
    for name, value in (("HEAD", head), ("PART_LINES", 5), ("MAX_HEAD", 4 * head)):
        monkeypatch.setattr(line_dedup, name, value)
    pick = random.Random(3)
    vocabulary = [f"w{letters(k)}" for k in range(12)]
    made = []
    for k in range(500):
        base = ["one", "fixed", "opening", *(vocabulary[j % 12] for j in range(pick.choice([2, 3, 7, 11, 17])))]
        for _ in range(pick.randrange(0, 5)):
            base[pick.randrange(3, len(base))] = pick.choice([*vocabulary, "4711"])
        made.append((k, " ".join(base) + f"\nown line of number x{letters(k)} y{letters(k)} z{letters(k)} here"))
    real = sorted(rows.items())[:120] if head < 100 else sorted(rows.items())
    for case in (made, real):
        df = spark.createDataFrame(case, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("th"))
        weak = {r["line"] for r in line_dedup.lines_of(df).filter("weak >= 0").collect()}
        of_line = {(r["doc_id"], r["pos"]): r["line"] for r in line_dedup.lines_of(df).collect()}
        got = {}
        for r in line_dedup.drops(df).collect():
            if strong := {k for k in r["drop"] if of_line[r["doc_id"], k] not in weak}:
                got[r["doc_id"]] = strong
        assert got == templates(spark, case)


def test_neighbours_in_a_leaf_change_nothing(spark):
    """Two lines that differ at the fourth word, alone and beside many others of their leaf."""
    pair = [(0, "same old start apple tree grows here now"), (1, "same old start peach tree grows here now")]
    others = [(10 + k, f"same old start a{letters(k)} b{letters(k)} c{letters(k)} d{letters(k)} e{letters(k)}") for k in range(4200)]
    assert lines_left(spark, pair) == dict(pair[:1])
    assert lines_left(spark, pair + others) == dict(pair[:1] + others)


def test_lines_of_hard_and_no_rows(hard):
    out = line_dedup.dedupe(hard)
    assert set(out.columns) == set(hard.columns) | {"n_dropped"} and out.filter("text is null").count() == 2
    assert line_dedup.dedupe(hard.limit(0)).count() == 0


PERSONAL = [
    "a@b.c x", None, "", "😀 mail é.x@y-z.co.uk, 010.1.2.3 4111 1111 1111 1111 +1 (743) 555-3824.",
    "1.2.3.256 1.2.3.4.5.6.7.8 00000255.1.1.1 4111-1111-1111-1112 4111-1111-1111-1111 +12345 a@b a@@b.c",
    "+1 4111111111111111 x@y.z,x@y.z." + "9" * 5000, "a." * 3000 + "@" + "b." * 3000 + "c", "+1-2-3-4-5-6-7-8-9 +(1) 1234567890 +49.30.1234567",
    "a@b.c_d@e.f x@y@z.w..1.2.3.4.5.6.7.8 1.2..3.4.5.6 a@b a%@c.d-@e.f", "@ " + "a" * 9_000, "1.2.3.4 a@b.c " + "7" * 9_000,
]


def test_base_spans_equal_brute_force(spark, documents, hard):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for docs in (df, documents, hard):
        out = pii.spanned(docs, ("doc_id", "text"))
        for r in out.select("text", pii.listed(out["_base"]).alias("b"), *(pii.count_of(out["_base"], k).alias(pii.KINDS[k]) for k in range(4))).collect():
            want = cases.personal(r["text"])
            assert r["b"] == want and [r[k] for k in pii.KINDS[:4]] == [want.count(k + ":") for k in pii.KINDS[:4]]


def test_base_spans_of_random_texts(spark):
    pick = random.Random(6)
    rows = [(k, "".join(pick.choice("ab1.@-_+ 2(9") for _ in range(pick.randrange(5, 60)))) for k in range(4000)]
    out = pii.spanned(spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id", "text"))
    for r in out.select("text", pii.listed(out["_base"]).alias("b")).collect():
        assert r["b"] == cases.personal(r["text"])


def test_long_runs_take_linear_time(spark):
    rows = [(1, "@ 1.2.3.4 " + "a" * 1_000_000), (2, "a@b.c 1.2 " + "7" * 1_000_000)]
    began = time.monotonic()
    out = pii.spanned(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("_base")).alias("b")).collect()
    assert dict(map(tuple, out)) == {1: "ip:2:9", 2: "email:0:5"} and time.monotonic() - began < 60


def test_disclosing_terms(spark):
    rows = [(k, f"{a} contact Zorblax Quonk zq@mail.example for {b} details") for k, (a, b) in enumerate([("one", "new"), ("two", "old"), ("six", "big"), ("ten", "red")])]
    rows += [(10, "Zorblax alone stays"), *((100 + k, f"plain words here contact details for number {k} and more") for k in range(60))]
    rows += [(200 + k, "a copy of contact Unique Person up@mail.example here") for k in range(9)]
    out = {r["doc_id"]: r["text"] for r in pii.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].split() == ["one", "contact", "<EMAIL>", "for", "new", "details"] and out[10] == "Zorblax alone stays"
    assert out[100] == rows[5][1] and out[200] == "a copy of contact Unique Person <EMAIL> here"


def test_copies_do_not_hide_a_term(spark):
    """Copies count once on both sides; words of one passage that only copies hold are no evidence."""
    far = "plain words here and more of them until the text is long enough to be far away from it"
    said = [f"{a} write to Zorblax at zq@mail.example for {b} details" for a, b in (("one", "new"), ("two", "old"), ("six", "big"), ("ten", "red"))]
    rows = list(enumerate(said)) + [(10 + k, said[0]) for k in range(80)]
    passage = "this peculiar passage by vb@post.example stands in near copies of one text alone"
    rows += [(200 + k, f"{passage} {'x' * 70} as number {letters(k)}") for k in range(6)]
    rows += [(300 + k, f"{far} number {letters(k)} at {letters(k)} for passage copies of text") for k in range(60)]
    out = {r["doc_id"]: r["text"] for r in pii.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zorblax" not in out[k] and "<EMAIL>" in out[k] for k in (*range(4), *range(10, 90)))
    assert all("peculiar passage" in out[200 + k] for k in range(6))
    assert all(out[300 + k] == dict(rows)[300 + k] for k in range(60))


def disclosed(rows):
    """entity -> term -> ratio by brute force over (doc_id, text)."""
    import math
    import re
    from collections import defaultdict

    texts, holds = {t for _, t in rows}, defaultdict(dict)
    for t in texts:
        for m in cases.EMAIL.finditer(t):
            around = f"{t[: m.start()][-60:]} {t[m.end() :][:60]}"
            for e in (f"0:{m.group().lower()}", f"0/{m.group().lower().split('@')[-1]}"):
                holds[e][t] = min(holds[e].get(t, around), around)
    holds = {e: set(of.items()) for e, of in holds.items()}
    terms = {t: set(re.findall(r"[^\W\d_]{3,}", cases.EMAIL.sub(" ", t).lower())) for t in texts}
    out = defaultdict(dict)
    for e, held in holds.items():
        n_e = len({t for t, _ in held})
        for term in set().union(*(terms[t] for t, _ in held)):
            mine = [(t, c) for t, c in held if term in terms[t]]
            if len({c for _, c in mine}) >= pii.MIN_CONTEXTS and n_e < len(texts):
                n_te, n_t = len({t for t, _ in mine}), sum(term in x for x in terms.values())
                ratio = math.log(n_te * len(texts) / (n_t * n_e)) / math.log(len(texts) / n_e)
                if ratio >= pii.GENERALISE:
                    out[e][term] = round(ratio, 6)
    return dict(out)


def test_ratios_equal_brute_force(spark):
    pick = random.Random(8)
    names = [f"name{letters(k)}" for k in range(12)]
    rows = []
    for k in range(400):
        who = pick.randrange(12)
        words = [pick.choice(["some", "plain", "words", "stand", "here", "also"]) for _ in range(pick.randrange(3, 9))]
        if pick.random() < 0.5:
            words.insert(pick.randrange(len(words)), f"u{letters(pick.randrange(3))}@host{letters(who)}.example")
            words += [names[who]] * (pick.random() < 0.8)
        rows.append((k, " ".join(words)))
    rows += [(400 + k, rows[k][1]) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = df.select(pii.doc_key(F.col("text")).alias("_key"), pii.base_spans(F.col("text")).alias("_base"))
    out = {r["entity"]: {t["term"]: round(t["ratio"], 6) for t in r["terms"]} for r in pii.disclosures(found, df).collect()}
    want = disclosed(rows)
    assert out == want and len(want) > 5


def test_one_text_is_no_evidence(spark):
    """A document that names an address many times keeps its words, and so do two."""
    own = [" ".join(f"{'qwx'[d]}own{letters(k)}" for k in range(60)) for d in range(3)]
    rows = [(1, f"x a@b.example y {own[0]} a@b.example z a@b.example w a@b.example"), (2, f"c@d.example {own[1]} here c@d.example"), (3, f"c@d.example {own[1]} there and c@d.example")]
    rows += [(100 + k, f"plain words of number {letters(k)} and no address") for k in range(80)]
    out = {r["doc_id"]: r["text"] for r in pii.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        assert out[k] == cases.EMAIL.sub("<EMAIL>", t)


def test_terms_that_disclose_what_single_entities_share(spark):
    """Each email occurs once; the term is far from it and stays where no email of the domain is."""
    far = "plain words here and more of them until the text is long enough to be far away from it"
    rows = [(k, f"Zorblax {far} number {letters(k)} write to {letters(k)}x@firm.example now") for k in range(5)]
    rows += [(10, "Zorblax alone stays"), *((100 + k, f"{far} write to number {letters(k)} now") for k in range(80))]
    out = {r["doc_id"]: r["text"] for r in pii.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k].strip() == f"{far} number {letters(k)} write to <EMAIL> now" for k in range(5))
    assert out[10] == rows[5][1] and out[100] == rows[6][1]


def test_clean_hard_and_no_rows(hard):
    out = pii.clean(hard)
    assert out.columns == hard.columns and sorted(map(str, out.collect())) == sorted(map(str, hard.collect()))
    assert pii.clean(hard.limit(0)).count() == 0


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y 1.2.3.4")], "doc_id long, text string")
    out = pii.clean(df).first()["text"]
    assert "1111" not in out and out.startswith("x ") and out.endswith("<IP>")


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_spans_are_not_shuffled(spark, monkeypatch):
    """Tables too large to be broadcast meet the texts with spans alone, and give the same spans."""
    pick = random.Random(9)
    filler = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") + pick.choice("0123456789") for _ in range(15_000))
    rows = [(k, f"{a} contact Zorblax Quonk zq@mail.example for {b} details") for k, (a, b) in enumerate([("one", "new"), ("two", "old"), ("six", "big"), ("ten", "red")])]
    rows += [(5, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), *((100 + k, filler()) for k in range(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = lambda: sorted((str(r["doc_id"]), r["s"]) for r in pii.spanned(docs).select("doc_id", pii.listed(F.col("_spans")).alias("s")).collect())
    want = spans()
    assert sum("term:" in s for _, s in want) == 7
    docs = spark.read.schema(docs.schema).parquet(scratch.save(docs, "docs")._scratch)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert spans() == want and shuffled(spark) - before < 1_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
