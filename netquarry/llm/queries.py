"""The queries of this subpackage, each over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(slim, F.col("doc_id"), 8, tie=F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = classify(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"), labels, F.col("source"), F.col("lang"))
    return out.select("doc_id", "host", "path", *(F.round(c, 6).alias(c) for c in ("p_doc", "p_host", "p_path", "posterior")), "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedupe

    out = dedupe(documents(spark, sf_dir).select("doc_id", "text"), drop_empty=False)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import classes

    return classes(documents(spark, sf_dir).select("doc_id", "text"), 3, 90, 100)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import round_trip

    return round_trip(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import labels

    return labels(documents(spark, sf_dir).select("doc_id", "text"), F.xxhash64("doc_id") % 2 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, count_of, listed, spanned

    out = spanned(documents(spark, sf_dir).select("doc_id", "text"))
    counts = {f"n_{k}": count_of(F.col("_base"), i) for i, k in enumerate(KINDS[:4])}
    every = F.size("_spans").cast("long").alias("n_spans")
    return out.select("doc_id", *(c.alias(k) for k, c in counts.items()), every, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    out = judged(documents(spark, sf_dir).select("doc_id", "text"), "text")
    return out.select("doc_id", *(F.col(f"_f.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import digests

    return digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import leaf, proofs

    docs = documents(spark, sf_dir)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(*columns, lower))
    return proofs(docs, F.col("lang"), leaf(*columns, F.col("text")), "doc_id", tampered)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, remainder, score

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    out = score(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_store": op10_token_store,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_toxicity": op13_toxicity,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets, links by counting what pairs share, and their closure.
_CLASSES = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM w),
    t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t AS a JOIN t AS b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a)
    SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
    FROM s LEFT JOIN reach AS r ON s.doc_id = r.doc_id GROUP BY s.doc_id"""


def _weighed_rules() -> str:
    """Features, votes, expectation-maximisation as a recursive query of one row, and posteriors."""
    rules = range(9)
    share = lambda name: f"(n_{name} / greatest(n_words, 1))"
    length = "(word_chars / greatest(n_words, 1))"
    prose = f"{share('symbols')} < 0.02 AND {share('shouts')} < 0.02 AND {share('upper')} < 0.1 AND {share('short')} > 0.15 AND {length} BETWEEN 3 AND 9"
    good = [prose, "n_words >= 100"] + ["false"] * 7
    bad = ["false", "n_words < 20", f"NOT {length} BETWEEN 2 AND 12", f"{share('symbols')} > 0.1", "n_dup_lines > 5"]
    bad += [f"{share('repeat_words')} > 0.3", f"{share('shouts')} > 0.15", f"{share('short')} < 0.08", f"{share('upper')} > 0.3"]
    votes = ", ".join(f"CASE WHEN {bad[j]} THEN -1 WHEN {good[j]} THEN 1 ELSE 0 END AS v{j}" for j in rules)
    names = ", ".join(f"v{j}" for j in rules)
    same = " AND ".join(f"d.v{j} = q.v{j}" for j in rules)
    odds = " + ".join(f"CASE v{j} WHEN 1 THEN ln(gg{j} / gb{j}) WHEN -1 THEN ln(bg{j} / bb{j}) ELSE 0 END" for j in rules)
    posterior = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds})))"
    start = ", ".join(f"0.7::DOUBLE AS gg{j}, 0.3::DOUBLE AS gb{j}, 0.05::DOUBLE AS bg{j}, 0.5::DOUBLE AS bb{j}" for j in rules)
    rate = lambda j, vote, side, first: f"least(0.98, greatest(0.001, (sum(CASE WHEN v{j} = {vote} THEN n * {side} ELSE 0 END) + 10 * {first}) / (sum(n * {side}) + 10)))"
    sums = ", ".join(
        f"{rate(j, 1, 'q', 0.7)} AS gg{j}, {rate(j, 1, '(1 - q)', 0.3)} AS gb{j}, {rate(j, -1, 'q', 0.05)} AS bg{j}, {rate(j, -1, '(1 - q)', 0.5)} AS bb{j}" for j in rules
    )
    tied = ", ".join(f"gg{j}, least(gb{j}, gg{j} / 4) AS gb{j}, least(bg{j}, bb{j} / 4) AS bg{j}, bb{j}" for j in rules)
    prior = "greatest(0.5, least(0.99, (sum(n * q) + 10 * 0.85) / (sum(n) + 10)))"
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
    repeats AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id),
    f AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts, len(list_filter(w, lambda x: length(x) <= 3 AND lower(x) <> upper(x))) AS n_short,
        len(list_filter(w, lambda x: length(x) >= 3 AND upper(x) = x AND lower(x) <> x)) AS n_upper FROM w LEFT JOIN repeats AS r ON w.doc_id = r.doc_id),
    d AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {votes} FROM f),
    patterns AS (SELECT {names}, count(*)::DOUBLE AS n FROM d GROUP BY ALL),
    fit AS (SELECT 0 AS turn, 0.85::DOUBLE AS prior, {start}
        UNION ALL SELECT turn + 1, prior, {tied} FROM (SELECT turn, {prior} AS prior, {sums} FROM (SELECT turn, n, {names}, {posterior} AS q FROM fit, patterns WHERE turn < 30) GROUP BY turn)),
    q AS (SELECT {names}, {posterior} AS p FROM patterns, (SELECT * FROM fit WHERE turn = 30))
    SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS p_good FROM d JOIN q ON {same}"""


def _tree(k: int, levels: int, step: str) -> str:
    """CTEs of the runs and nodes of each level above step0 (g, i, h), a lone node of g staying as it is."""
    out = ""
    for n in range(levels):
        out += f"""
    {step}run{n} AS (SELECT g, i // {k} AS i, list(h ORDER BY i) AS hs, any_value(c) AS c
        FROM (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM {step}{n}) GROUP BY g, i // {k}),
    {step}{n + 1} AS (SELECT g, i, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {step}run{n}),"""
    return out


def _manifest(groups: int = 3, levels: int = 7) -> str:
    """Trees of eight, by level: up to 8^levels rows of a lang and 8^groups langs. The crc of a number's digits by its bits."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    head = ", ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(range(8), lambda a, k: {bit}, xor(r, x))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce({digits}, lambda r, x: {byte}, 4294967295), 4294967295)"
    parts = [("lang", "f.g", n, f"f.i // {8**n}") for n in range(levels)] + [("top", "''", n, f"f.gi // {8**n}") for n in range(groups)]
    folds = ""
    for k, (step, group, n, at) in enumerate(parts):
        before, after = f"array_to_string(r.hs[1:{at} % 8], '')", f"array_to_string(r.hs[{at} % 8 + 2:], '')"
        folds += f"""
    fold{k + 1} AS (SELECT f.doc_id, f.leaf, f.g, f.i, f.gi, concat(f.proof, {before}, {after}) AS proof,
        CASE WHEN r.c = 1 THEN f.h ELSE sha256(concat({before}, f.h, {after})) END AS h
        FROM fold{k} AS f JOIN {step}run{n} AS r ON r.g = {group} AND r.i = {at} // 8),"""
    return f"""
    WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE concat('=', lang) END AS g, sha256(concat({head}, {value("text")})) AS leaf,
        CASE WHEN {crc} % 3 = 0 THEN sha256(concat({head}, {value(lower)})) END AS other FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
    lang0 AS (SELECT g, i, leaf AS h FROM leaves),{_tree(8, levels, "lang")}
    top0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS name FROM lang{levels}),{_tree(8, groups, "top")}
    fold0 AS (SELECT l.doc_id, l.leaf, l.g, l.i, t.i AS gi, '' AS proof, coalesce(l.other, l.leaf) AS h FROM leaves AS l JOIN top0 AS t ON t.name = l.g),{folds}
    done AS (SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root
        FROM fold{len(parts)} AS f JOIN lang{levels} AS s ON s.g = f.g CROSS JOIN top{groups} AS r)
    SELECT *, folded_root = root AS verified FROM done"""


ORACLES: dict[str, str] = {
    "op12_merkle": _manifest(),
    "op4_jaccard_join": _CLASSES,
    "op9_quality_rules": _weighed_rules(),
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, true) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
