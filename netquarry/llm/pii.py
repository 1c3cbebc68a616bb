"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal what the patterns protect.

An entity is the text of a base span, and so is what it shares with others of its kind: an email's domain, an ip's first
three numbers, a card's issuer (six digits), a phone number without its last four digits. Most texts of spans occur once,
and their estimate is that of what they share. A term t of the documents with an entity e has pointwise mutual information
log(p(t,e) / (p(t) p(e))); the entity's own information is -log p(e). Their ratio is 1 when t says as much as e itself.
Terms at REMOVE or more are removed and those at GENERALISE or more are generalised, in the documents that hold e.
Probabilities are shares of different texts, so a copy counts once on every side. A pair of entity and term also needs
MIN_CONTEXTS texts in which the surroundings of e (the CONTEXT characters on either side) differ, each text having one, so
that neither the mentions of one text nor near copies of one passage are evidence for its words. Terms are whole words of whole texts, emails left out. All of it is SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .lookup import lookup, screened

#: Base patterns, in the order of the kinds. The quantifiers don't give back, and an email or ip starts where its run of
#: characters does or where the match before ended; both change no match, and keep long runs from being tried at each place.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 60
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.75, 0.9
#: Rows and bytes up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
SPAN = "struct<k:int,s:bigint,e:bigint,v:string,c:string>"


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column, of=lambda x: x, zero: str = "bigint") -> Column:
    return F.aggregate(array, F.lit(0).cast(zero), lambda a, x: a + of(x).cast(zero))


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """All matches as SPAN: kind, start and end in code points, value, context.

    What lies between the matches is what split returns, so a match starts after the lengths of all before it.
    """
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def step(at: Column, x: Column, i: Column, all_: Column) -> Column:
        start = at["p"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        context = F.concat(F.right(x["g"], F.lit(CONTEXT)), F.lit(" "), F.left(F.get(all_, i)["g"], F.lit(CONTEXT)))
        one = F.struct(F.lit(kind).alias("k"), start.cast("bigint").alias("s"), end.cast("bigint").alias("e"), x["m"].alias("v"), context.alias("c"))
        return F.struct(end.cast("bigint").alias("p"), (at["i"] + 1).alias("i"), F.concat(at["out"], F.array(one)).cast(f"array<{SPAN}>").alias("out"))

    def spans(pieces: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(1).alias("i"), F.array().cast(f"array<{SPAN}>").alias("out"))
        held = F.filter(pieces, lambda x: x["m"].isNotNull())
        return F.aggregate(held, start, lambda at, x: step(at, x, at["i"], pieces), lambda at: at["out"])

    return let(found, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return total(doubled) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans by kind and start."""
    none = F.array().cast(f"array<{SPAN}>")
    octet = lambda x: F.char_length(F.ltrim(x, F.lit("0"))) <= 3
    low = lambda x: octet(x) & (F.coalesce(F.left(F.ltrim(x, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    number = lambda x: let(_digits(x["v"]), lambda n: F.char_length(n).between(16, 19) & luhn(n))
    return F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, F.lit(EMAIL), 0)).otherwise(none),
        F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(matches(text, F.lit(IP), 1), lambda x: F.forall(F.split(x["v"], r"\."), low))).otherwise(none),
        F.when(F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]")), F.filter(matches(text, F.lit(CARD), 2), number)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(matches(text, F.lit(PHONE), 3), lambda x: F.char_length(_digits(x["v"])).between(8, 15))).otherwise(none),
    ).cast(f"array<{SPAN}>")


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order of kind and start, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["k"].cast("string"), F.lower(span["v"]))


def entities_of(span: Column) -> Column:
    """The entity of a span and what it shares with others of its kind."""
    value, digits = F.lower(span["v"]), _digits(span["v"])
    shared = F.when(span["k"] == 0, F.substring_index(value, "@", -1)).when(span["k"] == 1, F.substring_index(value, ".", 3)).when(span["k"] == 2, F.left(digits, F.lit(6))).otherwise(F.left(digits, F.char_length(digits) - 4))
    return F.array(entity(span), F.concat_ws("/", span["k"].cast("string"), shared))


def prose(text: Column) -> Column:
    """text without emails, the only spans with letters."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)


def terms_in(context: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(context), F.lit(r"[\p{L}]{3,}"), F.lit(0)))


def disclosures(found: DataFrame, docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """entity, n and terms (term and ratio) of every entity with terms that exceed GENERALISE. found: a saved table of _key and _base, the spans.

    The counts cover all documents; n is the number of spans' documents with the entity. texts: _key and _text of the
    documents with spans, which spares a join of all texts.
    """
    text = F.coalesce("text", F.lit(""))
    spans = found.filter(F.size("_base") > 0).select("_key", F.explode("_base").alias("x"))
    seen = spans.select("_key", F.explode(entities_of(F.col("x"))).alias("entity"), F.col("x.c").alias("context"))
    # Of equal texts, one holds the entity, and of a text's mentions, one gives the surroundings.
    one = seen.groupBy("entity", F.col("_key.text").alias("th"))
    one = one.agg(F.min("_key").alias("_key"), F.xxhash64(F.min("context")).alias("context"), F.count(F.lit(1)).alias("n"))
    holders = scratch.save(one, "holders")
    rated = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.count_distinct("context").alias("contexts"), F.sum("n").alias("n"))
    rated = scratch.save(rated.filter(F.col("contexts") >= MIN_CONTEXTS).drop("contexts"), "rated")
    if rated.isEmpty():
        return nothing(found)
    # A text's row is that of its least key, whatever entity asks for it.
    of_text = lookup(holders.drop("n"), rated, "entity", "n").filter("n_e is not null")
    of_text = of_text.groupBy("th").agg(F.min("_key").alias("_key"), F.collect_set(F.struct("entity", "n_e", "context")).alias("_of"))
    of_text = scratch.save(of_text, "rated-texts")
    texts = docs.select(doc_key(text).alias("_key"), text.alias("_text")) if texts is None else texts
    held = texts.join(small(of_text), "_key").dropDuplicates(["_key"])
    pairs = held.select("_of", "th", F.explode(terms_in(prose(F.col("_text")))).alias("term")).select(F.explode("_of").alias("x"), "th", "term")
    # A text has an entity once and a term once, so rows are texts.
    pairs = pairs.groupBy("x.entity", "x.n_e", "term").agg(F.count(F.lit(1)).alias("n_te"), F.count_distinct("x.context").alias("contexts"))
    counted = scratch.save(pairs.filter(F.col("contexts") >= MIN_CONTEXTS).drop("contexts"), "pairs")
    if counted.isEmpty():
        return nothing(found)
    wanted = small(scratch.save(counted.select("term").distinct(), "terms"))
    # Each different text counts once: all rows but the copies of the first one of each text.
    hashes = docs.select("doc_id", F.xxhash64(text).alias("th"))
    first = hashes.groupBy("th").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    n_texts = first.count()
    again = scratch.save(first.filter("n > 1").select(F.col("th").alias("_th"), "first"), "copied-texts")
    # Texts that surely have no copy stay where they are.
    every, n_again = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_h")), again.count()
    one = screened(every, "_h", again, "_th", n_again).join(small(again), F.col("_h") == F.col("_th"), "left")
    one = one.filter(F.col("_th").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select("_text")
    one = one.unionByName(screened(every, "_h", again, "_th", n_again, "left_anti").select("_text"))
    words = one.select(F.explode(terms_in(prose(F.col("_text")))).alias("term"))
    # Terms are counted before the join, which is an inner one so that it stays above the count.
    of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term")
    total_ = F.lit(float(max(n_texts, 2)))
    pmi = F.log(F.col("n_te") * total_ / (F.greatest("n_t", "n_te") * F.col("n_e")))
    own = F.log(total_ / F.col("n_e"))
    ratio = F.when(own > 0, pmi / own).otherwise(F.lit(0.0))
    strong = counted.join(of_term, "term").withColumn("ratio", ratio).filter(F.col("ratio") >= GENERALISE)
    # An entity in n_e texts has few terms that are as rare as itself: their arrays are short.
    strong = strong.groupBy("entity").agg(F.collect_list(F.struct("term", "ratio")).alias("terms"))
    return strong.join(rated.select("entity", "n"), "entity")


def nothing(found: DataFrame) -> DataFrame:
    """No entity with its n and terms."""
    return found.sparkSession.createDataFrame([], "entity string, terms array<struct<term:string,ratio:double>>, n long")


def doc_key(text: Column) -> Column:
    """What rows equal in doc_id and text share."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text"))


def small(df: DataFrame) -> DataFrame:
    """df, a saved table, with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes as JSON."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def spanned(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns carry of docs with _base (base spans) and _spans (all spans; v of a term is its ratio).

    A null text counts as empty and has no span. Rows equal in doc_id and text get the same spans. Terms are letters only,
    found as whole words in any case; one that meets a base span is left to it. An empty table gives no row. The base
    patterns run once over all texts and their spans are saved, with the texts that have any: only those are joined later.
    """
    text = F.coalesce("text", F.lit(""))
    key = doc_key(text).alias("_key")
    based = docs.select(*carry, key, base_spans(text).alias("_base"), text.alias("_text"))
    found = scratch.save(based.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))), "spans")
    texts, found = found.filter(F.size("_base") > 0).select("_key", "_text"), found.drop("_text")
    rules = scratch.save(disclosures(found, docs, texts), "disclosures")
    if rules.isEmpty():
        return found.withColumn("_spans", F.col("_base")).drop("_key")
    every = F.array_distinct(F.flatten(F.transform("_base", entities_of)))
    entities = found.filter(F.size("_base") > 0).select("_key", F.explode(every).alias("entity")).distinct()
    met = lookup(entities, rules, "entity", "n").filter("terms is not null").select("_key", F.explode("terms").alias("t"))
    # One document's terms make an array of its own size.
    per_doc = met.groupBy("_key", "t.term").agg(F.max("t.ratio").alias("ratio"))
    per_doc = per_doc.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("term", "ratio"))).alias("_terms"))
    held = texts.join(small(scratch.save(per_doc, "doc-terms")), "_key")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}])(?:"), F.array_join(F.transform("_terms", lambda t: t["term"]), "|"), F.lit(r")(?![\p{L}])"))
    ratio = lambda v: F.element_at(F.filter("_terms", lambda t: t["term"] == F.lower(v)), 1)["ratio"]
    more = F.transform(matches(F.col("_text"), pattern, 4), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.coalesce(ratio(x["v"]), F.lit(GENERALISE)).cast("string").alias("v"), F.lit("").alias("c")))
    terms = scratch.save(held.select("_key", more.cast(f"array<{SPAN}>").alias("_more")).dropDuplicates(["_key"]), "term-spans")
    out = found.join(small(terms), "_key", "left")
    clear = lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return out.withColumn("_spans", F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.concat("_base", F.filter("_more", clear)))).drop("_key", "_more")


def sanitised(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets, and removed terms left out. Spans that overlap become one, of the first's kind."""
    piece = "struct<k:int,s:bigint,e:bigint,v:string>"
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"))))

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))
        wider = F.struct(last["k"].alias("k"), last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["v"].alias("v"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["e"] <= x["s"])
        return F.when(apart, F.concat(done, F.array(new)).cast(f"array<{piece}>")).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider)).cast(f"array<{piece}>"))

    def rebuild(parts: Column) -> Column:
        names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
        mark = lambda x: F.when((x["k"] == KINDS.index("term")) & (x["v"].try_cast("double") >= REMOVE), F.lit("")).otherwise(F.get(names, x["k"]))
        before = lambda i: F.coalesce(F.get(parts, i - 1)["e"], F.lit(0).cast("bigint"))
        kept = F.transform(parts, lambda x, i: F.concat(F.substring(text, (before(i) + 1).cast("int"), (x["s"] - before(i)).cast("int")), mark(x)))
        tail = F.substring(text, (F.element_at(parts, -1)["e"] + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(kept, ""), tail)

    merged = F.aggregate(by_place, F.array().cast(f"array<{piece}>"), merge)
    return F.when(F.size(spans) == 0, text).otherwise(let(merged, rebuild))


def clean(docs: DataFrame) -> DataFrame:
    """docs with text sanitised; other columns as they are, whatever their names.

    A null text stays null, one without spans stays as it is, and rows equal in doc_id and text get the same text. Of
    spans that overlap, the one that starts first gives the kind, at equal starts the first of KINDS. An empty table gives
    no row.
    """
    key = (F.col("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text", *key)
    # Spans, without texts, of the documents that have any; rows equal in doc_id and text have the same.
    found = spanned(held, ("_d", "_t")).filter(F.size("_spans") > 0).dropDuplicates(["_d", "_t"]).select(F.col("_d").alias("_d2"), F.col("_t").alias("_t2"), "_spans")
    saved = scratch.save(found, "all-spans")
    out = held.join(small(saved), F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2")), "left")
    clean_text = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(sanitised(F.col("_row.text"), F.col("_spans")))
    return out.select(*((clean_text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
