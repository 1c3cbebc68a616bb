"""Quality rules by weak supervision: rules vote good or bad or abstain, and expectation-maximisation weighs them.

The corpus is reduced to the counts of vote patterns, of which there are at most 3 to the number of rules at any size.
A fold over that array runs expectation-maximisation for two classes (each rule has its own rates of good and bad
votes in either class), and a document is kept when its posterior probability of being good reaches the threshold.
All of it is SQL expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ITERATIONS = 30
THRESHOLD = 0.5
#: Pseudo-documents with which a rule's rates start, and which keep rules without votes in place.
PRIOR_DOCS = 10.0
PRIOR_GOOD = 0.85
#: A vote is at least so many times as likely in the class that it names as in the other, so the classes can't change places.
MARGIN = 4.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def occurrences(text: Column, chars: str) -> Column:
    """How many of text's bytes are one of chars (ASCII), in one pass over text."""
    one_of = "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]+"
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, one_of, ""))).cast("long")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def repeated(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more, the first included. Windows are compared by a 64-bit hash."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        return F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)))

    def from_windows(windows: Column) -> Column:
        places = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)
        count = let(F.sort_array(F.transform(places, lambda x: x["i"])), covered)
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(F.lit(0).cast("long"))

    def from_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))), from_windows)

    enough = F.size(words) > WINDOW
    return F.when(enough, let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)).otherwise(F.lit(0).cast("long"))


def lines_twice(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def features(df: DataFrame) -> DataFrame:
    """df with its features in a struct column _f. A null text has no words."""
    text = F.coalesce("text", F.lit(""))
    with_words = df.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    w = F.col("_words")
    return with_words.withColumn(
        "_f",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.char_length("_text") - occurrences(F.col("_text"), SPACE)).cast("long").alias("word_chars"),
            occurrences(F.col("_text"), SYMBOLS).alias("n_symbols"),
            lines_twice(F.col("_text")).alias("n_dup_lines"),
            repeated(w).alias("n_repeat_words"),
            occurrences(F.col("_text"), "!").alias("n_shouts"),
            F.size(F.filter(w, lambda x: (F.char_length(x) <= 3) & (F.lower(x) != F.upper(x)))).cast("long").alias("n_short"),
            F.size(F.filter(w, lambda x: (F.char_length(x) >= 3) & (F.upper(x) == x) & (F.lower(x) != x))).cast("long").alias("n_upper"),
        ),
    ).drop("_text", "_words")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def rules(f: Column) -> list[tuple[str, Column, Column]]:
    """Name, when the rule votes good, when it votes bad; otherwise it abstains.

    Passing one test says little, so most rules vote bad or abstain; only the look of ordinary prose votes good.
    """
    share = lambda name: f[name] / F.greatest(f["n_words"], F.lit(1))
    never = F.lit(False)
    prose = (share("n_symbols") < 0.02) & (share("n_shouts") < 0.02) & (share("n_upper") < 0.1) & (share("n_short") > 0.15)
    return [
        ("prose", prose & share("word_chars").between(3, 9), never),
        ("short", f["n_words"] >= 100, f["n_words"] < 20),
        ("word length", never, ~share("word_chars").between(2, 12)),
        ("symbols", never, share("n_symbols") > 0.1),
        ("repeated lines", never, f["n_dup_lines"] > 5),
        ("repeated words", never, share("n_repeat_words") > 0.3),
        ("shouting", never, share("n_shouts") > 0.15),
        ("short words", never, share("n_short") < 0.08),
        ("capitals", never, share("n_upper") > 0.3),
    ]


def voted(df: DataFrame) -> DataFrame:
    """df with _f and _votes, all rules' votes as digits to base 3: 0 bad, 1 abstained, 2 good."""
    df = features(df)
    code = F.lit(0)
    for k, (_, good, bad) in enumerate(rules(F.col("_f"))):
        code = code + F.when(bad, 0).when(good, 2).otherwise(1) * 3**k
    return df.withColumn("_votes", code.cast("int"))


def posteriors(votes: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """Per vote pattern p_good. votes: _votes of every document.

    The patterns go into one array of at most 3 ** n_rules entries. A rule's rates in a class are those of its voting
    good and bad; an abstention says nothing, and MARGIN ties the classes to their names.
    """
    patterns = votes.groupBy("_votes").agg(F.count(F.lit(1)).alias("n"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: F.floor(F.col("_votes") / F.pow(F.lit(3.0), j)).cast("int") % 3 - 1)
    every = patterns.select(F.struct(F.col("_votes").alias("code"), digits.alias("v"), F.col("n").cast("double").alias("n")).alias("p")).agg(F.collect_list("p").alias("ps"))
    rate = "struct<gg:double,gb:double,bg:double,bb:double>"
    first = F.struct(F.lit(PRIOR_GOOD).alias("prior"), F.array_repeat(F.struct(F.lit(0.7).alias("gg"), F.lit(0.3).alias("gb"), F.lit(0.05).alias("bg"), F.lit(0.5).alias("bb")), n_rules).cast(f"array<{rate}>").alias("rates"))

    def p_good(p: Column, s: Column) -> Column:
        say = F.zip_with(p["v"], s["rates"], lambda v, r: F.when(v == 1, F.log(r["gg"] / r["gb"])).when(v == -1, F.log(r["bg"] / r["bb"])).otherwise(F.lit(0.0)))
        odds = F.aggregate(say, F.log(s["prior"] / (1 - s["prior"])), lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))

    def total(weighed: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(weighed, F.lit(0.0), lambda a, x: a + of(x))

    def maximise(weighed: Column) -> Column:
        good, bad = total(weighed, lambda x: x["n"] * x["q"]), total(weighed, lambda x: x["n"] * (1 - x["q"]))

        def of_rule(j: Column) -> Column:
            votes_of = lambda v, q: total(weighed, lambda x: F.when(F.get(x["v"], j) == v, x["n"] * q(x)).otherwise(F.lit(0.0)))
            smooth = lambda n, all_, start: F.least(F.lit(0.98), F.greatest(F.lit(0.001), (n + PRIOR_DOCS * start) / (all_ + PRIOR_DOCS)))
            is_good, is_bad = (lambda x: x["q"]), (lambda x: 1 - x["q"])
            made = F.struct(
                smooth(votes_of(1, is_good), good, 0.7).alias("gg"), smooth(votes_of(1, is_bad), bad, 0.3).alias("gb"), smooth(votes_of(-1, is_good), good, 0.05).alias("bg"), smooth(votes_of(-1, is_bad), bad, 0.5).alias("bb")
            )
            return let(made, lambda r: F.struct(r["gg"].alias("gg"), F.least(r["gb"], r["gg"] / MARGIN).alias("gb"), F.least(r["bg"], r["bb"] / MARGIN).alias("bg"), r["bb"].alias("bb")))

        prior = F.greatest(F.lit(0.5), F.least(F.lit(0.99), (good + PRIOR_DOCS * PRIOR_GOOD) / (good + bad + PRIOR_DOCS)))
        return F.struct(prior.alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), of_rule).cast(f"array<{rate}>").alias("rates"))

    def turn(s: Column, _: Column) -> Column:
        weighed = F.transform(F.col("ps"), lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), p_good(p, s).alias("q")))
        return let(weighed, maximise)

    kind = f"struct<prior:double,rates:array<{rate}>>"
    fitted = every.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), first.cast(kind), turn))
    return fitted.select("s", F.explode("ps").alias("p")).select(F.col("p.code").alias("_votes"), p_good(F.col("p"), F.col("s")).alias("p_good"))


def judged(df: DataFrame, *without: str) -> DataFrame:
    """df with the features in _f, p_good, base_failed and kept, but for the columns named in without.

    df is read once and what is asked for is written to a scratch table. Columns of df with one of these four names, or
    named _votes, are replaced. A null or blank text fails the base. Repeated rows each count. An empty table gives no row.
    """
    rows = scratch.save(voted(df).drop(*without), "votes")
    found = scratch.save(posteriors(rows.select("_votes"), len(rules(F.col("_f")))), "posteriors")
    failed = base_failed(F.col("_f"))
    out = rows.join(F.broadcast(found), "_votes")  # at most 3 ** rules rows
    return out.drop("_votes").withColumns({"base_failed": failed, "kept": ~failed & (F.col("p_good") >= THRESHOLD)})


def keep(df: DataFrame) -> DataFrame:
    """The rows of df that are kept, with df's columns, whatever their names.

    A null or blank text fails the base and goes. Equal rows are judged alike. An empty table gives no row. Features are
    taken once: votes and rows, but for those that fail the base, wait in a scratch table for the posteriors.
    """
    rows = voted(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), "text"))
    rows = scratch.save(rows.select("_votes", F.when(~base_failed(F.col("_f")), F.col("_row")).alias("_row")), "voted")
    found = scratch.save(posteriors(rows.select("_votes"), len(rules(F.col("_f")))), "posteriors")
    good = found.filter(F.col("p_good") >= THRESHOLD).select("_votes")
    # At most 3 ** rules rows are broadcast.
    return rows.filter("_row is not null").join(F.broadcast(good), "_votes", "left_semi").select("_row.*")
