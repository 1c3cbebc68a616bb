"""Line dedup by a log-template tree.

A line's words with a digit are variable fields and become one wildcard. A leaf of the tree is a number of words and the
first DEPTH words, at any size of leaf. In a leaf lines are taken in order of their hash: a line joins the first template
whose first line has the same word at SIMILAR of all places at least, or begins a template of its own. So every line is
held against one real line, not against what earlier joins have left of it. A template that occurs in two documents or
more is recurring: its first place in order of doc_id stays, its others are dropped.

A leaf of more than HEAD lines is settled in rounds with the same result: the first lines of the leaf, a bounded number,
find their templates in every task that has a part of the leaf; the part's lines join these or go to the next round.

Lines under MIN_WORDS words, and lines whose words all but MIN_FIXED are variable, are weak: they recur by chance too. They
join only lines equal to them with the variable words masked, or verbatim if all are variable, and are recurring when
WEAK_DOCS documents hold them and a share of all, WEAK_SHARE for a fixed word and a third of that for each more.
Words are compared by 64-bit hashes, which are made again from the lines that share a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .exact_dedup import HOT_SHARE, small
from .lookup import lookup
from .quality_rules import let
from .tokens import slices
from .words import Words, mix

MIN_WORDS = 5
MIN_FIXED = 4
WEAK_DOCS, WEAK_SHARE = 10, 0.01
DEPTH = 3
#: Templates in a leaf from which on a line is compared only with those that share a block of places; the result is the same.
COMPARED = 64
#: Lines of a leaf that are settled first, at most in a round, and that a task has besides; the result is the same.
HEAD, MAX_HEAD, PART_LINES = 512, 1 << 16, 4096
#: Places of all that must be equal, in tenths.
SIMILAR = 8
WILD = np.uint64(0x57494C44)


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows of doc_id, th (the text's hash), pos, line (hash of the masked words), leaf and weak (the number of fixed words of a weak line, -1 of others) of every line with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                w = Words(batch["text"].slice(a, b - a), lines=True)
                if not len(w.hashes):
                    continue
                first = np.flatnonzero(np.diff(w.lines, prepend=-1))
                count = np.diff(np.append(first, len(w.hashes)))
                fixed = np.add.reduceat((~w.numeric).astype(np.int64), first)
                words = np.where(w.numeric & np.repeat(fixed > 0, count), WILD, w.hashes)
                place = np.arange(len(words)) - np.repeat(first, count)
                placed = mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                line = mix(np.add.reduceat(placed, first) + count.astype(np.uint64))
                leaf = mix(np.add.reduceat(np.where(place < DEPTH, placed, np.uint64(0)), first) ^ (count.astype(np.uint64) << np.uint64(32)))
                weak = np.where((count >= MIN_WORDS) & (fixed >= MIN_FIXED), -1, fixed)
                row = np.repeat(np.arange(b - a), np.diff(w.rows))[first]
                pos = w.lines[first] - w.row_lines[row]
                of_row = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(of_row), batch["th"].take(of_row), pa.array(pos.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (line, leaf)), pa.array(weak.astype(np.int32))],
                    names=["doc_id", "th", "pos", "line", "leaf", "weak"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(scratch.trimmed(run), "doc_id long, th long, pos int, line long, leaf long, weak int")


class Leaf:
    """The templates of one leaf, of lines of n words, each by its first line."""

    def __init__(self, n: int):
        self.needed = -(-SIMILAR * n // 10)
        # Lines that are alike differ in n - needed places at most, so of one block more one is equal in both.
        self.blocks = np.array_split(np.arange(DEPTH, n), n - self.needed + 1)
        self.firsts, self.names = np.empty((1, n), np.uint64), []
        self.index, self.entered = {}, 0

    def keys(self, words: np.ndarray) -> list[tuple[int, bytes]]:
        return [(j, words[block].tobytes()) for j, block in enumerate(self.blocks)]

    def find(self, words: np.ndarray) -> int | None:
        """Name of the first template that a line is alike, if any."""
        size = len(self.names)
        if size <= COMPARED:
            near = np.arange(size)
        else:
            self._enter()
            near = np.array(sorted({k for key in self.keys(words) for k in self.index.get(key, ())}), np.int64)
        alike = near[(self.firsts[near] == words).sum(axis=1) >= self.needed]
        return self.names[alike[0]] if len(alike) else None

    def _enter(self) -> None:
        """All templates into the index of blocks."""
        for k in range(self.entered, len(self.names)):
            for key in self.keys(self.firsts[k]):
                self.index.setdefault(key, []).append(k)
        self.entered = len(self.names)

    def join(self, name: int, words: np.ndarray) -> int:
        """Name of the template that a line joins, its own if it begins one."""
        known = self.find(words)
        if known is not None:
            return known
        if len(self.names) == len(self.firsts):
            self.firsts = np.concatenate([self.firsts, np.empty_like(self.firsts)])
        self.firsts[len(self.names)] = words
        self.names.append(name)
        return name


def masked(texts: pa.Array) -> Iterator[np.ndarray]:
    """The words of each line, those with a digit as the wildcard."""
    w = Words(texts, lines=True)
    words = np.where(w.numeric, WILD, w.hashes)
    for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        yield words[a:b]


def taken(shared: DataFrame, docs: DataFrame) -> DataFrame:
    """leaf, line and text of shared's lines (leaf, line, first: the place where it stands first)."""
    # One document's lines make an array of its own size.
    wanted = shared.groupBy(F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t"))
    wanted = wanted.agg(F.collect_list(F.struct("leaf", "line", "first.pos")).alias("_wanted"))
    held = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    at = lambda lines, x: F.struct(x["leaf"].alias("leaf"), x["line"].alias("line"), F.get(lines, x["pos"]).alias("text"))
    every = let(F.split("text", "\n"), lambda lines: F.transform("_wanted", lambda x: at(lines, x)))
    return held.select(F.explode(every).alias("x")).select("x.*")


def merged(rows: DataFrame) -> DataFrame:
    """line and template of rows (leaf, line, text) that join a line before them, in leaves of at most HEAD lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, last, tree = None, None, None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            leaves, lines = batch["leaf"].to_pylist(), batch["line"].to_pylist()
            for a, b in slices(batch["text"]):
                for i, words in enumerate(masked(batch["text"].slice(a, b - a)), a):
                    if (leaves[i], lines[i]) == (leaf, last):
                        continue  # of an equal row
                    if leaves[i] != leaf:
                        leaf, tree = leaves[i], Leaf(len(words))
                    last = lines[i]
                    name = tree.join(last, words)
                    if name != last:
                        out[0].append(last)
                        out[1].append(name)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["line", "template"])

    ordered = rows.repartition("leaf").sortWithinPartitions("leaf", "line")
    return ordered.mapInArrow(scratch.trimmed(run), "line long, template long")


def settled(rows: DataFrame) -> DataFrame:
    """The same for leaves of any size, whose lines are dealt to many tasks."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.tobytes() for a, b in slices(batch["text"]) for w in masked(batch["text"].slice(a, b - a))]
            columns = [batch["leaf"], batch["line"], pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "line", "words"])

    def settle(part: pa.Table, head: pa.Table) -> pa.Table:
        head = head.sort_by("name")
        firsts = [np.frombuffer(x, np.uint64) for x in head["first"].to_pylist()]
        tree = Leaf(len(firsts[0]))
        own = {name: tree.join(name, words) for name, words in zip(head["name"].to_pylist(), firsts, strict=True)}
        lines, words = part["line"].to_pylist(), part["words"].to_pylist()
        found = [own[x] if x in own else tree.find(np.frombuffer(w, np.uint64)) for x, w in zip(lines, words, strict=True)]
        left = [w if t is None else None for t, w in zip(found, words, strict=True)]
        return pa.table({"leaf": part["leaf"], "line": part["line"], "template": pa.array(found, pa.int64()), "words": pa.array(left, pa.binary())})

    left = scratch.save(rows.mapInArrow(scratch.trimmed(hashes), "leaf long, line long, words binary").dropDuplicates(["leaf", "line"]), "crowded")
    head, rounds, unused = HEAD, [], [left]
    while True:
        counts = left.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("low"))
        # Hashes lie evenly, so about head lines of a leaf are below this bound.
        low = F.col("low").cast("double")
        bound = F.greatest("low", (low + (2.0**63 - low) * head / F.col("n")).cast("long"))
        bound = F.when(F.col("n") > head, bound).otherwise(F.lit((1 << 63) - 1))
        parts = F.ceil(F.col("n") / max(PART_LINES, 4 * head))
        counts = scratch.save(counts.select("leaf", "n", bound.alias("bound"), parts.alias("parts")), "crowded-leaves")
        unused.append(counts)
        if counts.isEmpty():
            break
        dealt = lookup(left, counts, "leaf", "n")
        mine = dealt.withColumn("part", F.pmod(F.xxhash64("line"), "parts")).select("leaf", "part", "line", "words")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        first = dealt.filter(F.col("line") <= F.col("bound"))
        first = first.select(F.col("leaf").alias("of_leaf"), copies.alias("of_part"), F.col("line").alias("name"), F.col("words").alias("first"))
        both = mine.groupBy("leaf", "part").cogroup(first.groupBy("of_leaf", "of_part"))
        done = both.applyInArrow(settle, "leaf long, line long, template long, words binary")
        done = scratch.save(done, "crowded")
        unused.append(done)
        rounds.append(done.filter(F.col("template") != F.col("line")).select("line", "template"))
        left = done.filter("template is null").select("leaf", "line", "words")
        head = min(4 * head, MAX_HEAD)
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    out = scratch.save(every, "settled")
    scratch.drop(*unused)
    return out


def frequent(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """line and weak of weak lines that enough documents hold."""
    n_docs = lines.select("doc_id", "th").distinct().count()
    needed = F.greatest(F.lit(float(WEAK_DOCS)), WEAK_SHARE * n_docs / F.pow(F.lit(3.0), F.greatest(F.col("weak"), F.lit(1)) - 1))
    likely = scratch.save(distinct.filter((F.col("weak") >= 0) & (F.col("n") >= needed)).select("line", "weak"), "likely")
    # A line may stand in a document more than once.
    held = lines.filter("weak >= 0").join(small(likely), ["line", "weak"]).select("line", "weak", "doc_id", "th").distinct()
    return held.groupBy("line", "weak").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= needed).select("line", "weak")


def drops(docs: DataFrame) -> DataFrame:
    """doc_id, th and drop, the numbers of the lines to drop, of documents that have any. docs: doc_id, th, text."""
    lines = scratch.save(lines_of(docs), "lines", texts=True)
    place = F.struct("doc_id", "th", "pos")
    distinct = lines.groupBy("leaf", "line", "weak").agg(F.min(place).alias("first"), F.max(F.struct("doc_id", "th")).alias("last"), F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(distinct, "distinct-lines")
    leaves = distinct.filter("weak < 0").groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1")
    leaves = scratch.save(leaves.withColumn("in_leaf", F.col("lines")), "leaves")
    shared = lookup(distinct.filter("weak < 0").select("leaf", "line", "first"), leaves, "leaf", "lines")
    same = scratch.save(merged(taken(shared.filter(F.col("in_leaf").between(2, HEAD)), docs)), "templates")
    crowded = []
    if not leaves.filter(F.col("in_leaf") > HEAD).isEmpty():
        crowded.append(settled(taken(shared.filter(F.col("in_leaf") > HEAD), docs)))
    # The first line of a template stands for itself.
    often = scratch.save(frequent(lines, distinct), "frequent")
    judged = distinct.filter("weak < 0").unionByName(distinct.filter("weak >= 0").join(small(often), ["line", "weak"], "left_semi").select(*distinct.columns))
    joined = same.unionByName(crowded[0]) if crowded else same
    named = judged.select("line", "first", "last", "n").join(joined, "line", "left").withColumn("template", F.coalesce("template", "line"))
    recurring = named.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    recurring = recurring.filter(~(F.col("last.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("last.th") == F.col("first.th"))))
    of_line = scratch.save(named.select("line", "template", F.col("n").alias("line_n")).join(recurring.select("template", "first"), "template").select("line", "line_n", "first"), "recurring")
    scratch.drop(distinct, leaves, same, often, *crowded)
    total = of_line.agg(F.coalesce(F.sum("line_n"), F.lit(0))).first()[0]
    hot, rest = (of_line.filter(x).select("line", "first") for x in (F.col("line_n") > total / HOT_SHARE, F.col("line_n") <= total / HOT_SHARE))
    slim = lines.select("doc_id", "th", "pos", "line")
    hit = slim.join(F.broadcast(hot), "line")  # fewer than HOT_SHARE rows
    hits = hit.unionByName(slim.join(F.broadcast(hot), "line", "left_anti").join(rest, "line"))
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("first.pos") == F.col("pos"))
    # One document's lines make an array of its own size.
    out = scratch.save(hits.filter(~stays).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop")), "drops")
    scratch.drop(lines, of_line)
    return out


def dedupe(docs: DataFrame, drop_empty: bool = True) -> DataFrame:
    """docs (doc_id, text and any more) without the lines of recurring templates but the first, with n_lines and n_dropped.

    Rows equal in doc_id and text count as one document and are treated alike. A null text has no line and stays null;
    blank lines stay. A document whose lines with words have all been dropped is left out, unless drop_empty is False. Of
    places that tie by doc_id the one of the least text hash comes first, then that of the least line number. Columns of
    docs named n_lines or n_dropped are replaced; others keep their values. An empty table gives no row.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    found = drops(held.select("doc_id", "th", F.coalesce("text", F.lit("")).alias("text"))).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    out = held.drop("text").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    lines = F.split(F.col("_row.text"), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    out = out.withColumn("_text", F.when(F.col("drop").isNull(), F.col("_row.text")).otherwise(kept))
    if drop_empty:
        out = out.filter(F.col("drop").isNull() | F.rlike("_text", F.lit(r"[^\x20\x09-\x0D]")))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return out.select(*((F.col("_text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in names), F.greatest(n_lines, F.lit(0)).alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"))
