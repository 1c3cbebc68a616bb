"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are word shingles, ordered by document frequency, rare ones first. A document of n tokens can lack at most
m = n - ceil(t n) of them in any partner. Its prefix is extended until tokens that are unique or rare (each a signature)
and combinations of two frequent tokens (a group of g of them survives the loss of g - 1) outnumber m. The partner whose
prefix ends first keeps one signature at least, and the other document, whose prefix reaches further, has it too.
Frequent tokens are dealt to groups by hash, so that a long document has few combinations.

Frequencies are counted over all documents, but on the tokens of the low part of the hash range only: a part so large
that m losses can't empty it. Documents for which chance made it too small are joined in a second index over all tokens,
by a rule that no linked pair can slip through. Blocks of documents send each token once, with its count, and get back
only what is shared.

Equal sets are one class from the start. In a bucket of equal signatures all members are first compared with the member
that has the fewest unique tokens; then only pairs that are still in different components are compared, after a bitmap
has shown that they can be similar. Links are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .exact_dedup import HOT_SHARE, small
from .lookup import lookup
from .tokens import slices
from .words import Words, mix

#: Documents with which a token is rare: their number in a bucket.
RARE = 16
#: Tokens of a block of documents, and of a bucket of tokens, held in a task at once.
BLOCK_TOKENS, BUCKET_TOKENS = 250_000, 1 << 20
#: Texts compared with one hub in a task.
HUB_TEXTS = 256
#: Bytes of a token in the indexes. Tokens that become equal by it only add candidates; use 6 beyond about 10 TB.
WIDTH = 5
BITS = 8  # words of 64 bits in a document's bitmap
#: Members of a bucket that are compared with each other at once.
BUCKET_ROWS = 256


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes; of a text with fewer words, all of them as one."""
    w = Words(texts, lower=True)
    h, n = w.hashes, len(w.hashes)
    joined = np.zeros(max(0, n - shingle + 1), np.uint64)
    for k in range(shingle):
        joined = mix(joined + h[k : n - shingle + 1 + k])
    for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(joined[a : b - shingle + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = mix(whole + x)
            yield whole
        else:
            yield joined[:0]


def narrow(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def widen(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(content, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


class Rule:
    """What the threshold num / den implies."""

    def __init__(self, num: int, den: int, rare: int = RARE):
        self.num, self.den, self.rare = num, den, rare
        t = num / den
        self.slack = ((1 - t) + 1 / 32) / t + (1 - t)
        self.share = min(1.0, 1.35 * self.slack)
        self.limit = int(self.share * (1 << 64)) if self.share < 1 else (1 << 64) - 1

    def losses(self, n: int) -> int:
        return (self.den - self.num) * n // self.den

    def classes(self, n: int) -> list[int]:
        """Length classes in which a document's combinations are indexed; linked documents share one."""
        c = n.bit_length() - 1
        return [c, c + 1] if n * self.den >= self.num << (c + 1) else [c]

    def groups(self, c: int) -> int:
        return max(1, (1 << c) // 64)

    def in_low(self, n: int, low: int) -> bool:
        """Whether low tokens in the low part are enough for a prefix."""
        return low >= self.losses(n) + 1 + self.groups(self.classes(n)[-1])

    def in_all(self, n: int, low: int) -> bool:
        """Whether the document, or one that it may be linked with, has too few in the low part."""
        return self.share < 1 and low <= self.slack * n + 3


def token_sets(docs: DataFrame, shingle: int, rule: Rule) -> DataFrame:
    """doc_id, th, n, sig (of the set), low and whole (tokens for the two indexes) and bits, a bitmap of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                n, sig, low, whole, bits = [], [], [], [], []
                for u in shingle_sets(batch["text"].slice(a, b - a), shingle):
                    k = int(np.searchsorted(u, np.uint64(rule.limit), "right"))
                    n.append(len(u))
                    sig.append(np.array([u.sum(dtype=np.uint64), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], "<u8").tobytes())
                    low.append(narrow(u[:k] >> np.uint64(64 - 8 * WIDTH)) if len(u) > 1 and rule.in_low(len(u), k) else b"")
                    whole.append(narrow(u >> np.uint64(64 - 8 * WIDTH)) if len(u) > 1 and rule.in_all(len(u), k) else b"")
                    odd = np.bincount((u & np.uint64(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
                    bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(a, b - a), "th": batch["th"].slice(a, b - a), "n": pa.array(n, pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in (("sig", sig), ("low", low), ("whole", whole), ("bits", bits))}})

    return docs.select("doc_id", "th", "text").mapInArrow(scratch.trimmed(run), "doc_id long, th long, n long, sig binary, low binary, whole binary, bits binary")


def blocks(reps: DataFrame) -> DataFrame:
    """Rows of block and its documents' entries: rep, n, kind (0 low, 1 whole), size, tokens, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            rep, n, kind, tokens, bits = zip(*held, strict=True)
            columns = {"rep": np.array(rep, "<i8").tobytes(), "n": np.array(n, "<i8").tobytes(), "kind": bytes(kind), "size": np.array([len(t) // WIDTH for t in tokens], "<i8").tobytes(), "tokens": b"".join(tokens), "bits": b"".join(bits)}
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in columns.values())], names=["block", *columns])

        for batch in batches:
            for rep, n, low, whole, bits in zip(*(batch[c].to_pylist() for c in ("rep", "n", "low", "whole", "bits")), strict=True):
                for kind, tokens in ((0, low), (1, whole)):
                    if tokens:
                        held.append((rep, n, kind, tokens, bits))
                        size += len(tokens) // WIDTH
                if size >= BLOCK_TOKENS:
                    yield out()
                    block, held, size = block + 1, [], 0
        if held:
            yield out()

    return reps.select("rep", "n", "low", "whole", "bits").mapInArrow(scratch.trimmed(run), "block long, rep binary, n binary, kind binary, size binary, tokens binary, bits binary")


def indexed(tokens: bytes, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of a block's entries, apart by index and spread evenly."""
    return mix(widen(tokens) + np.repeat(kind.astype(np.uint64), size) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8 * WIDTH)


def shared(held: DataFrame, buckets: int) -> DataFrame:
    """block, tokens and df of those tokens of each block that two documents or more have. buckets: a power of two.

    A block's count of a token stops at 255; df orders the tokens and is the same for all documents, which is all that
    the join asks of it.
    """
    shift = np.uint64(8 * WIDTH - buckets.bit_length() + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, kind, size, tokens in zip(*(batch[c].to_pylist() for c in ("block", "kind", "size", "tokens")), strict=True):
                t, count = np.unique(indexed(tokens, np.frombuffer(kind, np.uint8), np.frombuffer(size, "<i8")), return_counts=True)
                edges = np.searchsorted(t >> shift, np.arange(buckets + 1, dtype=np.uint64)).tolist()
                rows = [(k, edges[k], edges[k + 1]) for k in range(buckets) if edges[k] < edges[k + 1]]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "tokens": pa.array([narrow(t[a:b]) for _, a, b in rows], pa.binary()), "counts": pa.array([np.minimum(count[a:b], 255).astype("<u1").tobytes() for _, a, b in rows], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        tokens = [widen(x) for x in table["tokens"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u1") for x in table["counts"].to_pylist()])
        every, place = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(place, counts, len(every)).astype(np.int64)[place]
        ends = np.cumsum([len(x) for x in tokens])
        out: tuple[list, list, list] = ([], [], [])
        for block, t, end in zip(table["block"].to_pylist(), tokens, ends.tolist(), strict=True):
            d = df[end - len(t) : end]
            for values, value in zip(out, (block, narrow(t[d > 1]), d[d > 1].astype("<i8").tobytes()), strict=True):
                values.append(value)
        return pa.table({"block": pa.array(out[0], pa.int64()), "tokens": pa.array(out[1], pa.binary()), "df": pa.array(out[2], pa.binary())})

    sent = held.select("block", "kind", "size", "tokens").mapInArrow(scratch.trimmed(send), "bucket long, block long, tokens binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(count, "block long, tokens binary, df binary")


def combinations(tokens: np.ndarray, df: np.ndarray, need: int, n: int, rule: Rule) -> list[int]:
    """Signatures from a document's shared tokens when need of them must outlast the losses."""
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    rare = int(np.searchsorted(df, rule.rare, "right"))
    out = mix(tokens[: min(rare, need)] + np.uint64(1)).tolist()
    need -= len(out)
    if need <= 0:
        return out
    often = tokens[rare:]
    for c in rule.classes(n):
        group = mix(often + np.uint64(c)) % np.uint64(rule.groups(c))
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        lasts = np.flatnonzero(np.cumsum(~first) >= need)
        end = int(lasts[0]) + 1 if len(lasts) else len(often)
        for g in np.unique(group[:end]):
            members = np.sort(often[:end][group[:end] == g])
            i, j = np.triu_indices(len(members), 1)
            out += mix(mix(members[i] + np.uint64(2 + c)) + members[j]).tolist()
    return out


def signatures(held: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """Rows of key (a signature), rep, n, score (unique tokens in a thousand) and bits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("key", "rep", "n", "score", "bits")}
        for row in left.to_pylist():
            rep, n, size = (np.frombuffer(row[c], "<i8") for c in ("rep", "n", "size"))
            tokens = indexed(row["tokens"], np.frombuffer(row["kind"], np.uint8), size)
            known = np.concatenate([widen(x) for x in right["tokens"].to_pylist()] or [np.zeros(0, np.uint64)])
            df = np.concatenate([np.frombuffer(x, "<i8") for x in right["df"].to_pylist()] or [np.zeros(0, np.int64)])
            order = np.argsort(known)
            known, df = np.append(known[order], np.uint64((1 << 64) - 1)), np.append(df[order], 0)
            at = np.searchsorted(known, tokens)
            common = known[at] == tokens
            ends = np.cumsum(size)
            seen = np.concatenate([[0], np.cumsum(common)])
            alone = size - (seen[ends] - seen[ends - size])
            for k in np.flatnonzero(alone <= (rule.den - rule.num) * n // rule.den):
                z = slice(ends[k] - size[k], ends[k])
                mine = common[z]
                keys = combinations(tokens[z][mine], df[at[z]][mine], int(rule.losses(int(n[k])) + 1 - alone[k]), int(n[k]), rule)
                bits = row["bits"][8 * BITS * k : 8 * BITS * (k + 1)]
                for name, value in (("rep", int(rep[k])), ("n", int(n[k])), ("score", int(1000 * alone[k] // n[k])), ("bits", bits)):
                    out[name] += [value] * len(keys)
                out["key"] += keys
        return pa.table({"key": pa.array(np.array(out["key"], np.uint64).view(np.int64)), "rep": pa.array(out["rep"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "score": pa.array(out["score"], pa.int64()), "bits": pa.array(out["bits"], pa.binary())})

    return held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "key long, rep long, n long, score long, bits binary")


def _words(bits: Column) -> list[Column]:
    """A bitmap as columns of 64 bits."""
    return [F.conv(F.hex(F.substring(bits, 8 * k + 1, 8)), 16, -10).cast("long").alias(f"w{k}") for k in range(BITS)]


def may_link(rule: Rule, a: str, b: str) -> Column:
    """Whether two rows of buckets can be linked, by their sizes and bitmaps."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}"))) for k in range(BITS)), F.lit(0))
    return (rule.den * F.least(n, m) >= rule.num * F.greatest(n, m)) & (apart * (rule.den + rule.num) <= (rule.den - rule.num) * (n + m))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets, as a saved table. docs: doc_id, th, text."""
    pairs = scratch.save(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    ids = scratch.save(ids.join(reps.select("rep", "th"), "rep").withColumnRenamed("rep", "doc_id"), "pair-ids")
    texts = scratch.save(docs.join(small(ids), ["doc_id", "th"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "pair-texts")
    # A hub's texts are dealt to parts, each with a copy of the hub's own.
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_TEXTS).alias("parts"))
    left = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b").join(texts.withColumnsRenamed({"doc_id": "b", "text": "text"}), "b")
    right = parts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("hub_part")).join(texts.withColumnRenamed("doc_id", "hub"), "hub")

    def run(mine: pa.Table, hub: pa.Table) -> pa.Table:
        whole = next(shingle_sets(hub["text"].combine_chunks().slice(0, 1), shingle))
        linked = []
        texts = mine["text"].combine_chunks()
        for at, end in slices(texts):
            for one in shingle_sets(texts.slice(at, end - at), shingle):
                common = len(np.intersect1d(whole, one, assume_unique=True))
                linked.append(rule.den * common >= rule.num * (len(whole) + len(one) - common))
        return mine.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    out = scratch.save(left.groupBy("a", "part").cogroup(right.groupBy("hub", "hub_part")).applyInArrow(run, "a long, b long"), "links")
    scratch.drop(pairs, ids, texts)
    return out


def across(of: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of members of one bucket that have different labels and may be linked. of: saved rows of signatures with label.

    A bucket's members of its most frequent label, as near copies have, aren't paired with each other. Small buckets are
    joined; the members of a large one are dealt to blocks, and each pair of blocks is compared in a task.
    """
    words = [f"w{k}" for k in range(BITS)]
    of_label = of.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = of_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels"))
    mixed = mixed.filter("labels > 1").select("key", "size", F.col("top.label").alias("major"), F.col("top.n").alias("n_major"))
    mixed = scratch.save(mixed, "mixed")
    rows = lookup(of, mixed.withColumn("_w", F.col("size")), "key", "_w").filter("size is not null")
    left = rows.filter(F.col("size") <= BUCKET_ROWS)
    right = left.select("key", *(F.col(c).alias(f"o_{c}") for c in ("rep", "n", "label", *words)))
    apart = (F.col("rep") < F.col("o_rep")) & (F.col("label") != F.col("o_label"))
    near = left.join(right, "key").filter(apart & may_link(rule, "", "o_")).select(F.col("rep").alias("a"), F.col("o_rep").alias("b"))
    if mixed.filter(F.col("size") > BUCKET_ROWS).isEmpty():
        return near
    # Blocks 0 to others - 1 hold the other labels' members, those from there on the most frequent label's.
    large = rows.filter(F.col("size") > BUCKET_ROWS).withColumn("_major", F.col("label") == F.col("major"))
    others, majors = F.ceil((F.col("size") - F.col("n_major")) / BUCKET_ROWS), F.ceil(F.col("n_major") / BUCKET_ROWS)
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("_major"), majors).otherwise(others)) + F.when(F.col("_major"), others).otherwise(0)
    large = large.withColumn("me", mine)
    every = F.sequence(F.lit(0).cast("long"), others - 1)
    whole = F.when(F.col("_major"), every).otherwise(F.sequence(F.lit(0).cast("long"), others + majors - 1))
    met = large.withColumn("_o", F.explode(whole)).select(
        "key", F.least("me", "_o").alias("i"), F.greatest("me", "_o").alias("j"), "me", "rep", "n", "label", *words
    )

    def compare(table: pa.Table) -> pa.Table:
        me, rep, n, label = (np.asarray(table[c]) for c in ("me", "rep", "n", "label"))
        bits = np.stack([np.asarray(table[c]) for c in words], 1).view(np.uint64)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        first, second = np.flatnonzero(me == i), np.flatnonzero(me == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in first.tolist():
            differ = np.bitwise_count(bits[second] ^ bits[x]).sum(axis=1, dtype=np.int64)
            sizes = rule.den * np.minimum(n[second], n[x]) >= rule.num * np.maximum(n[second], n[x])
            good = sizes & (differ * (rule.den + rule.num) <= (rule.den - rule.num) * (n[second] + n[x])) & (label[second] != label[x])
            y = rep[second[good]]
            y = y[y > rep[x]] if i == j else y
            a.append(np.minimum(rep[x], y))
            b.append(np.maximum(rep[x], y))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return near.unionByName(met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def linked_sets(held: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, rule: Rule) -> DataFrame:
    """rep and component of the sets that are linked with another. held: blocks, saved; reps: rep and th, saved."""
    spark = docs.sparkSession
    tokens = held.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // WIDTH
    if not tokens:
        return spark.createDataFrame([], "rep long, component long")
    buckets = 1 << max(0, (tokens // BUCKET_TOKENS).bit_length())
    rows = signatures(held, shared(held, buckets), rule)
    rows = scratch.save(rows.select("key", "rep", "n", "score", *_words(F.col("bits"))), "signatures")
    scratch.drop(held)
    words = [f"w{k}" for k in range(BITS)]
    hubs = rows.groupBy("key").agg(F.min(F.struct("score", "rep", "n", *words)).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = hubs.select("key", F.col("hub.rep").alias("hub_rep"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("n", *words)))
    star = rows.join(hubs, "key").filter((F.col("rep") != F.col("hub_rep")) & may_link(rule, "", "hub_")).select(F.col("hub_rep").alias("a"), F.col("rep").alias("b"))
    links = verified(star, reps, docs, shingle, rule)
    label = components(links) if not links.isEmpty() else spark.createDataFrame([], "node long, label long")
    of = scratch.save(rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "signatures")
    links = links.unionByName(verified(across(of, rule), reps, docs, shingle, rule))
    scratch.drop(rows, of)
    if links.isEmpty():
        return spark.createDataFrame([], "rep long, component long")
    return components(links).select(F.col("node").alias("rep"), F.col("label").alias("component"))


def classes(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns carry of docs (doc_id, text) with n_shingles and component_id, for similarity num / den and above.

    Words are lower-cased in A-Z. A text with fewer words than a shingle has all of them as its one shingle; one without
    words, or null, has none and is linked with nothing. component_id is the least doc_id that links reach. Rows of one
    doc_id are taken as one document, whose set is that of the text with the least hash; rows without a doc_id are linked
    with nothing. An empty table gives no row.
    """
    rule = Rule(num, den, RARE)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys(("doc_id", *carry)))).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("th"))
    slim = held.select("doc_id", "th", "text")
    base = scratch.save(token_sets(slim, shingle, rule), "sets", texts=True)
    of_id = scratch.save(base.filter("doc_id is not null").groupBy("doc_id").agg(F.min("th").alias("th"), F.max("th").alias("_last")).filter("th != _last").select("doc_id", F.col("th").alias("_th")), "repeated-ids")
    one = base.filter("doc_id is not null and n > 0")
    if not of_id.isEmpty():
        one = one.join(small(of_id), "doc_id", "left").filter(F.coalesce("_th", "th") == F.col("th")).drop("_th")
    reps = one.groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("_d"), F.count(F.lit(1)).alias("size"))
    reps = scratch.save(reps.select("sig", F.col("_d.doc_id").alias("rep"), F.col("_d.th").alias("th"), "size"), "reps")
    sets = one.filter("n > 1").groupBy("sig").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "low", "whole", "bits")))
    stored = scratch.save(blocks(sets), "blocks")
    # The tokens are in the blocks now.
    ids = scratch.save(base.select("doc_id", "th", "n", "sig"), "set-ids")
    if not of_id.isEmpty():
        kept = one.join(small(of_id), "doc_id", "left_semi").select(F.col("doc_id").alias("_d"), F.col("sig").alias("_sig")).distinct()
        kept = scratch.save(kept, "repeated-sets")
        ids = ids.join(kept, F.col("doc_id") == F.col("_d"), "left").withColumn("sig", F.coalesce("_sig", "sig")).drop("_d", "_sig")
    scratch.drop(base)
    linked = linked_sets(stored, reps, slim, shingle, rule)
    info = reps.select("sig", "rep", "size").join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    info = scratch.save(info.filter((F.col("size") > 1) | (F.col("component") != F.col("rep"))).select("sig", "component", "size"), "classes")
    total = info.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = info.filter(F.col("size") > total / HOT_SHARE).select("sig", F.col("component").alias("_hot"))
    rest = info.filter(F.col("size") <= total / HOT_SHARE).select(F.col("sig").alias("_key"), F.col("component").alias("_rest"))
    out = ids.join(F.broadcast(hot), "sig", "left")  # fewer than HOT_SHARE rows
    # Rows that are answered get keys of their own, so that no task gets a hot class's rows.
    key = F.when(F.col("_hot").isNull() & F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("sig")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id", "th"))))
    out = out.withColumn("_key", key).join(rest, "_key", "left")
    mine = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("_hot", "_rest"))
    labels = scratch.save(out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce(mine, "doc_id").alias("component_id")), "labels")
    scratch.drop(reps, info, of_id)
    if carry == ("doc_id",):
        return labels.drop("th")
    labels = labels.distinct().withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    return held.drop("text").join(labels, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select(*(F.col(f"_row.`{c}`") for c in carry), "n_shingles", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each class, the one of the least doc_id, and all that are linked with nothing.

    Columns keep their values whatever their names. A text without words, a null text and a row without a doc_id are linked
    with nothing and stay. Of rows that share the least doc_id of their class all stay. An empty table gives no row.
    """
    row = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("_row", "doc_id", "text")
    out = classes(row, shingle, num, den, ("_row",))
    return out.filter(F.col("component_id").eqNullSafe(F.col("_row.doc_id"))).select("_row.*")
