"""Toxicity by a convolutional text classifier, trained in numpy on every labelled document that is not held out.

A word's embedding is the mean of hashed rows, one for the whole word and one for each of its beginnings of a few lengths,
so that a word never seen shares what its stem has shown. Filters of several widths run over the embedded words of a whole
text; each keeps its largest value, and a logistic layer weighs these. The gradient of a maximum goes to one place, so a
training step touches few rows. Training goes in rounds: each task takes steps from the common weights over the documents
dealt to it, and the changes are averaged by the number of documents, a row's over the tasks that changed it. The driver
holds the weights alone. Scores are calibrated on labelled rows that training hasn't seen, counted by score, and each
language gets a threshold of its own there, shrunk towards the common one where the language has few rows. The language
serves that threshold alone: the score is made of the text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .lookup import screened
from .tokens import raw, slices
from .words import mix

#: Labelled rows dealt to one task, about, and bytes of text that a task holds at once; a longer text goes alone.
PART_ROWS, PART_BYTES = 12_000, 1 << 26
#: Of 100 labelled rows, so many calibrate the scores and thresholds and are not trained on.
HELD = 20
BUCKETS, SIZE = 1 << 19, 16
WIDTHS, FILTERS = (1, 2, 3), 24
#: Lengths in bytes of the beginnings of a word that have rows.
STEMS = (3, 4, 5, 6, 7, 8)
EPOCHS, LEAST_EPOCHS, LEAST_STEPS, BATCH, RATE, TABLE_RATE, SEED = 6, 2, 400, 32, 0.02, 0.3, 20
#: Labelled rows beyond which there are fewer epochs than EPOCHS, down to LEAST_EPOCHS.
MANY_ROWS = 6_000
#: Texts in which a piece must stand in training for its row to be more than zero, and what a weight's past squares begin at.
MIN_TEXTS, PAST = 3, 1e-4
#: Score from which a text counts as toxic; thresholds of languages are shrunk to it, with so many rows' weight.
THRESHOLD, SHRINK = 0.7, 200.0
#: Scores are counted by logit, in steps of 1 / FINE between -REACH and REACH.
FINE, REACH = 256, 30
#: Windows computed at once, words multiplied at once, and bytes of text whose words are; a longer text goes alone.
BLOCK, CHUNK, SLICE_BYTES = 1 << 12, 1 << 10, 1 << 20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _IN_WORD[_a:_b] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=2)
def _many_powers(base: int) -> np.ndarray:
    return _powers(base, 2 * SLICE_BYTES)


def powers(base: int, n: int) -> np.ndarray:
    return _many_powers(base)[:n] if n <= 2 * SLICE_BYTES else _powers(base, n)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct words of texts (a row of bucket numbers each), the words of all texts as rows of it, offsets by text.

    Words are runs of letters, digits and characters beyond ASCII, in lower case. A beginning that a word doesn't have has
    the number BUCKETS.
    """
    data, rows = raw(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    inside = _IN_WORD[data] if len(data) else np.zeros(0, bool)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(data))]
    start[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    # Hashes of any piece of the text from sums of its bytes times powers of an odd number, which has an inverse.
    weighed = (data.astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
    back = powers(pow(int(_BASE), -1, 1 << 64), len(data))
    piece = lambda a, b: mix((sums[b] - sums[a]) * back[a])
    whole = piece(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    of = np.asarray(pa.array(whole).dictionary_encode().indices)
    # A word is numbered where it first occurs, so the largest number so far grows there.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1)) if len(of) else np.zeros(0, np.int64)
    a, b = starts[first], ends[first]
    ids = np.full((len(first), 1 + len(STEMS)), BUCKETS, np.int32)
    if len(first):
        ids[:, 0] = whole[first] % np.uint64(BUCKETS)
    for k, n in enumerate(STEMS, 1):
        has = b - a > n
        ids[has, k] = mix(piece(a[has], a[has] + n) + np.uint64(k)) % np.uint64(BUCKETS)
    return ids, of, np.searchsorted(starts, rows)


def all_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What words() gives, made a slice at a time; a word may have a row in each slice."""
    ids, of, sizes, n = [], [], [np.zeros(1, np.int64)], 0
    for a, b in slices(texts, SLICE_BYTES):
        some, places, offsets = words(texts.slice(a, b - a))
        ids.append(some)
        of.append((places + n).astype(np.int32))
        sizes.append(np.diff(offsets))
        n += len(some)
    empty = [np.zeros((0, 1 + len(STEMS)), np.int32)], [np.zeros(0, np.int32)]
    return np.concatenate(ids or empty[0]), np.concatenate(of or empty[1]), np.cumsum(np.concatenate(sizes))


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where texts' windows begin and where their words go, in a row of places: after each text there are empty places.

    Returns first window of each text with the end of all, places of the words, and the number of places. A text has a
    window for each word, and one if it has none.
    """
    sizes = np.diff(offsets)
    windows = np.maximum(sizes, 1)
    begins = np.concatenate([[0], np.cumsum(windows + max(WIDTHS) - 1)])
    places = np.arange(offsets[-1] - offsets[0]) + np.repeat(begins[:-1] - (offsets[:-1] - offsets[0]), sizes)
    return begins, places, int(begins[-1])


def times(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """rows @ matrix, each row summed in the same order whatever rows there are besides, so equal texts get equal scores."""
    out = np.empty((len(rows), matrix.shape[1]), np.float32)
    for a in range(0, len(rows), CHUNK):
        some = rows[a : a + CHUNK]
        sums = some[:, :1] * matrix[0]
        for k in range(1, len(matrix)):
            sums += some[:, k : k + 1] * matrix[k]
        out[a : a + CHUNK] = sums
    return out


def by_bin(bins: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values in each of n bins."""
    return np.stack([np.bincount(bins, v, n) for v in values.T], 1).astype(np.float32)


@dataclass
class Model:
    """Weights: the row of each hash bucket and the rows (the last, of buckets without one, is zero), filters and biases by
    width, the last layer, calibration."""

    slots: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    last: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, live: np.ndarray, seed: int = SEED) -> Model:
        """live: which buckets have a row."""
        pick, n = np.random.default_rng(seed), int(live.sum())
        slots = np.where(live, np.cumsum(live) - 1, n).astype(np.int32)
        table = pick.normal(0, 0.1, (n + 1, SIZE)).astype(np.float32)
        table[n] = 0
        filters = [pick.normal(0, 0.5 / math.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(slots, table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], pick.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """Embeddings of distinct words, with an empty one at the end."""
        n = (ids != BUCKETS).sum(1, keepdims=True)
        out = np.zeros((len(ids) + 1, SIZE), np.float32)
        for column in ids.T:
            out[:-1] += self.table[self.slots[column]]
        out[:-1] /= np.maximum(n, 1)
        return out

    def side(self, j: int) -> np.ndarray:
        """What all filters of more than j words weigh their j-th word with, side by side."""
        return np.concatenate([f[j] for w, f in zip(WIDTHS, self.filters, strict=True) if w > j], 1)

    def pooled(self, ids: np.ndarray, of: np.ndarray, offsets: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Largest value of each filter in each text, the first window that has it (if where), the embeddings, and the places."""
        embedded = self.embed(ids)
        begins, places, n = layout(offsets)
        at = np.full(n, len(ids), np.int64)
        at[places] = of
        parts = [embedded @ self.side(j) if where else times(embedded, self.side(j)) for j in range(max(WIDTHS))]
        out = np.full((len(offsets) - 1, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        window = np.zeros(out.shape, np.int64) if where else None
        valid = np.ones(n, bool)
        for k in range(1, max(WIDTHS)):
            valid[begins[1:] - k] = False
        windows = np.flatnonzero(valid)
        text = np.searchsorted(begins, windows, side="right") - 1
        for a in range(0, len(windows), BLOCK):
            z, t = windows[a : a + BLOCK], text[a : a + BLOCK]
            first = np.concatenate([[True], t[1:] != t[:-1]])
            cuts = np.flatnonzero(first)
            values = parts[0][at[z]]
            for j in range(1, max(WIDTHS)):
                values[:, -parts[j].shape[1] :] += parts[j][at[z + j]]
            best, mine = np.maximum.reduceat(values, cuts, axis=0), t[cuts]
            if where:
                own = np.cumsum(first) - 1
                row, column = (x[::-1] for x in np.nonzero(values == best[own]))  # of equal ones the first is set last
                here = np.zeros(best.shape, np.int64)
                here[own[row], column] = z[row]
                window[mine] = np.where(best > out[mine], here, window[mine])
            out[mine] = np.maximum(out[mine], best)
        return out, window, embedded, at

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts, SLICE_BYTES):
            pooled, *_ = self.pooled(*words(texts.slice(a, b - a)))
            out[a:b] = (np.maximum(pooled + np.concatenate(self.biases), 0) * self.last).sum(1, dtype=np.float64) + self.bias
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability of each text, from its words alone."""
        return self.probability(self.logits(texts))

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))

    def step(self, ids: np.ndarray, of: np.ndarray, offsets: np.ndarray, y: np.ndarray, moments: dict) -> None:
        """One step of gradient descent on a batch, each weight's rate divided by the root of its past squares."""
        pooled, window, embedded, at = self.pooled(ids, of, offsets, where=True)
        hidden = pooled + np.concatenate(self.biases)
        active = hidden > 0
        p = 1 / (1 + np.exp(-np.clip(np.maximum(hidden, 0) @ self.last + self.bias, -30, 30)))
        error = ((p - y) / len(y)).astype(np.float32)
        back = error[:, None] * self.last * active
        updates = [("last", self.last, np.maximum(hidden, 0).T @ error + 1e-4 * self.last)]
        text, column = np.nonzero(back)
        slope, place = back[text, column][:, None], window[text, column]
        grads, words_, grown = [np.zeros_like(f) for f in self.filters], [], []
        for j in range(max(WIDTHS)):
            side, skipped = self.side(j), FILTERS * sum(w <= j for w in WIDTHS)
            some = column >= skipped
            word, mine = at[place[some] + j], column[some] - skipped
            sums = by_bin(mine, slope[some] * embedded[word], side.shape[1]).T
            for k, w in enumerate(w for w in WIDTHS if w > j):
                grads[WIDTHS.index(w)][j] = sums[:, k * FILTERS : (k + 1) * FILTERS]
            words_.append(word)
            grown.append(slope[some] * side.T[mine])
        for k in range(len(WIDTHS)):
            updates += [(f"f{k}", self.filters[k], grads[k]), (f"b{k}", self.biases[k], back[:, k * FILTERS : (k + 1) * FILTERS].sum(0))]
        word, grow = np.concatenate(words_), np.concatenate(grown)
        word, grow = word[word < len(ids)], grow[word < len(ids)]
        touched, which = np.unique(word, return_inverse=True)
        if len(touched):
            n = np.maximum((ids[touched] != BUCKETS).sum(1, keepdims=True), 1)
            share = by_bin(which.reshape(-1), grow, len(touched)) / n
            rows, which = np.unique(self.slots[ids[touched]], return_inverse=True)
            sums = by_bin(which.reshape(-1), np.repeat(share, ids.shape[1], axis=0), len(rows))
            sums[rows == len(self.table) - 1] = 0
            square = moments.setdefault("table", np.full(len(self.table), PAST, np.float32))
            square[rows] += (sums**2).sum(1)
            self.table[rows] -= TABLE_RATE * sums / np.sqrt(square[rows])[:, None]
        for name, weight, grad in updates:
            past = moments.setdefault(name, np.full_like(weight, PAST))
            past += grad**2
            weight -= RATE * grad / np.sqrt(past)
        g = float(error.sum())
        moments["bias"] = moments.get("bias", PAST) + g * g
        self.bias -= RATE * g / math.sqrt(moments["bias"])

    def learn(self, texts: pa.Array, y: np.ndarray, epochs: int, moments: dict, pick: np.random.Generator) -> None:
        """Steps over all texts, epochs times, in other orders."""
        ids, of, offsets = all_words(texts)
        order = np.arange(len(y))
        for _ in range(epochs):
            pick.shuffle(order)
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                mine = np.concatenate([of[offsets[i] : offsets[i + 1]] for i in some])
                bounds = np.concatenate([[0], np.cumsum(offsets[some + 1] - offsets[some])])
                seen, local = np.unique(mine, return_inverse=True)
                self.step(ids[seen], local.reshape(-1), bounds, y[some].astype(np.float32), moments)

    def dense(self) -> list[np.ndarray]:
        return [self.last, *self.filters, *self.biases]

    def rest(self, moments: dict) -> np.ndarray:
        """All weights but the table with their past squares, in rows of SIZE + 1."""
        names = ["last", *(f"f{k}" for k in range(len(WIDTHS))), *(f"b{k}" for k in range(len(WIDTHS)))]
        past = [moments.setdefault(name, np.full_like(x, PAST)) for name, x in zip(names, self.dense(), strict=True)]
        rest = np.concatenate([*(x.ravel() for x in (*self.dense(), *past)), [self.bias, moments.setdefault("bias", PAST)]])
        return np.concatenate([rest, np.zeros(-len(rest) % (SIZE + 1))]).reshape(-1, SIZE + 1)

    def state(self, moments: dict) -> tuple[np.ndarray, np.ndarray]:
        """The table with its past squares, a row each, and rest()."""
        square = moments.setdefault("table", np.full(len(self.table), PAST, np.float32))
        return np.concatenate([self.table, square[:, None]], 1), self.rest(moments)

    def move(self, moments: dict, rows: np.ndarray, changes: np.ndarray) -> None:
        """Add changes to rows of state()."""
        rest, inner = self.rest(moments), rows < len(self.table)
        self.table[rows[inner]] += changes[inner, :SIZE]
        square = moments.setdefault("table", np.full(len(self.table), PAST, np.float32))
        square[rows[inner]] += changes[inner, SIZE]
        rest[rows[~inner] - len(self.table)] += changes[~inner]
        flat, a = rest.ravel(), 0
        names = ["last", *(f"f{k}" for k in range(len(WIDTHS))), *(f"b{k}" for k in range(len(WIDTHS)))]
        for x in (*self.dense(), *(moments[name] for name in names)):
            x[...] = flat[a : a + x.size].reshape(x.shape)
            a += x.size
        self.bias, moments["bias"] = float(flat[a]), float(flat[a + 1])


def platt(logits: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift that make logits probabilities, by Newton's method towards Platt's softened targets. n: rows of each.

    Both are held to their starts by a ridge, so that a few rows, which any steep slope may divide, change little.
    """
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([logits, np.ones(len(logits))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.clip(np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.eye(2), z.T @ (n * (p - target)) + (w - [1.0, 0.0])), -0.5, 0.5)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def texts_with(texts: pa.Array) -> np.ndarray:
    """In how many of the texts each bucket's pieces stand."""
    out, mark = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int32)
    for a, b in slices(texts, SLICE_BYTES):
        ids, of, offsets = words(texts.slice(a, b - a))
        for t in range(b - a):
            mine = ids[of[offsets[t] : offsets[t + 1]]].ravel()
            # Of equal ones the mark of one is left.
            mark[mine] = own = np.arange(len(mine))
            out[mine[mark[mine] == own]] += 1
    out[BUCKETS] = 0
    return out


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Slope and shift of model from logits and classes of n rows each, both classes among them."""
    model.slope, shift = platt(logits, y, n)
    # Of probabilities, those over half the F1 that they allow are best taken; that cut becomes THRESHOLD.
    by = np.argsort(-logits, kind="stable")
    p, n = 1 / (1 + np.exp(-np.clip(model.slope * logits[by] + shift, -30, 30))), n[by]
    cut = float((np.cumsum(n * p) / (np.cumsum(n) + (n * p).sum())).max())
    model.shift = shift + math.log(THRESHOLD / (1 - THRESHOLD)) - math.log(cut / (1 - cut))


def best_cut(scores: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """The middle of the gap between scores at which F1 is best; None without a row of class 1. n: rows of each."""
    by = np.argsort(-scores, kind="stable")
    s, hits = scores[by], np.cumsum((n * y)[by])
    if not len(s) or not hits[-1]:
        return None
    f1 = 2 * hits / (np.cumsum(n[by]) + hits[-1])
    nexts = np.append(s[1:], s[-1] - 1e-3)
    f1[s == nexts] = -1
    best = int(f1.argmax())
    return float((s[best] + nexts[best]) / 2)


def thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None], n: np.ndarray) -> dict[str, float]:
    """For each language the score from which F1 on labelled rows is best, shrunk to THRESHOLD by the number of rows."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        own, rows = best_cut(scores[mine], y[mine], n[mine]), n[mine].sum()
        out[lang] = float((rows * (THRESHOLD if own is None else own) + SHRINK * THRESHOLD) / (rows + SHRINK))
    return out


def remainder(key: Column) -> Column:
    """crc32 of a key's text modulo 3; null for a null key."""
    return F.crc32(key.cast("string")) % 3


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A saved table of text, lang, label and held (whether the row calibrates): every row of docs with a label, none that is held out."""
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = scratch.save(known.filter(remainder(F.col("doc_id")) != 1), "labels")
    n = known.count()
    text = F.coalesce("text", F.lit(""))
    held = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(100)) < HELD
    slim = docs.select("doc_id", text.alias("text"), "lang").filter(remainder(F.col("doc_id")) != 1)
    met = screened(slim, "doc_id", known, "doc_id", n).join(known, "doc_id").select("doc_id", "text", "lang", "label", held.alias("held"))
    dealt = met.repartition(max(1, -(-n // PART_ROWS)), "doc_id").sortWithinPartitions("doc_id", "text")
    out = scratch.save(dealt.drop("doc_id"), "labelled")
    scratch.drop(known)
    return out


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts and labels of batches, PART_BYTES or a little more at once."""
    held, size = [], 0
    for batch in batches:
        for a, b in slices(batch.column("text"), PART_BYTES):
            held.append(batch.slice(a, b - a))
            size += held[-1].column("text").nbytes
            if size >= PART_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    texts = pa.chunked_array([x.column("text").cast(pa.large_string()) for x in held]).combine_chunks()
    return texts, np.concatenate([np.asarray(x.column("label"), float) for x in held])


def live(rows: DataFrame) -> np.ndarray:
    """Which buckets belong to pieces that stand in MIN_TEXTS of the texts: what fewer hold would be learned by heart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((texts_with(b.column("text").cast(pa.large_string())) for b in batches), np.zeros(BUCKETS + 1, np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.minimum(total[some], MIN_TEXTS).astype(np.int32))], names=["bucket", "n"])

    counts = rows.select("text").mapInArrow(scratch.trimmed(count), "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, bool)
    out[np.asarray(counts.filter(F.col("n") >= MIN_TEXTS).select("bucket").toArrow().column(0))] = True
    return out


def spread(model: Model, moments: dict, rows: DataFrame, epochs: int, number: int) -> None:
    """One round: every task learns from its rows, starting from model and moments, which then move by the mean change."""
    names = [f"v{k}" for k in range(SIZE + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = model.state(moments), 0
        for k, (texts, y) in enumerate(parted(batches)):
            model.learn(texts, y, epochs, moments, np.random.default_rng([SEED, number, k]))
            n += len(y)
        if n:
            after = model.state(moments)
            some = np.flatnonzero((after[0] != before[0]).any(1))
            changes = np.concatenate([after[0][some] - before[0][some], after[1] - before[1]]).astype(np.float32)
            places = np.concatenate([some, len(after[0]) + np.arange(len(after[1]))]).astype(np.int32)
            for a in range(0, len(places), 1 << 14):
                part = slice(a, a + (1 << 14))
                columns = [pa.array(places[part]), pa.array(np.full(len(places[part]), n, np.int32)), *(pa.array(c) for c in changes[part].T.copy())]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "n", *names])

    changed = rows.select("text", "label").mapInArrow(scratch.trimmed(run), f"place int, n int, {', '.join(f'{c} float' for c in names)}")
    # Sums of integers, so that the order in which tasks end changes nothing.
    unit = float(1 << 24)
    sums = changed.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(F.rint(F.col(c).cast("double") * F.col("n") * unit).cast("long")).alias(c) for c in names))
    got = sums.select("place", *((F.col(c) / (F.col("n") * unit)).cast("float").alias(c) for c in names)).toArrow()
    model.move(moments, np.asarray(got.column("place")), np.stack([np.asarray(got.column(c)) for c in names], 1))
    del got
    scratch.trim()


def train(rows: DataFrame, seed: int = SEED) -> tuple[Model, dict[str, float]]:
    """A model of labelled() rows, of which most train it and the others calibrate it, and thresholds by language.

    Up to PART_ROWS rows are learned from in one task and one round; more are in as many rounds as epochs. Labels of one
    class give their rate.
    """
    counts = {(r["held"], r["label"]): r["n"] for r in rows.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, hits = sum(counts.values()), sum(v for (_, y), v in counts.items() if y)
    rate = float(np.clip(hits / n, 1e-3, 1 - 1e-3)) if n else 0.5
    fit, n_fit = rows.filter(~F.col("held")), sum(v for (held, _), v in counts.items() if not held)
    if len({y for held, y in counts if not held}) < 2:
        model = Model.new(np.zeros(BUCKETS + 1, bool), seed)
        model.last[:], model.bias = 0, math.log(rate / (1 - rate))
        return model, {}
    model, moments = Model.new(live(fit), seed), {}
    model.bias = math.log(rate / (1 - rate))
    epochs = max(LEAST_EPOCHS, min(EPOCHS, -(-EPOCHS * MANY_ROWS // n)), -(-LEAST_STEPS * BATCH // n_fit))
    alone = n <= PART_ROWS
    for k in range(1 if alone else epochs):
        spread(model, moments, fit, epochs if alone else 1, k)
    if len({y for held, y in counts if held}) < 2:
        return model, {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.rint(np.clip(model.logits(b.column("text")), -REACH, REACH) * FINE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("label"), pa.array(bins)], names=["lang", "label", "bin"])

    seen = rows.filter("held").select("text", "lang", "label").mapInArrow(scratch.trimmed(run), "lang string, label int, bin int")
    seen = seen.groupBy("lang", "label", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "bin", "label").toArrow()
    logits, y, n = (np.asarray(seen.column(c), float) for c in ("bin", "label", "n"))
    calibrate(model, logits / FINE, y, n)
    return model, thresholds(model.probability(logits / FINE), y, seen.column("lang").to_pylist(), n)


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns carry of docs (doc_id, text, lang) with score, threshold and toxic (whether score reaches threshold).

    labels: doc_id and label (0 or 1, null for unknown); of repeated ones the greatest counts; those held out (remainder 1)
    are never learned from, all others are, in every row of docs that has them. A null text counts as empty; an empty text,
    and one without words, has the score of no word; texts are read whole. Equal texts have equal scores. A language
    without labelled rows, and a null one, has THRESHOLD. With labels of one class only, or none, every score is the rate
    of the labels (one half if there are none). An empty table gives no row.
    """
    rows = labelled(docs, labels)
    model, limits = train(rows)
    scratch.drop(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.scores(batch.column("_text")))], names=[*names, "score"])

    slim = docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)), F.col("lang").alias("_lang"), F.coalesce("text", F.lit("")).alias("_text"))
    names = [c for c in slim.columns if c != "_text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    out = slim.mapInArrow(scratch.trimmed(run), f"{kinds}, score double")
    limit = F.lit(THRESHOLD)
    for lang, value in limits.items():
        limit = F.when(F.col("_lang") == lang, value).otherwise(limit)
    out = out.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))
    return out.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)), "score", "threshold", "toxic")
