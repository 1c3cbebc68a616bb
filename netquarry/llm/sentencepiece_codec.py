"""SentencePiece encoding and decoding of whole documents: a forward pass over a trie of distinct marked words.

Words are sorted and walked like a trie, depth first: the forward state of each prefix, the score of its best path and
that path's last piece, is kept, so what two neighbours have in common is not computed again. For a unigram model the step
is Viterbi's: of all pieces that end here, the one whose score and that of the prefix before it make the best sum. The
library adds single-precision scores along a whole text, so where two paths of a word are as good but for rounding, the
text before decides. Each word's least margin between its best path and the next is therefore kept, and a text with a
margin within rounding is encoded again by one pass over all of it, in single precision.

The public model is of the BPE kind, for which the best path by scores is not what the library returns. There the forward
pass is kept and its step exchanged: the encoding of a prefix ends in the only piece whose pair with the last piece of the
prefix before it is itself encoded as those two pieces.

A text is marked (spaces become the mark, one more in front) and cut before every run of marks and between ASCII
characters that are neighbours in no piece, so that no piece can cross a cut. Characters without a piece become byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .tokens import REMEMBERED, ChunkEncoder, raw, slices, strings

MARK = "▁"
#: By how much an unknown character scores below the worst piece. Fixed value of the format.
UNKNOWN_PENALTY = 10.0
#: Rounding of sums in single precision, as a share of the sum, with room for both paths.
ROUNDING = 2.0**-21
#: Pairs whose test a worker remembers.
REMEMBERED_PAIRS = 1_000_000


class Pieces:
    """The model's pieces and the exact encoding of single words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.texts = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.scores = {self.texts[i]: model.get_score(i) for i in plain}
        self.rank = {p: -score for p, score in self.scores.items()}
        # The scores of a BPE model are the ranks of its merges; those of a unigram model are logarithms.
        self.unigram = any(not score.is_integer() for score in self.scores.values())
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.ids = {self.texts[i]: i for i in plain}
        self.bytes = {int(self.texts[i][3:5], 16): i for i in ids if model.is_byte(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank) or len(self.bytes) != 256:
            raise ValueError("the model's pieces cross words, or it has no byte pieces")
        # Lengths of the pieces of two characters and more that end in given two characters.
        ends: dict[str, set[int]] = {}
        for p in self.rank:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        # Neighbours in some piece; between other characters no piece can stand.
        self.together = np.zeros((128, 128), bool)
        for p in self.rank:
            for a, b in zip(p.replace(MARK, " "), p[1:].replace(MARK, " "), strict=False):
                if a < "\x80" and b < "\x80":
                    self.together[ord(a), ord(b)] = True
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        # Of each word met: the score of its best path, and the least margin on it by character.
        self.sums: dict[str, float] = {}
        self.margins: dict[str, float] = {}

    def merged(self, text: str) -> list[str]:
        """text by the merges themselves: always the pair of the best piece, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether a and then b is how both together are encoded."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def stands(self, a: str) -> bool:
        """Whether a piece is encoded as itself."""
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = self.merged(a) == [a]
        return known

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word."""
        out: list[list[int]] = [[] for _ in words]
        states: list[tuple[float, str, float]] = []  # of each prefix of the word before: best score, last piece, least margin
        step = self._best if self.unigram else self._last
        before = ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            common = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                common += 1
            del states[common:]
            for end in range(common + 1, len(word) + 1):
                states.append(step(word, end, states))
            out[k] = self._ids(word, lambda end: states[end - 1][1])
            if self.unigram and word:
                self.sums[word], self.margins[word] = states[-1][0], states[-1][2] / (len(word) + 1)
            before = word
        return out

    def _ids(self, word: str, last) -> list[int]:
        """Ids of the path whose last piece before each end is last(end)."""
        end, parts, ids = len(word), [], []
        while end:
            parts.append(last(end))
            end -= len(parts[-1])
        for p in reversed(parts):
            if p in self.ids:
                ids.append(self.ids[p])
            else:
                ids.extend(self.bytes[b] for b in p.encode())
        return ids

    def whole(self, text: str) -> list[int]:
        """Ids of a whole marked text by one pass in single precision, as the library adds."""
        sums, pieces = [np.float32(0)], [""]
        for end in range(1, len(text) + 1):
            best, piece = None, ""
            for n in self.lengths.get(text[max(0, end - 2) : end], ()):
                part = text[end - n : end] if n <= end else ""
                if part in self.scores:
                    score = sums[end - n] + np.float32(self.scores[part])
                    if best is None or score > best:
                        best, piece = score, part
            char = text[end - 1]
            score = sums[end - 1] + np.float32(self.scores.get(char, self.unknown))
            if best is None or score > best:
                best, piece = score, char
            sums.append(best)
            pieces.append(piece)
        return self._ids(text, pieces.__getitem__)

    def _best(self, word: str, end: int, states: list[tuple[float, str, float]]) -> tuple[float, str, float]:
        """Viterbi's step for word[:end]; of equal sums that of the longest piece counts. The margin is the least on the path."""
        before = lambda start: states[start - 1][0] if start else 0.0
        char = word[end - 1]
        best, piece, second = before(end - 1) + self.scores.get(char, self.unknown), char, -np.inf
        for n in reversed(self.lengths.get(word[max(0, end - 2) : end], ())):
            part = word[end - n : end] if n <= end else ""
            if part in self.scores:
                score = before(end - n) + self.scores[part]
                if score >= best:
                    best, piece, second = score, part, best
                else:
                    second = max(second, score)
        start = end - len(piece)
        return best, piece, min(best - second, states[start - 1][2] if start else np.inf)

    def _last(self, word: str, end: int, states: list[tuple[float, str, float]]) -> tuple[float, str, float]:
        """The step for merges by rank, which has no score."""
        for n in self.lengths.get(word[max(0, end - 2) : end], ()):
            if n <= end:
                start = end - n
                piece = word[start:end]
                if piece in self.rank and self.stands(piece) and (not start or self.follows(states[start - 1][1], piece)):
                    return 0.0, piece, np.inf
        return 0.0, word[end - 1], np.inf

    def decode(self, ids: np.ndarray) -> str:
        """The text of a document's ids."""
        out, held = [], bytearray()
        number = {i: b for b, i in self.bytes.items()}
        for i in ids.tolist():
            if i in number:
                held.append(number[i])
                continue
            out.append(held.decode(errors="replace"))
            held.clear()
            out.append(self.texts[i])
        text = "".join(out) + held.decode(errors="replace")
        return text.replace(MARK, " ").removeprefix(" ")


class WordEncoder(ChunkEncoder):
    """Ids of whole texts; each distinct marked word is encoded once."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.wide = len(self.pieces.texts) > 1 << 16
        self._empty()

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.pieces.encode([w.replace(" ", MARK) for w in words])
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts of a unigram model in which a word has two paths that rounding may reverse."""
        if not self.pieces.unigram or not len(texts):
            return np.zeros(0, np.int64)
        words, starts, rows = self._cut(texts)
        coded = words.dictionary_encode()
        each = [w.replace(" ", MARK) for w in coded.dictionary.to_pylist()]
        if len(self.pieces.sums) + len(each) > REMEMBERED:
            self.pieces.sums.clear()
            self.pieces.margins.clear()
        self.pieces.encode([w for w in each if w not in self.pieces.sums])
        at = np.asarray(coded.indices)
        scores = np.abs(np.array([self.pieces.sums[w] for w in each]))[at] if each else np.zeros(0)
        margins = np.array([self.pieces.margins[w] for w in each])[at] if each else np.zeros(0)
        text = np.searchsorted(rows, starts, side="right") - 1
        total = np.bincount(text, scores, len(texts))
        return np.unique(text[margins <= total[text] * ROUNDING])

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.pieces.whole((" " + t).replace(" ", MARK)), np.uint32) for t in texts]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        data, rows = raw(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")))
        cut = np.zeros(len(data), bool)
        a, b = data[:-1], data[1:]
        plain = (a < 128) & (b < 128)
        cut[1:] = plain & ~self.pieces.together[np.where(plain, a, 0), np.where(plain, b, 0)]
        cut[1:] |= (b == 32) & (a != 32)
        cut[rows[:-1][rows[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return strings(data, np.append(starts, len(data))), starts, rows

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, by gathering the bytes of its pieces."""
        if not hasattr(self, "tails"):
            number = {i: b for b, i in self.pieces.bytes.items()}
            parts = [bytes([number[i]]) if i in number else t.replace(MARK, " ").encode() for i, t in enumerate(self.pieces.texts)]
            self.sizes = np.array([len(p) for p in parts])
            self.heads = np.cumsum(self.sizes) - self.sizes
            self.tails = np.frombuffer(b"".join(parts), np.uint8)
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.tails[np.repeat(self.heads[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        at = ends[offsets].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(at, at[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a model file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs (doc_id, text) with ids (array<int>). A null text has null ids, an empty one none; an empty table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                ids, offsets = encoder(model).encode(part["text"])
                empty = np.append(np.asarray(part["text"].is_null()), False)
                at = pa.array(offsets.astype(np.int32), mask=empty)  # a null offset makes a null list
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))], names=[*part.schema.names, "ids"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(scratch.trimmed(run), T.StructType([*slim.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, ids) with decoded, the text of the ids; null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.values is None else encoder(model).pieces.decode(np.asarray(x.values)) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(scratch.trimmed(run), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256 and same (whether decoding gave the text back).

    A null text counts as empty; rows that share a doc_id are separate documents; an empty table gives no row. Encoding and
    decoding are done in one pass, a slice of documents at a time, whose result is written to a scratch table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        for batch in batches:
            for a, b in slices(batch["text"]):
                texts = pc.fill_null(batch["text"].slice(a, b - a), "")
                ids, offsets = encoder(model).encode(texts)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc, sha, same = [], [], []
                decoded = encoder(model).decode_all(ids, offsets)
                for text, back, x, y in zip(texts.cast(pa.large_binary()).to_pylist(), decoded, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    crc.append(zlib.crc32(wide[4 * x : 4 * y]))
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(text == back)
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(a, b - a), "n_ids": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crc, pa.int64()), "decoded_sha256": sha, "same": same})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = slim.mapInArrow(scratch.trimmed(run), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
    return scratch.save(out, "round-trip", texts=True)
