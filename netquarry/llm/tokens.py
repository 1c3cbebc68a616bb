"""Tokenising whole documents with the tokenizers library, each distinct chunk once per batch.

A text is cut where both vocabularies' own pre-tokenizers cut as well: before white space that follows a character
other than white space, and between a letter (ASCII or Latin-1) and ASCII punctuation (apostrophes aside, since
contractions are one piece). The ids of a text are then the ids of its chunks in order, so each distinct chunk is encoded once and the
rest is a gather over numpy arrays. Texts with other white space than ASCII are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a Python worker remembers; beyond it those met in one slice only are forgotten.
REMEMBERED = 500_000
#: Chunks that are joined by a separator and encoded in one call.
JOINED = 2000
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20

SPACE, LETTER, PUNCTUATION = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[65:91] = LETTER
_CLASS[97:123] = LETTER
for _span in ((33, 39), (40, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[slice(*_span)] = PUNCTUATION
#: White space other than ASCII, and the separators that some regex engines count as white space.
_ODD_SPACE = "[\x1c-\x1f\u0085   -     　]"


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its row offsets in them; nulls count as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte of UTF-8 text; 0 for what isn't known to be a space, letter or punctuation."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    return kind


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings between consecutive offsets of data."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


#: Chunks between which a separator is tried.
PROBES = ("x", " x", "word", " words", "X", " Éé", ".", " (", "漢", "w65536")


class ChunkEncoder:
    """Ids of whole texts by a tokenizers file; one per Python worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        # A separator that is a piece and an id of its own between chunks free of what could join it.
        candidates = ("\n", "[\t\n\x0b\x0c\r]|  | $"), ("7", "7")
        # A vocabulary with neither has its chunks encoded one by one.
        self.separator, unsafe = next((c for c in candidates if self._separates(c[0])), ("", ""))
        self.unsafe = re.compile(unsafe)
        self.mark = self._one(self.separator)[0] if self.separator else None
        self._empty()

    def _separates(self, separator: str) -> bool:
        """Whether separator is one id, unlike that of any chunk beside it, and leaves the ids of chunks as they are."""
        mark = self._one(separator)
        ids = [self._one(x) for x in PROBES]
        alone = len(mark) == 1 and all(ids) and not any(mark[0] in x for x in ids)
        return alone and self._one(separator.join([*PROBES, ""])) == [i for x in ids for i in [*x, *mark]]

    def forget(self) -> None:
        """Keep the chunks met in two slices or more since the last time."""
        keep = np.flatnonzero(self.met[: len(self.known)] > 1)
        if len(keep) > REMEMBERED // 2:
            keep = keep[:0]
        words = list(self.known)
        sizes = self.lengths[keep]
        ends = np.cumsum(sizes)
        used = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(used)]
        self._empty()
        self._add([words[k] for k in keep], ids, sizes)

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32 if self.wide else np.uint16)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.met = np.zeros(1 << 12, np.int32)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last, total = len(self.known), len(self.known) + len(words), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while last > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        self.ids[self.used : self.used + total] = ids
        self.lengths[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.known.update(zip(words, range(first, last), strict=True))

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words that may be joined are encoded many in a call."""
        alone = [i for i, w in enumerate(words) if self.unsafe.search(w)]
        ids = dict(zip(alone, self._each([words[i] for i in alone]), strict=True))
        joined = [w for i, w in enumerate(words) if i not in ids] if ids else words
        blocks = [joined[a : a + JOINED] for a in range(0, len(joined), JOINED)]
        parts, sizes = [], []
        for block, part in zip(blocks, self._each([self.separator.join([*b, ""]) for b in blocks]), strict=True):
            at = np.flatnonzero(part == self.mark)
            if len(at) != len(block):
                each = self._each(block)
                parts.append(np.concatenate(each))
                sizes.append(np.array([len(x) for x in each]))
            else:
                parts.append(np.delete(part, at))
                sizes.append(np.diff(at, prepend=-1) - 1)
        flat = np.concatenate([*parts, np.zeros(0, np.uint32)])
        size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
        if ids:
            ends = np.concatenate([[0], np.cumsum(size)])
            where = np.array(alone) - np.arange(len(alone))  # among the joined words, the one that each stands before
            at = np.repeat(ends[where], [len(ids[i]) for i in alone])
            flat = np.insert(flat, at, np.concatenate([ids[i] for i in alone]))
            size = np.insert(size, where, [len(ids[i]) for i in alone])
        return flat, size

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Rows whose ids aren't those of their chunks."""
        return np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _ODD_SPACE)))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Chunks of all texts, where each starts and where the texts do."""
        data, rows = raw(texts)
        kind = classes(data)
        before = np.concatenate([[0], kind[:-1]]) if len(data) else kind
        cut = ((kind == SPACE) & (before != SPACE)) | ((kind == LETTER) & (before == PUNCTUATION)) | ((kind == PUNCTUATION) & (before == LETTER))
        cut[rows[:-1][rows[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return strings(data, np.append(starts, len(data))), starts, rows

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            self._add(words[at : at + 20_000], *self._ids_of(words[at : at + 20_000]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text's ids."""
        texts = pc.fill_null(texts, "")
        odd = self._odd(texts)
        if len(odd):
            plain = texts.to_pylist()
            whole = dict(zip(odd.tolist(), self._each([plain[i] for i in odd]), strict=True))
            for i in odd:
                plain[i] = ""
            ids, offsets = self.encode(pa.array(plain, pa.string()))
            parts = [whole.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(plain))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        pieces, starts, rows = self._cut(texts)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        self._learn([w for w in words if w not in self.known])
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met[slots] += 1
        slot = slots[np.asarray(coded.indices)]
        sizes = self.lengths[slot]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[slot] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, rows)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
