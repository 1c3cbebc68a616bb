"""The tokens of tokenizer.py for Arrow batches: the words of all lines of a piece at once, by tables of bytes.

Only runs that may hold an address are taken one by one, each different one of a piece once, with the tokenizer's patterns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import CODES, COLONS, SHAPES, WORD

# Tasks get these functions as they are and need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are worked on at once; a longer line is a piece of its own. Not part of any result.
PIECE_BYTES = 1 << 20
KINDS = list(CODES)
MAC, IPV6, IPV4, HEX, INT, CHAR, STRING = range(len(KINDS))
#: A string in quotes, which its span includes.
QUOTED = len(KINDS)
#: Runs with addresses whose tokens a task remembers, and the bytes of one. Not part of any result.
KNOWN_RUNS, KNOWN_BYTES = 1 << 14, 64
CODE = np.frombuffer("".join([*CODES.values(), CODES[KINDS[STRING]]]).encode(), np.uint8)

#: What a byte can be part of: a word, a run with an address, a number of either base; and the signs in addresses.
IS_WORD, IS_RUN, IS_X, IS_DIGIT, IS_SIGN = 1, 2, 4, 8, 16
FLAGS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _word = _b >= 0x80 or _c.isalnum() or _c == "_"
    FLAGS[_b] = IS_WORD * _word | IS_RUN * (_word or _c in ":.-") | IS_X * (_c in "0123456789abcdefABCDEF") | IS_DIGIT * (_c in "0123456789") | IS_SIGN * (_c in ":.-")
#: Bytes of the character that a byte begins.
SIZE = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 8 + [1] * 8)

TOKEN = re.compile("|".join([*(f"(?P<{k}>{SHAPES[k]}){WORD}*" for k in ("mac", "ipv6", "ipv4")), f"(?P<word>{WORD}+)"]).encode())
HEX_WORD, INT_WORD = re.compile(f"(?:{SHAPES['hex']})".encode()), re.compile(f"(?:{SHAPES['int']})".encode())


def run_tokens(run: bytes) -> list[tuple[int, int, int]]:
    """Start, end and kind of the tokens of a run of word characters, colons, dots and dashes; signs alone are none."""
    out = []
    for m in TOKEN.finditer(run):
        kind, token = m.lastgroup, m.group()
        if kind != "word":
            whole = m.end(kind) == m.end() and (kind != "ipv6" or token.count(b":") <= COLONS)
            out.append((m.start(), m.end(), KINDS.index(kind) if whole else STRING))
        elif HEX_WORD.fullmatch(token):
            out.append((m.start(), m.end(), HEX))
        elif INT_WORD.fullmatch(token):
            out.append((m.start(), m.end(), INT))
        else:
            out.append((m.start(), m.end(), CHAR if len(token) == SIZE[token[0]] else STRING))
    return out


def _tokens_of(runs: list[bytes], known: dict[bytes, list]) -> list[list[tuple[int, int, int]]]:
    """run_tokens of each run. known: what a task remembers of earlier ones."""
    if len(known) > KNOWN_RUNS:
        known.clear()
    out = [known.get(r) or run_tokens(r) for r in runs]
    known.update((r, ts) for r, ts in zip(runs, out, strict=True) if len(r) <= KNOWN_BYTES)
    return out


def _runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a mask, which end with their line. first: where lines begin, and the end."""
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | first[1:-1]
    end[:-1] &= ~mask[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _cover(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Mask of spans that don't overlap."""
    step = np.zeros(size + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def _spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, after each other."""
    ends = np.cumsum(sizes)
    return np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _array(kind: pa.DataType, offsets: np.ndarray, text: np.ndarray) -> pa.Array:
    """Strings or binaries between offsets of text, which isn't checked for being UTF-8."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])


def _spans(kind: pa.DataType, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return _array(kind, np.concatenate([[0], np.cumsum(end - start)]), text[_spread(start, end - start)])


def _quoted(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quoted texts: each quotation mark of a line with the next, whatever is between."""
    marks = np.flatnonzero(text == ord('"'))
    line = np.searchsorted(bounds, marks, "right")
    opens = (np.arange(len(marks)) - np.searchsorted(line, line)) % 2 == 0
    first = np.flatnonzero(opens[:-1] & (line[1:] == line[:-1]))
    return marks[first], marks[first + 1] + 1


def _address_runs(text: np.ndarray, flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in which an address may be: with a hex digit behind a sign, and another or a second colon before it."""
    sign = np.flatnonzero(flags & IS_SIGN)
    sign = sign[(sign > 0) & (sign + 1 < len(text))]
    sign = sign[~first[sign] & ~first[sign + 1] & (flags[sign + 1] & IS_X > 0)]
    sign = sign[(flags[sign - 1] & IS_X > 0) | (text[sign] == ord(":")) & (text[sign - 1] == ord(":"))]
    if not len(sign):
        return sign, sign
    start, end = _runs(flags & IS_RUN > 0, first)
    held = np.unique(np.searchsorted(start, sign, "right") - 1)
    return start[held], end[held]


def tokens(text: np.ndarray, bounds: np.ndarray, known: dict[bytes, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind of all tokens, in no order. bounds: the starts of lines in text, and its end."""
    first = np.zeros(len(text) + 1, bool)
    first[bounds] = True
    flags = FLAGS[text]
    q_start, q_end = _quoted(text, bounds)
    if len(q_start):
        flags[_cover(q_start, q_end, len(text))] = 0
    a_start, a_end = _address_runs(text, flags, first)
    is_word = flags & IS_WORD > 0
    found = [(q_start, q_end, np.full(len(q_start), QUOTED))]
    if len(a_start):
        is_word &= ~_cover(a_start, a_end, len(text))
        every = _spans(pa.binary(), text, a_start, a_end).dictionary_encode()
        own = _tokens_of(every.dictionary.to_pylist(), known)
        table = np.array([t for ts in own for t in ts], np.int64).reshape(-1, 3)
        sizes, of = np.array([len(ts) for ts in own]), every.indices.to_numpy()
        rows = _spread((np.cumsum(sizes) - sizes)[of], sizes[of])
        base = np.repeat(a_start, sizes[of])
        found.append((base + table[rows, 0], base + table[rows, 1], table[rows, 2]))

    start, end = _runs(is_word, first)
    kind = np.where(end - start == SIZE[text[start]], CHAR, STRING)
    number = np.flatnonzero(flags[start] & IS_DIGIT)
    if len(number):
        s, e = start[number], end[number]
        digits = np.cumsum(flags & IS_DIGIT > 0, dtype=np.int32)
        kind[number[digits[e - 1] - digits[s] == e - s - 1]] = INT
        prefixed = (e - s > 2) & (text[s] == ord("0"))
        number, s, e = number[prefixed], s[prefixed], e[prefixed]
        number, s, e = (a[text[s + 1] | 32 == ord("x")] for a in (number, s, e))
        if len(number):
            digits = np.cumsum(flags & IS_X > 0, dtype=np.int32)
            kind[number[digits[e - 1] - digits[s + 1] == e - s - 2]] = HEX
    found.append((start, end, kind))
    return tuple(np.concatenate(a) for a in zip(*found, strict=True))


def templates(text: np.ndarray, bounds: np.ndarray, known: dict[bytes, list]) -> pa.StringArray:
    """The template of each line, as tokenizer.line_template has it."""
    start, end, kind = tokens(text, bounds, known)
    count = (~_cover(start, end, len(text))).astype(np.int32)
    count[text == ord("%")] *= 2
    count[start] = np.where(kind == QUOTED, 4, 2)
    ends = np.cumsum(count, dtype=np.int64)
    out = np.repeat(text, count)
    at = ends[start] - count[start]
    quoted = at[kind == QUOTED]
    at += kind == QUOTED
    out[at], out[at + 1] = ord("%"), CODE[kind]
    out[quoted] = out[quoted + 3] = ord('"')
    return _array(pa.string(), np.concatenate([[0], ends])[bounds], out)


def _pieces(column: pa.StringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, text and bounds of pieces of a column of lines; null is an empty line."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        until = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE_BYTES, "right")) - 1)
        yield row, text[bounds[row] : bounds[until]], bounds[row : until + 1] - bounds[row]
        row = until


def _count_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """template and lines of batches with text: counts by piece, to be added up."""
    known: dict[bytes, list] = {}
    for batch in batches:
        for _, text, bounds in _pieces(batch["text"]):
            yield pa.RecordBatch.from_arrays(templates(text, bounds, known).value_counts().flatten(), names=["template", "lines"])


def template_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """template and the number of lines that have it: partial counts before the shuffle, one row a template after it."""
    rows = lines.select(F.col(text).alias("text")).mapInArrow(_count_templates, "template string, lines long")
    return rows.groupBy("template").agg(F.sum("lines").alias("lines"))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, kind, token and n of batches with file and text: counts by piece, to be added up."""
    known: dict[bytes, list] = {}
    for batch in batches:
        for row, text, bounds in _pieces(batch["text"]):
            start, end, kind = tokens(text, bounds, known)
            quoted = kind == QUOTED
            kind[quoted] = STRING
            line = np.searchsorted(bounds, start, "right") - 1
            files = batch["file"].slice(row, len(bounds) - 1).dictionary_encode("encode")
            words = _spans(pa.string(), text, start + quoted, end - quoted).dictionary_encode()
            # The same numbers for the same file, kind and token are counted in place of texts.
            of_file, of_word = files.indices.to_numpy()[line], words.indices.to_numpy().astype(np.int64)
            keys, n = pa.array((of_word * len(files.dictionary) + of_file) * len(KINDS) + kind).value_counts().flatten()
            rest, kind = np.divmod(keys.to_numpy(), len(KINDS))
            of_word, of_file = np.divmod(rest, len(files.dictionary))
            parts = (files.dictionary, of_file), (pa.array(KINDS), kind), (words.dictionary, of_word)
            yield pa.RecordBatch.from_arrays([*(a.take(pa.array(k)) for a, k in parts), n], names=["file", "kind", "token", "n"])


def kind_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """file, kind, tokens and different: the tokens of each kind in each file, and how many different ones there are."""
    rows = lines.select("file", F.col(text).alias("text")).mapInArrow(_count_tokens, "file string, kind string, token string, n long")
    # Each different token is one row before the kinds are counted.
    each = rows.groupBy("file", "kind", "token").agg(F.sum("n").alias("n"))
    return each.groupBy("file", "kind").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("different"))
