"""Words of whole texts as arrays of 64-bit hashes, a slice of rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .tokens import raw, strings

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit permutation in which every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """hashes: of all words in order; rows: offsets of each row's words; lines: for each word the number of its line over
    all rows; row_lines: offsets of each row's lines; numeric: whether a word has a digit."""

    def __init__(self, texts: pa.Array, lower: bool = False, lines: bool = False):
        data, rows = raw(pc.ascii_lower(texts) if lower else texts)
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]]) if len(data) else space
        inside = rows[:-1][rows[:-1] < len(data)]
        start = ~space & before
        start[inside] |= ~space[inside]  # a row's first byte starts a word even if the row before ends in one
        starts = np.flatnonzero(start)
        # A word ends before the next space or row.
        after = np.concatenate([space[1:], [True]]) if len(data) else space
        end = ~space & after
        last = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] <= len(data))] - 1
        end[last] |= ~space[last]
        ends = np.flatnonzero(end) + 1
        self.rows = np.searchsorted(starts, rows)
        bounds = np.stack([starts, ends], 1).ravel()
        if len(starts):
            pieces = strings(data, np.append(bounds, len(data))).take(pa.array(np.arange(0, 2 * len(starts), 2)))
            coded = pieces.dictionary_encode()
            distinct = coded.dictionary
            table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
            codes = np.asarray(coded.indices)
            self.hashes = table[codes]
            if lines:
                self.numeric = np.asarray(pc.match_substring_regex(distinct, "[0-9]"))[codes]
        else:
            self.hashes, self.numeric = np.zeros(0, np.uint64), np.zeros(0, bool)
        if lines:
            breaks = np.flatnonzero(data == 10)
            # Lines before each row: its line breaks and one more for each row before.
            self.row_lines = np.searchsorted(breaks, rows) + np.arange(len(rows))
            row = np.repeat(np.arange(len(rows) - 1), np.diff(self.rows))
            self.lines = np.searchsorted(breaks, starts) + row
