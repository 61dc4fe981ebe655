"""Vectorised text kernel: words, rolling hashes and winnowed anchors of UTF-8 buffers.

Every function works on the data buffer of an Arrow string array, a few MB at a
time, so that a batch of long texts never needs more than bounded memory.  All
word classes used by the operators treat bytes above 0x7F alike, so that words can
be cut on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text handled at once, in bytes; one longer text is handled alone.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, bool)
    for low, high in separators:
        inside[low : high + 1] = False
    return inside


#: ``[^\x20\x09-\x0D]+``
BLANK_WORDS = _class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
ALNUM_WORDS = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: lower-cases A-Z and leaves every other byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(n, SLICE_BYTES + 4096), _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all 64."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums c with hash(values[i:j]) = (c[j] - c[i]) * inverse**i."""
    c = np.empty(len(values) + 1, _U)
    c[0] = 0
    np.cumsum(values * powers(len(values), which)[0], out=c[1:])
    return c


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    inverse = powers(len(c), which)[1]
    return mix((c[end] - c[start]) * inverse[start])


def window_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive values; empty if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    c = prefix_sums(values, which)
    return mix((c[k:] - c[:n]) * powers(n, which)[1])


def sliding(values: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w consecutive values, by doubling."""
    out, size = values, 1
    while size * 2 <= w:
        out, size = op(out[:-size], out[size:]), size * 2
    return op(out[: len(out) - (w - size)], out[w - size :]) if size < w else out


def winnow(h: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Marks each valid position whose hash is least in some w consecutive positions.

    Equal runs of w hashes therefore always have marks, at the same places. Ties
    are all marked; runs over the edge of a text only add marks.
    """
    top = np.iinfo(h.dtype).max
    h = np.where(valid, h, top)
    padded = np.full(len(h) + 2 * (w - 1), top, h.dtype)
    padded[w - 1 : w - 1 + len(h)] = h
    return (sliding(sliding(padded, w, np.minimum), w, np.maximum) == h) & valid


class Words:
    """Words of a slice of texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        mask = inside[data]
        before, after = np.empty(len(mask), bool), np.empty(len(mask), bool)
        if len(mask):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = mask[:-1], mask[1:]
            starts = offsets[:-1]
            before[starts[starts < len(mask)]] = False
            ends = offsets[1:]
            after[ends[ends > 0] - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        c = prefix_sums(self.data.astype(_U) + _U(1), which)
        return span_hashes(c, self.start, self.end, which)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most limit bytes, or of one row."""
    data, offsets = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """The spans of data one after another. Works a step of bytes at a time, so that index arrays stay small."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    low = 0
    while low < len(start):
        base = ends[low] - length[low]
        high = max(low + 1, int(np.searchsorted(ends, base + step, "right")))
        n = length[low:high]
        out[base : ends[high - 1]] = data[np.arange(ends[high - 1] - base) + np.repeat(start[low:high] - (ends[low:high] - n - base), n)]
        low = high
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks of n places covered by spans of one length that begin at starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
