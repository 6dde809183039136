"""Vectorised work on whole UTF-8 texts: chunks of Arrow columns, word spans, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)

#: ASCII white space, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Not of [0-9A-Za-z] and not above ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower-cases A-Z and leaves the rest.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: The low bytes of a lane that the last bytes of a word fill.
_KEPT = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's values and their offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most `most` bytes, or of one row."""
    if not batch.num_rows:
        return
    raw, at = column_bytes(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row (one more at the end). A row's end ends a word."""
    inside = ~separators[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] |= inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


class Words:
    """The bytes of words as 8-byte lanes, the last one of each filled up with zeros, and a 64-bit hash of each word.

    Every lane is mixed with its place before the lanes of a word are added up. `same` compares bytes, for use where a hash is not enough.
    """

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True):
        self.size = (end - start).astype(np.int64)
        n = np.maximum(1, (self.size + 7) >> 3)
        self.first = np.concatenate(([0], np.cumsum(n)))
        if not len(start):
            self.lanes = self.hashes = np.empty(0, _U)
            return
        held = np.zeros(len(raw) + 8, np.uint8)
        held[: len(raw)] = LOWER[raw] if lower else raw
        every = np.ndarray((len(raw) + 1,), "<u8", held, strides=(1,))
        long = self.first[-1] > len(start)
        if long:
            place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n)
            at, left = np.repeat(start, n) + 8 * place, np.repeat(self.size, n) - 8 * place
        else:
            at, left = start, self.size
        self.lanes = every[at] & _KEPT[np.minimum(left, 8)]
        with np.errstate(over="ignore"):
            sums = mix(self.lanes + _P * (place + 1).astype(_U)) if long else mix(self.lanes + _P)
            if long:
                sums = np.add.reduceat(sums, self.first[:-1])
            self.hashes = mix(sums + self.size.astype(_U))

    def same(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """Whether word i[x] has the bytes of the other's word j[x]."""
        a, b = self.first[i], other.first[j]
        equal = (self.size[i] == other.size[j]) & (self.lanes[a] == other.lanes[b]) if len(i) else np.empty(0, bool)
        long = np.flatnonzero(equal & (self.size[i] > 8)) if len(i) else equal
        if len(long):
            n = self.first[i[long] + 1] - a[long]
            begin = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(begin, n)
            one = self.lanes[np.repeat(a[long], n) + place] == other.lanes[np.repeat(b[long], n) + place]
            equal[long] = np.logical_and.reduceat(one, begin)
        return equal

    def bytes(self, i: int) -> bytes:
        """The bytes of one word."""
        return self.lanes[self.first[i] : self.first[i + 1]].tobytes()[: int(self.size[i])]

    def joined(self, other: Words) -> Words:
        """These words and then the other's."""
        out = Words.__new__(Words)
        out.size, out.lanes, out.hashes = (np.concatenate((getattr(self, x), getattr(other, x))) for x in ("size", "lanes", "hashes"))
        out.first = np.concatenate((self.first, self.first[-1] + other.first[1:]))
        return out

    def taken(self, i: np.ndarray) -> Words:
        """Those words alone."""
        out = Words.__new__(Words)
        n = self.first[i + 1] - self.first[i]
        out.size, out.hashes, out.first = self.size[i], self.hashes[i], np.concatenate(([0], np.cumsum(n)))
        out.lanes = self.lanes[np.arange(out.first[-1]) + np.repeat(self.first[i] - out.first[:-1], n)]
        return out


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return Words(raw, start, end, lower).hashes


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, and the first of each row; fewer words than k are one run."""
    n = np.diff(row)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(to[-1], _U)
    if not len(out):
        return out, to
    with np.errstate(over="ignore"):
        total = len(hashes) - k + 1
        if total > 0:
            rolled = np.zeros(total, _U)
            for i in range(k):
                rolled = mix(rolled * _U(3) + hashes[i : i + total])
        owner = np.repeat(np.arange(len(n)), runs)
        from_ = row[owner] + np.arange(len(out)) - to[owner]
        long = n[owner] >= k
        if long.any():
            out[long] = rolled[from_[long]]
        for i in np.flatnonzero(~long):
            h = np.zeros(1, _U)
            for w in hashes[row[owner[i]] : row[owner[i] + 1]]:
                h = mix(h * _U(5) + w + _U(1))
            out[i] = h[0]
    return out, to


def distinct_rows(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the first of each row."""
    if not len(values):
        return values, to
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((values, row)) if len(to) > 2 else np.argsort(values)
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(to)))
