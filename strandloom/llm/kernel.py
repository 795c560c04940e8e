"""Vectorised text kernels shared by the Python-side operators.

Arrow string columns are read as byte buffers, so a batch of documents is cut
into words and hashed with a few NumPy passes and without Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 1 << 20


def splitmix(n: int, seed: int = 0) -> np.ndarray:
    """n pseudo-random 64-bit numbers, made by a counter and ``mix``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit hashes: each bit of the result depends on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def _table(lower: bool) -> np.ndarray:
    """Byte -> 1..255, or 0 for the word separators 0x20 and 0x09-0x0D."""
    t = (np.arange(256) + 1).clip(max=255).astype(np.uint8)
    if lower:
        t[65:91] = t[97:123]
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return t


def _only(ascii_bytes: np.ndarray) -> np.ndarray:
    """As ``_table(True)``, with all ASCII bytes but the named ones as separators."""
    t = _table(True)
    t[np.setdiff1d(np.arange(128), ascii_bytes)] = 0
    return t


_TABLES = {False: _table(False), True: _table(True), "letters": _only(np.r_[65:91, 97:123]), "alnum": _only(np.r_[48:58, 65:91, 97:123])}
LOWER = _TABLES[True]
_MULT = splitmix(256, 77) | U64(1)


def _mult(n: int) -> np.ndarray:
    global _MULT
    if n > len(_MULT):
        _MULT = splitmix(max(n, 2 * len(_MULT)), 77) | U64(1)
    return _MULT


@dataclass
class Words:
    """Words of a batch: of document i those from first[i] to first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        """The bytes from word a up to word b, as they stand."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def words(column: pa.Array, lower: bool | str = False) -> Words:
    """Cut a string column into its words and hash each of them to 64 bits.

    lower: A-Z count as a-z; "letters": all letters in lower case, besides words end at ASCII punctuation and digits;
    "alnum": only at punctuation.
    """
    if isinstance(lower, str):
        column = pc.utf8_lower(column)
    data, o = buffers(column)
    table = _TABLES[lower]
    starts, ends, hashes = [], [], []
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SLICE)
        while b < n:  # move the cut behind the next separator or to the next document
            tail = np.flatnonzero(table[data[b : b + 4096]] == 0)
            k = np.searchsorted(o, b)
            doc = o[k] if k < len(o) else n
            if len(tail):
                b = min(b + int(tail[0]), int(doc))
                break
            if doc <= b + 4096:
                b = int(doc)
                break
            b = min(n, b + 4096)
        v = table[data[a:b]]
        full = v != 0
        edges = o[np.searchsorted(o, a) : np.searchsorted(o, b)] - a  # documents that start here
        before = np.empty(b - a, bool)
        before[0] = True
        np.logical_not(full[:-1], out=before[1:])
        before[edges] = True
        s = np.flatnonzero(full & before)
        after = np.empty(b - a, bool)
        after[-1] = True
        np.logical_not(full[1:], out=after[:-1])
        after[edges[edges > 0] - 1] = True
        e = np.flatnonzero(full & after) + 1
        if len(s):
            size = e - s
            at = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(at, size)
            with np.errstate(over="ignore"):
                part = v[full].astype(U64) * _mult(int(size.max()))[within]
            hashes.append(np.add.reduceat(part, at))
            starts.append(s + a)
            ends.append(e + a)
        a = b
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(o), np.int64))
    s = np.concatenate(starts)
    return Words(data, s, np.concatenate(ends), mix(np.concatenate(hashes)), np.searchsorted(s, o))


def symbols(w: Words) -> np.ndarray:
    """A number for each distinct word."""
    size = w.end - w.start
    offsets = np.append(0, np.cumsum(size))
    mark = np.zeros(len(w.data) + 1, np.int8)
    mark[w.start] += 1
    mark[w.end] -= 1
    flat = w.data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; k - 1 fewer than words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    m = splitmix(k, 1000 + seed) | U64(1)
    with np.errstate(over="ignore"):
        out = h[:n] * m[0]
        for j in range(1, k):
            out += h[j : j + n] * m[j]
    return mix(out)


def sliced(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has few rows and about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        at = 0
        _, o = buffers(batch.column(column))
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(o, o[at] + size, "right")) - 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
