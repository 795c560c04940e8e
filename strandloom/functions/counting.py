"""Counts of symbols in string columns: array passes over Arrow batches, summed per task before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MOST = 1 << 20


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets; null is as an empty text."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def places(offsets: np.ndarray) -> np.ndarray:
    """Place of each letter within its text."""
    return np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], np.diff(offsets))


class Tally:
    """Counts by a whole-number key; ``full`` says when they should be handed on."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        k = np.sort(keys)
        first = np.flatnonzero(np.diff(k, prepend=-(1 << 62)))
        both = np.concatenate([self.keys, k[first]])
        counts = np.concatenate([self.counts, np.diff(np.append(first, len(k)))])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.diff(both, prepend=-(1 << 62)))
        self.keys, self.counts = both[first], np.add.reduceat(counts, first) if len(first) else counts

    @property
    def full(self) -> bool:
        return len(self.keys) > MOST


def tallied(batches: Iterator[pa.RecordBatch], keys, columns) -> Iterator[pa.RecordBatch]:
    """Batches of partial counts: ``keys`` makes the keys of a batch, ``columns`` the named columns of keys."""
    tally = Tally()

    def out() -> pa.RecordBatch:
        named = columns(tally.keys)
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in named.values()), pa.array(tally.counts)], names=[*named, "n"])

    for batch in batches:
        if batch.num_rows:
            tally.add(keys(batch))
        if tally.full:
            yield out()
            tally = Tally()
    if len(tally.keys):
        yield out()
