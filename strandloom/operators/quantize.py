"""Lossy qualities: quantizers chosen by column and previous output, for a target distortion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .qualities import cond_counts

SYMBOLS = 72


def distortion(kind: str = "mse") -> np.ndarray:
    """Matrix of a named measure (l1, mse, lorentz), or of the file that ``kind`` names."""
    if kind not in ("l1", "mse", "lorentz"):
        return custom_distortion(kind)
    d = np.abs(np.arange(SYMBOLS)[:, None] - np.arange(SYMBOLS)[None, :]).astype(float)
    return {"l1": d, "mse": d * d, "lorentz": np.log2(1 + d)}[kind]


def custom_distortion(path: str) -> np.ndarray:
    """A square matrix of comma-separated numbers; lines with # are comments. Short or missing rows are an error."""
    with open(path) as f:
        rows = [[float(x) for x in line.split(",")] for line in f if line.strip() and not line.startswith("#")]
    if len(rows) != SYMBOLS or any(len(r) != SYMBOLS for r in rows):
        raise ValueError(f"a distortion matrix has {SYMBOLS} rows of {SYMBOLS} numbers")
    return np.array(rows)


def quantizer(pmf: np.ndarray, states: int, d: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Output symbol of each input for ``states`` intervals, by Lloyd's alternation from equal counts of used symbols."""
    used = np.flatnonzero(pmf > 0)
    if not len(used):
        return np.zeros(SYMBOLS, int)
    states = min(states, len(used))
    edge = [int(used[j * len(used) // states]) for j in range(states)] + [int(used[-1]) + 1]
    edge[0] = 0
    point = [0] * states
    for _ in range(rounds):
        old = list(point)
        for j in range(states):
            weight = pmf[edge[j] : edge[j + 1]] @ d[edge[j] : edge[j + 1]]
            point[j] = int(np.argmin(weight)) if pmf[edge[j] : edge[j + 1]].any() else edge[j]
        for j in range(1, states):
            x = np.arange(point[j - 1], point[j] + 1)
            nearer = d[x, point[j]] < d[x, point[j - 1]]
            edge[j] = int(x[np.argmax(nearer)]) if nearer.any() else point[j]
        if point == old:
            break
    out = np.zeros(SYMBOLS, int)
    for j in range(states):
        out[edge[j] : edge[j + 1] if j < states - 1 else SYMBOLS] = point[j]
    return out


def mixed(pmf: np.ndarray, target: float, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two quantizers and the share of the first, whose mean distortion is the target."""
    cost = lambda q: float((pmf * d[np.arange(SYMBOLS), q]).sum())
    low = quantizer(pmf, 1, d)
    if cost(low) <= target:
        return low, low, 1.0
    for states in range(2, SYMBOLS + 1):
        high = quantizer(pmf, states, d)
        if cost(high) <= target or states >= (pmf > 0).sum():
            a, b = cost(low), cost(high)
            return low, high, 0.0 if a <= b else min(1.0, max(0.0, (target - b) / (a - b)))
        low = high
    return low, low, 1.0


def _walk(counts: list, length: int, target: float, kind: str) -> Iterator[tuple[int, int, np.ndarray, float, np.ndarray, np.ndarray]]:
    """Column by column and by previous output (-1: none): share of reads by symbol that come there, share of the low quantizer, low and high outputs."""
    d = distortion(kind)
    table = np.zeros((length, SYMBOLS, SYMBOLS))
    first = np.zeros(SYMBOLS)
    for r in counts:
        if r["prev"] < 0:
            first[r["cur"]] += r["cnt"]
        else:
            table[r["col"], r["prev"], r["cur"]] += r["cnt"]
    joint = None
    for c in range(length):
        if c == 0:
            flows = {-1: first / max(first.sum(), 1)}
        else:
            given = table[c] / np.maximum(table[c].sum(axis=1, keepdims=True), 1)
            flows = {q: joint[:, q] @ given for q in np.flatnonzero(joint.sum(axis=0) > 0)}
        new = np.zeros((SYMBOLS, SYMBOLS))
        for q, flow in flows.items():
            if not flow.sum():
                continue
            low, high, share = mixed(flow / flow.sum(), target, d)
            share = int(128 * share) / 128
            yield c, int(q), flow, share, low, high
            x = np.arange(SYMBOLS)
            np.add.at(new, (x, low), flow * share)
            np.add.at(new, (x, high), flow * (1 - share))
        joint = new


def codebook(counts: list, length: int, target: float = 1.0, kind: str = "mse") -> dict[tuple[int, int], tuple[float, list[int], list[int]]]:
    """(column, previous output or -1) -> share of the low quantizer, low and high outputs.

    counts: rows col, prev, cur, cnt, at most SYMBOLS^2 a column.
    """
    return {(c, q): (share, low.tolist(), high.tolist()) for c, q, _, share, low, high in _walk(counts, length, target, kind)}


def entropy(counts: list, length: int, target: float, kind: str = "mse") -> float:
    """Bits a read that the codebook's outputs carry, each given the output before."""
    bits = 0.0
    for _, _, flow, share, low, high in _walk(counts, length, target, kind):
        out = np.bincount(low, flow * share, SYMBOLS) + np.bincount(high, flow * (1 - share), SYMBOLS)
        out = out[out > 0]
        bits -= float((out * np.log2(out / out.sum())).sum())
    return bits


def _counted(reads: DataFrame, offset: int) -> tuple[list, int]:
    """Conditional counts, at most SYMBOLS^2 a column, and the number of columns."""
    length = reads.agg(F.max(F.length("qua"))).first()[0] or 0
    return cond_counts(reads, offset).collect(), length


def train(reads: DataFrame, target: float = 1.0, kind: str = "mse", offset: int = 33) -> dict:
    """Codebook from all reads: their conditional counts are the only thing that is collected.

    kind: a named distortion or the path of a matrix (``distortion``).
    """
    counts, length = _counted(reads, offset)
    return codebook(counts, length, target, kind)


def train_for_bits(reads: DataFrame, bits: float, kind: str = "mse", offset: int = 33, steps: int = 12) -> tuple[dict, float, float]:
    """(codebook, its target distortion, its bits a read): the smallest distortion, found by bisection, whose outputs carry ``bits`` a read at most."""
    counts, length = _counted(reads, offset)
    low, high = 0.0, float(distortion(kind).max())
    if entropy(counts, length, low, kind) <= bits:
        high = low
    for _ in range(steps if high > low else 0):
        middle = (low + high) / 2 if low else high / 8  # the steep part is at small distortions
        if entropy(counts, length, middle, kind) <= bits:
            high = middle
        else:
            low = middle
    return codebook(counts, length, high, kind), high, entropy(counts, length, high, kind)


def codebook_rows(reads: DataFrame, book: dict) -> DataFrame:
    rows = [(c, q, share, low, high) for (c, q), (share, low, high) in sorted(book.items())]
    return reads.sparkSession.createDataFrame(rows, "col int, prev_out int, ratio double, q_lo array<int>, q_hi array<int>")


def quantized(read_id: Column, qua: Column, spark: SparkSession, book: dict, seed: int = 0, offset: int = 33) -> Column:
    """Qualities as quantized; the choice of quantizer hangs on (seed, read_id, column) alone."""
    length = 1 + max((c for c, _ in book), default=-1)
    low = np.tile(np.arange(SYMBOLS), (length, SYMBOLS + 1, 1))
    high, share = low.copy(), np.ones((length, SYMBOLS + 1))
    for (c, q), (s, a, b) in book.items():
        low[c, q], high[c, q], share[c, q] = a, b, s
    shared = spark.sparkContext.broadcast((low.astype(np.uint8), high.astype(np.uint8), share))

    @F.pandas_udf("string")
    def run(ids: pd.Series, quas: pd.Series) -> pd.Series:
        low, high, share = shared.value
        n = len(ids)
        size = quas.str.len().to_numpy()
        wide = int(size.max(initial=0))
        x = np.zeros((n, wide), np.int64)
        for i, s in enumerate(quas):
            x[i, : len(s)] = np.frombuffer(s.encode(), np.uint8).astype(np.int64) - offset
        prev = np.full(n, -1)
        out = x.copy()
        key = ids.to_numpy().astype(np.uint64)
        for c in range(min(wide, length)):
            with np.errstate(over="ignore"):
                h = (key * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((c + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) ^ np.uint64(seed)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            u = (h >> np.uint64(57)).astype(float) / 128  # seven bits
            now = x[:, c].clip(0, SYMBOLS - 1)
            out[:, c] = np.where(u >= share[c, prev], high[c, prev, now], low[c, prev, now])
            prev = out[:, c]
        text = (out + offset).astype(np.uint8)
        return pd.Series([text[i, : size[i]].tobytes().decode("latin-1") for i in range(n)], dtype=object)

    return run(read_id, qua)


def apply_codebook(reads: DataFrame, book: dict, seed: int = 0, offset: int = 33) -> DataFrame:
    """read_id, qua as ``quantized``."""
    return reads.select("read_id", quantized(F.col("read_id"), F.col("qua"), reads.sparkSession, book, seed, offset).alias("qua"))
