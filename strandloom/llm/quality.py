"""Quality scores: random Fourier features, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import durable
from .toxicity import held_out

#: Bytes whose share of the text is a statistic.
GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"%$#&*@^~+=<>_", b"\"'()[]{}:;-/\\"]
N_STATS = len(GROUPS) + 9
FEATURES, GAMMA, RIDGE, BINS, SUMS = 256, 0.05, 1.0, 2048, 16


def statistics(column: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers for each text; zeros for a null or empty one."""
    data, o = kernel.buffers(column)
    n = len(o) - 1
    out = np.zeros((n, N_STATS))
    size = np.diff(o)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    for j, group in enumerate(GROUPS):
        table = np.zeros(256, np.uint8)
        table[list(group)] = 1
        out[some, j] = np.add.reduceat(table[data], o[some], dtype=np.int64) / size[some]
    w = kernel.words(column)
    words = np.diff(w.first)
    full = np.flatnonzero(words > 0)
    k = len(GROUPS)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(words)
    if len(full):
        at, m = w.first[:-1][full], words[full]
        length = (w.end - w.start).astype(float)
        mean = np.add.reduceat(length, at) / m
        out[full, k + 2] = mean
        out[full, k + 3] = np.sqrt(np.maximum(np.add.reduceat(length**2, at) / m - mean**2, 0))
        same = np.zeros(len(w.hash))
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[at] = 0
        out[full, k + 4] = np.add.reduceat(same, at) / m
        doc = np.repeat(np.arange(n), words)
        order = np.lexsort((w.hash, doc))
        d, h = doc[order], w.hash[order]
        new = np.ones(len(d))
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        out[full, k + 5] = np.add.reduceat(new, at) / m
        out[full, k + 6] = out[full, k + 5] * np.log1p(m)
        first = w.data[w.start]
        out[full, k + 7] = np.add.reduceat(((first >= 65) & (first <= 90)).astype(float), at) / m
        last = w.data[w.end - 1]
        out[full, k + 8] = np.add.reduceat(((last < 48) | (last > 57) & (last < 65)).astype(float), at) / m
    return out


def _waves() -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random Fourier features of exp(-GAMMA * |x - y|^2)."""
    rng = np.random.default_rng(8)
    return rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _design(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w, b = _waves()
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(stats), 1))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence next to ``value`` in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Statistics of the whole text are the only inputs. All labelled rows that
    ``held_out`` does not name are used: four fifths of them for the ridge fit,
    one fifth for the calibration, split by a hash of the id. The normal
    equations are summed per partition, then in SUMS groups. Null and empty
    texts have zero statistics and are scored from those. Rows that repeat are
    scored each; of several labels of an id the smallest counts; a null id is
    never labelled. Without labelled rows every score is 0.5. Other columns
    are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 2):
            s = statistics(batch.column(2))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), N_STATS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "held_out", "stats"])

    rows = durable(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(measure, f"doc_id {kind}, held_out boolean, stats array<double>"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    train = durable(rows.where("not held_out").join(marks, "doc_id").select("stats", "y", (fold == 0).alias("for_calibration")))

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s1, s2 = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for f in frames:
            if len(f):
                x = np.vstack(f["stats"])
                n, s1, s2 = n + len(x), s1 + x.sum(0), s2 + (x**2).sum(0)
        if n:
            yield pd.DataFrame({"v": [np.concatenate([[n], s1, s2])]})

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for f in frames:
            for v in f["v"]:
                out = np.array(v) if out is None else out + v
        if out is not None:
            yield pd.DataFrame({"v": [out]})

    def summed(parts: DataFrame) -> np.ndarray | None:
        """Sum of the partitions' vectors: in SUMS groups on executors, then of these here."""
        groups = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SUMS))).repartition(SUMS, "g").select("v").mapInPandas(total, "v array<double>").collect()
        return np.sum([np.array(r["v"]) for r in groups], axis=0) if groups else None

    m = summed(train.mapInPandas(moments, "v array<double>"))
    if m is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    mean = m[1 : 1 + N_STATS] / m[0]
    scale = np.sqrt(np.maximum(m[1 + N_STATS :] / m[0] - mean**2, 0)) + 1e-6

    def normal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = FEATURES + 1
        a, b = np.zeros((d, d)), np.zeros(d)
        for f in frames:
            if len(f):
                z = _design(np.vstack(f["stats"]), mean, scale)
                a += z.T @ z
                b += z.T @ f["y"].to_numpy()
        if a[-1, -1]:
            yield pd.DataFrame({"v": [np.concatenate([a.ravel(), b])]})

    d = FEATURES + 1
    v = summed(train.where("not for_calibration").select("stats", "y").mapInPandas(normal, "v array<double>"))
    if v is None:
        v = summed(train.select("stats", "y").mapInPandas(normal, "v array<double>"))
    penalty = RIDGE * np.eye(d)
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(v[: d * d].reshape(d, d) + penalty, v[d * d :])

    def raw(stats: np.ndarray) -> np.ndarray:
        return ((np.clip(_design(stats, mean, scale) @ beta, -0.5, 1.5) + 0.5) / 2 * (BINS - 1)).round().astype(np.int64)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"bin": raw(np.vstack(f["stats"])), "y": f["y"].to_numpy()})

    held = train.where("for_calibration").select("stats", "y").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if held:
        x, n = np.array([r["bin"] for r in held]), np.array([r["n"] for r in held], float)
        level = isotonic(np.array([r["y"] for r in held]) / n, n)
    else:
        x, level = np.arange(BINS), np.clip(np.arange(BINS) / (BINS - 1) * 2 - 0.5, 0, 1)
    # a rank within each step of the calibration keeps its order of scores, at a weight that moves no level by over 0.01
    curve = 0.99 * np.interp(np.arange(BINS), x, level) + 0.01 * np.arange(BINS) / (BINS - 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = curve[raw(np.asarray(batch.column(2).flatten()).reshape(-1, N_STATS))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
