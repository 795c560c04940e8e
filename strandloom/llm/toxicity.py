"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees texts that are confirmed as toxic and unlabelled texts, never
texts as confirmed clean. The risk of a linear model on the presence of words
is pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), with the
logistic loss, so that the sigmoid of its output estimates a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import durable


STEM = 5


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _features(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of words, and of the first STEM bytes of longer ones."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    long_ = w.end - w.start > STEM
    start = w.start[long_]
    stem = np.zeros(len(start), np.uint64)
    factors = kernel.splitmix(STEM, 55) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(STEM):
            stem += kernel.LOWER[w.data[start + j]].astype(np.uint64) * factors[j]
    return np.concatenate([doc, doc[long_]]), np.concatenate([w.hash, kernel.mix(stem)])


def _presence(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of the distinct features of each document."""
    doc, hashes = _features(w)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def _hits(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document number, vocabulary index) of the words present; each pair once, by document."""
    n = len(vocabulary)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, h = _features(kernel.words(column, "letters"))
    at = np.minimum(np.searchsorted(vocabulary, h), n - 1)
    hit = vocabulary[at] == h
    pairs = np.unique(doc[hit] * n + at[hit])
    return pairs // n, pairs % n


def nnpu_risk(f: np.ndarray, positive: np.ndarray, times: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Of scores f: pi * R+(positives), R-(unlabelled) - pi * R-(positives), and the descent direction in f.

    The risk is the first plus what the second is above 0; where the second is
    negative, the direction raises it (Kiryo and others, 2017).
    """
    share = np.where(positive, prior * times / max(times[positive].sum(), 1), times / max(times[~positive].sum(), 1))
    p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    loss = np.logaddexp(0, f)
    reward = float((share * np.logaddexp(0, -f))[positive].sum())
    negative = float((share * loss)[~positive].sum() - (share * loss)[positive].sum())
    up = np.where(positive, (p - 1) * share, 0.0)
    down = np.where(positive, -p * share, p * share)
    return reward, negative, up + down if negative >= 0 else -down


def train_nnpu(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, times: np.ndarray | None = None, epochs: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with the least non-negative PU risk.

    rows: the present features of each row; positive: true for confirmed rows,
    the others are unlabelled; times: how often each row counts.
    """
    times = np.ones(len(rows)) if times is None else times
    lengths = np.array([len(r) for r in rows])
    index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, epochs + 1):
        g = nnpu_risk(np.bincount(owner, w[index], len(rows)) + b, positive, times, prior)[2]
        grad = np.append(np.bincount(index, g[owner], size) + decay * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 16000, words: int = 4096) -> tuple[np.ndarray, np.ndarray, float]:
    """Vocabulary (sorted feature hashes), weights and bias.

    docs: doc_id, text; labels: doc_id, toxic. Rows that ``held_out`` names are
    left out. The fit uses a bounded sample of whole texts: about ``positives``
    confirmed and ``unlabelled`` rows, chosen by hashes of the id and of the
    row, and at most ``words`` words that are more frequent in the confirmed
    ones. Of a confirmed id with many texts about as many are taken as of any
    other, an equal one once; unlabelled rows equal in id and text are chosen
    together and come to the driver as one row with their number. The prior is the share of toxic
    rows among all labelled rows of the training side. Without such rows the
    vocabulary is empty and every score is 0.
    """
    train = docs.where(~held_out())
    marks = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marks.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("p")).first()
    total, n, p = train.count(), counts["n"] or 0, int(counts["p"] or 0)
    if not p or not total:
        return np.zeros(0, np.uint64), np.zeros(0), -np.inf
    prior = min(max(p / n, 1e-4), 0.9)
    chance = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)
    # about ``positives`` ids: small enough to send to every task
    ids = F.broadcast(marks.where((F.col("toxic") == 1) & (chance("doc_id", F.lit("sample")) < positives / p)).select("doc_id"))
    texts = durable(train.join(ids, "doc_id").groupBy("doc_id").agg(F.count_distinct(F.xxhash64("text")).alias("texts")))
    quota = positives / max(texts.count(), 1)
    confirmed = train.join(F.broadcast(texts), "doc_id").where(chance("doc_id", "text", F.lit("row")) < F.lit(quota) / F.col("texts")).select("doc_id", "text").dropDuplicates()
    others = train.where(chance("doc_id", "text", F.lit("other")) < unlabelled / total)
    sample = confirmed.select("text", F.lit(1).alias("role"), F.lit(False).alias("as_unlabelled")).unionByName(others.select("text", F.lit(0).alias("role"), F.lit(True).alias("as_unlabelled")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 0):
            doc, h = _presence(kernel.words(batch.column(0), "letters"))
            role = batch.column(1).to_numpy(zero_copy_only=False)
            unl = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            u, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(np.bincount(at, role[doc], len(u)).astype(np.int64)), pa.array(np.bincount(at, unl[doc], len(u)).astype(np.int64))], names=["word", "p", "u"]
            )

    sample = durable(sample)
    sizes = sample.agg(F.sum("role").alias("p"), F.sum(F.col("as_unlabelled").cast("int")).alias("u")).first()
    n_p, n_u = max(sizes["p"] or 0, 1), max(sizes["u"] or 0, 1)
    found = sample.mapInArrow(count, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    excess = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt((F.col("u") + 1) / n_u / n_p)
    chosen = found.where("p >= 3").withColumn("z", excess).where("z > 2").orderBy(F.desc("z"), "word").limit(words)
    vocabulary = np.sort(np.array([r["word"] for r in chosen.select("word").collect()], np.int64).view(np.uint64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 0):
            doc, at = _hits(batch.column(0), vocabulary)
            parts = np.split(at, np.searchsorted(doc, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))], names=["role", "as_unlabelled", "at"])

    got = sample.mapInArrow(features, "role int, as_unlabelled boolean, at array<int>").groupBy("role", "as_unlabelled", "at").count().collect()
    seen = [(role, np.array(r["at"], np.int64), r["count"]) for r in got for role, on in ((True, r["role"] == 1), (False, r["as_unlabelled"])) if on]
    seen.sort(key=lambda x: (x[0], x[1].tolist()))
    positive, times = np.array([x[0] for x in seen], bool), np.array([x[2] for x in seen], float)
    weights, bias = train_nnpu([x[1] for x in seen], positive, len(vocabulary), prior, times)
    return vocabulary, weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: tuple[str, ...] = (), **sample) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, and the columns ``keep``.

    The score is a probability between 0 and 1 from the whole text alone. Null,
    empty and wordless texts get the score of a text without any known word.
    Rows that repeat are scored each; a null id is never held out and never
    labelled. Of several labels of an id, any toxic one counts. Other columns
    are not read unless ``keep`` names them.
    """
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    vocabulary, weights, bias = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where("doc_id is not null"), **sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 2):
            doc, at = _hits(batch.column(2), vocabulary)
            f = np.bincount(doc, weights[at], batch.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(f, -40, 40))) if np.isfinite(bias) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *keep])

    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("whole"), *keep).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int{carried}")
