"""Language identification: blended-spectrum string kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import durable

#: Grams of 1 to SPECTRUM bytes are hashed to CELLS; their presence in a text is a row of CELLS bits.
SPECTRUM, CELLS = 4, 1 << 16
#: Most texts of a language to learn from, and landmarks over all languages (one of each at least).
SAMPLE, LANDMARKS = 500, 128
RIDGE, CHUNK, SUMS, ROWS = 1e-3, 1 << 20, 16, 128

_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[np.setdiff1d(np.arange(128), np.r_[97:123])] = 32


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def presence(column: pa.Array) -> np.ndarray:
    """For each text the cells of its grams, as bytes 0 and 1.

    Letters count in lower case; every stretch of ASCII bytes that are not
    letters, and each end of the text, counts as one space. A text is read
    CHUNK bytes at a time.
    """
    data, o = kernel.buffers(pc.utf8_lower(column))
    out = np.zeros((len(o) - 1, CELLS), np.uint8)
    flat = out.reshape(-1)
    tail = np.zeros(0, np.uint8)  # the last bytes of a text that goes on in the next part
    for a in range(0, len(data), CHUNK):
        b = min(len(data), a + CHUNK)
        rows = np.arange(np.searchsorted(o, a, "right") - 1, np.searchsorted(o, b))  # texts of this part
        rows = rows[o[rows] < o[rows + 1]]
        begun, goes_on = a > o[rows[0]], b < o[rows[-1] + 1]
        size = np.minimum(o[rows + 1], b) - np.maximum(o[rows], a) + 2
        row = np.repeat(rows, size)
        text = np.full(len(row), 32, np.uint8)
        at = np.cumsum(size) - size
        inner = np.ones(len(text), bool)
        inner[at] = inner[at + size - 1] = False
        text[inner] = _BYTE[data[a:b]]
        cut = slice(int(begun), len(text) - int(goes_on))
        text, row = np.append(tail, text[cut]), np.append(np.full(len(tail), rows[0]), row[cut])
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
        text, row = text[keep], row[keep]
        tail = text[1 - SPECTRUM :][row[1 - SPECTRUM :] == row[-1]] if goes_on else text[:0]
        text, row = text.astype(np.uint32), row * CELLS
        code = np.zeros(len(text), np.uint32)
        for n in range(min(SPECTRUM, len(text))):
            m = len(text) - n
            code = code[:m] | (text[n:] << np.uint32(8 * n))
            within = row[:m] == row[n:]
            cell = (code * np.uint32(2654435761)) >> np.uint32(16)
            flat[(row[:m] + cell)[within]] = 1
    return out


def _sample(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Rows (lang, place, bits) of up to SAMPLE different texts of each language, those with the smallest hashes."""
    known = docs.where(~held_out() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    known = known.withColumn("unit", F.pmod("hash", F.lit(1 << 40)) / float(1 << 40))
    rates = known.groupBy("lang").agg((1.2 * SAMPLE / F.approx_count_distinct("hash", 0.02)).alias("rate"))  # a row a language
    some = known.join(F.broadcast(durable(rates)), "lang").where("unit < rate").groupBy("lang", "unit", "hash").agg(F.min("text").alias("text"))
    ranked = some.select("lang", "text", F.expr("row_number() over (partition by lang order by unit, hash, text)").alias("place")).where(F.col("place") <= SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 2, rows=ROWS):
            bits = [np.packbits(p).tobytes() for p in presence(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["lang", "place", "bits"])

    return durable(ranked.select("lang", "place", "text").mapInArrow(run, "lang string, place int, bits binary"))


class Model:
    """Landmarks' presence over the cells that any of them has, and the coefficients of each language."""

    def __init__(self, langs: list[str], marks: np.ndarray):
        self.langs = langs
        self.cells = np.flatnonzero(marks.any(0))
        self.marks = (marks[:, self.cells] / np.sqrt(marks.sum(1, dtype=np.int64))[:, None]).T.astype(np.float32)
        self.weights = np.zeros((len(marks) + 1, len(langs)))

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Shared cells over the root of the product of both texts' numbers of cells, for all texts and landmarks; and a column of ones."""
        size = np.array([max(1, np.count_nonzero(r)) for r in x.view(bool)])
        k = x[:, self.cells].astype(np.float32) @ self.marks / np.sqrt(size)[:, None]
        return np.hstack([k, np.ones((len(x), 1))])

    def fit(self, square: np.ndarray, right: np.ndarray, n: float) -> None:
        """Ridge regression in the Nystroem features, which are the kernel values times the inverse root of the landmarks' own matrix."""
        own = (self.marks.T @ self.marks).astype(np.float64)
        value, vector = np.linalg.eigh(own)
        some = value > 1e-5 * value.max()
        root = np.zeros((len(own) + 1, int(some.sum()) + 1))
        root[:-1, :-1] = vector[:, some] / np.sqrt(value[some])
        root[-1, -1] = 1
        left = root.T @ square @ root
        left[np.diag_indices(len(left) - 1)] += RIDGE * n
        left[-1, -1] += 1e-9
        self.weights = root @ np.linalg.solve(left, root.T @ right)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language (the first on ties), and its regression value moved from -1..1 to 0..1."""
        f = self.kernel(x) @ self.weights
        best = f.argmax(1)
        return best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)


def _unpacked(bits) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(-1, CELLS)


def _fitted(docs: DataFrame, lang: str, text: str) -> Model | None:
    sample = _sample(docs, lang, text)
    langs = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    each = max(1, LANDMARKS // len(langs))
    marks = sample.where(F.col("place") <= each).orderBy("lang", "place").select("bits").collect()  # LANDMARKS rows of 8 KB
    model = Model(langs, _unpacked(r["bits"] for r in marks))
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, total = cast.value, None
        for f in frames:
            for a in range(0, len(f), ROWS):
                g = f[a : a + ROWS]
                k = m.kernel(_unpacked(g["bits"]))
                y = np.where(g["lang"].to_numpy()[:, None] == np.array(m.langs, object)[None, :], 1.0, -1.0)
                v = np.hstack([(k.T @ k).ravel(), (k.T @ y).ravel(), [len(k)]])
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for v in f["v"]:
                total = np.array(v) if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    parts = sample.select("lang", "bits").mapInPandas(moments, "v array<double>").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SUMS)))
    v = np.sum([np.array(r["v"]) for r in parts.repartition(SUMS, "g").select("v").mapInPandas(added, "v array<double>").collect()], axis=0)
    d = model.weights.shape[0]
    model.fit(v[: d * d].reshape(d, d), v[d * d : -1].reshape(d, len(langs)), v[-1])
    return model


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    The kernel of two texts is the number of grams of 1 to SPECTRUM bytes that
    both hold, over the root of the product of their own numbers. Whole texts
    are compared with landmarks, some sampled texts of each language, and the
    languages' ridge regressions on the Nystroem features of those kernel
    values decide. Learned from text and ``lang`` of rows that ``held_out`` does
    not name: of each language at most SAMPLE different texts, by hash of the
    text, so copies count once. A text that is null or has no letter is
    ``und`` with score 0; so is every text if nothing can be learned. Rows
    that repeat and null ids are predicted each. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = named.select("doc_id", held_out().alias("held_out"), "text", lettered.alias("lettered"))
    model = _fitted(named, "lang", "text")
    if model is None:
        return rows.select(F.col("doc_id").alias(doc_id), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in kernel.sliced(batches, 2, rows=ROWS):
            best, score = m.predict(presence(batch.column(2)))
            known = batch.column(3).to_numpy(zero_copy_only=False)
            names = pa.array([m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", doc_id)
