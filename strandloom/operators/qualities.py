"""Frequencies of bases and qualities, their conditional statistics and distortion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting


def base_freq(reads: DataFrame) -> DataFrame:
    """base, cnt: five sums in one pass, no row for each base."""
    sums = reads.agg(*(F.sum((F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long")).alias(b) for b in "ACGTN"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.coalesce(F.col(b), F.lit(0)).alias("cnt")) for b in "ACGTN"))).alias("x")).select("x.*").where("cnt > 0")


def symbols(reads: DataFrame, offset: int = 33) -> DataFrame:
    """col, prev (-1 in column 0), cur, n: partial counts of each quality after that of the column before, one row a task and value."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        data, o = counting.letters(batch.column(0))
        col = counting.places(o)
        prev = np.append(0, data[:-1]).astype(np.int64) + 1
        prev[col == 0] = 0
        return (col << 17) + (prev << 8) + data

    def named(k: np.ndarray) -> dict:
        prev = (k >> 8 & 511) - 1
        return {"col": (k >> 17).astype(np.int32), "prev": np.where(prev < 0, -1, prev - offset).astype(np.int32), "cur": ((k & 255) - offset).astype(np.int32)}

    return reads.select("qua").mapInArrow(lambda batches: counting.tallied(batches, keys, named), "col int, prev int, cur int, n long")


def qual_freq(reads: DataFrame, offset: int = 33) -> DataFrame:
    return symbols(reads, offset).groupBy(F.col("cur").alias("q")).agg(F.sum("n").alias("cnt"))


def cond_counts(reads: DataFrame, offset: int = 33) -> DataFrame:
    """count of quality cur in a column after quality prev in the column before."""
    return symbols(reads, offset).groupBy("col", "prev", "cur").agg(F.sum("n").alias("cnt"))


def marginals(counts: DataFrame) -> DataFrame:
    """Share of each quality in a column, from the conditional counts."""
    m = counts.groupBy("col", "cur").agg(F.sum("cnt").alias("n"))
    total = m.groupBy("col").agg(F.sum("n").alias("total"))
    return m.join(F.broadcast(total), "col").select("col", F.col("cur").alias("q"), (F.col("n") / F.col("total")).alias("p"))  # one row a column


def entropies(counts: DataFrame) -> DataFrame:
    """Bits of a column's quality distribution."""
    return marginals(counts).groupBy("col").agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


def divergences(counts: DataFrame) -> DataFrame:
    """Kullback-Leibler divergence, in bits, of each column's distribution from that of all columns."""
    m = marginals(counts)
    overall = counts.groupBy(F.col("cur").alias("q")).agg(F.sum("cnt").alias("n"))
    total = overall.agg(F.sum("n").alias("total"))
    base = overall.join(total).select("q", (F.col("n") / F.col("total")).alias("p0"))  # one row times the symbols
    return m.join(F.broadcast(base), "q").groupBy("col").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("p0"))).alias("kl"))


def mean_distortion(reads: DataFrame, mapped: Column, offset: int = 33) -> DataFrame:
    """Mean L1, squared and Lorentz distortion of a quality map."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return counting.letters(batch.column(0))[0].astype(np.int64) - counting.letters(batch.column(1))[0] + 256

    both = reads.select("qua", mapped.alias("m")).where(F.octet_length("qua") == F.octet_length("m"))
    d = both.mapInArrow(lambda batches: counting.tallied(batches, keys, lambda k: {"d": (k - 256).astype(float)}), "d double, n long")
    d = d.groupBy("d").agg(F.sum("n").alias("n"))
    mean = lambda x: F.sum(x * F.col("n")) / F.sum("n")
    return d.agg(mean(F.abs("d")).alias("l1"), mean(F.col("d") * F.col("d")).alias("mse"), mean(F.log2(1 + F.abs("d"))).alias("lorentz"))


def adaptive_bits(counts: DataFrame, context: list[str], symbol: str, alphabet: int) -> DataFrame:
    """context, n, bits: the size of the symbols under an adaptive model for each context.

    The model gives symbol s the share (times seen + 1/2) / (all seen +
    alphabet / 2); its code length hangs on the final counts alone:
    log2 of G(n + A/2) / G(A/2) * prod G(1/2) / G(c + 1/2). counts: context
    columns, symbol and cnt; a row of a context and symbol once.
    """

    @F.pandas_udf("double")
    def log_gamma(x: pd.Series) -> pd.Series:
        return x.map(math.lgamma)

    rows = counts.groupBy(*context, symbol).agg(F.sum("cnt").alias("cnt"))
    each = rows.withColumn("g", log_gamma(F.col("cnt") + 0.5) - math.lgamma(0.5))
    whole = each.groupBy(*context).agg(F.sum("cnt").alias("n"), F.sum("g").alias("g"))
    return whole.select(*context, "n", ((log_gamma(F.col("n") + alphabet / 2) - math.lgamma(alphabet / 2) - F.col("g")) / math.log(2)).alias("bits"))


def positioned(counts: DataFrame, length: int, parts: int = 8) -> DataFrame:
    """Conditional counts with the part of the read, 0 to parts - 1, that a column lies in."""
    return counts.withColumn("part", F.least(F.lit(parts - 1), F.floor(F.col("col") * parts / length)).cast("int"))
