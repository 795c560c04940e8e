"""Bins: reads by signature, their statistics, size rules and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import K
from .minimizers import restored

#: Tables of up to so many bins are sent to all tasks.
MOST_BINS = 1 << 16


def bin_stats(binned: DataFrame) -> DataFrame:
    """Per bin: reads, reversed reads, bases, range of positions."""
    return binned.groupBy("signature", "sig_text").agg(
        F.count("*").alias("n_reads"), F.sum(F.col("is_rev").cast("long")).alias("n_reverse"), F.sum(F.length("seq").cast("long")).alias("raw_dna"), F.min("minim_pos").alias("min_pos"), F.max("minim_pos").alias("max_pos")
    )


def bin_lengths(binned: DataFrame) -> DataFrame:
    return binned.groupBy("signature").agg(F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"))


def _sizes(binned: DataFrame) -> DataFrame:
    """Bin sizes: at most 4^k + 1 rows."""
    return binned.groupBy("signature").agg(F.count("*").alias("bin_size"))


def beside(binned: DataFrame, per_bin: DataFrame, k: int = K, how: str = "inner") -> DataFrame:
    """Reads with their bin's row of ``per_bin``: at most 4^k + 1 rows, which go to the reads while these are few."""
    return binned.join(F.broadcast(per_bin) if 4**k <= MOST_BINS else per_bin, "signature", how)


def with_size(binned: DataFrame, k: int = K) -> DataFrame:
    """Adds bin_size by an aggregate and a join: rows of a bin need not meet in one task."""
    return beside(binned, _sizes(binned), k)


def large_bins(binned: DataFrame, least: int, k: int = K) -> DataFrame:
    return with_size(binned, k).where((F.col("bin_size") >= least) & (F.col("signature") != 4**k))


def small_to_n(binned: DataFrame, least: int = 8, k: int = K, paired: bool = False) -> DataFrame:
    """Reads of bins under ``least`` go to the N bin: orientation undone, position 0."""
    small = (F.col("bin_size") < least) & (F.col("signature") != 4**k)
    return as_n(with_size(binned, k), k, paired, small).drop("bin_size")


def as_n(binned: DataFrame, k: int = K, paired: bool = False, when: Column | None = None) -> DataFrame:
    """Reads of the N bin (those that ``when`` names, if given): orientation undone, position 0."""
    undone = {"is_swapped": F.lit(False)} if paired else {}
    undone |= {"is_rev": F.lit(False), "signature": F.lit(4**k), "sig_text": F.lit("N" * k), "minim_pos": F.lit(0)}
    return restored(binned, paired, when).withColumns({c: x if when is None else F.when(when, x).otherwise(F.col(c)) for c, x in undone.items()})


def small_and_n(binned: DataFrame, least: int, k: int = K) -> DataFrame:
    """The raw block: all reads of small bins and of the N bin, as read."""
    return small_to_n(binned, least, k).where(F.col("signature") == 4**k)


def bin_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per signature the reads before and after a re-binning."""
    b = before.groupBy("signature").agg(F.count("*").alias("n_in"))
    a = after.groupBy("signature").agg(F.count("*").alias("n_out"))
    joined = b.join(a, "signature", "full_outer").na.fill(0, ["n_in", "n_out"])
    return joined.select("signature", "n_in", "n_out", (F.col("n_out") - F.col("n_in")).alias("diff"))


def top_signatures(binned: DataFrame, n: int = 4) -> DataFrame:
    """The n most frequent signatures, the smaller first on ties."""
    return _sizes(binned).orderBy(F.desc("bin_size"), "signature").limit(n)


def auto_headers(binned: DataFrame, library: str | None = None) -> DataFrame:
    """Names made anew: '@<library or signature>.<number within the bin>'.

    Numbers follow the stored order with read_id last. The window sorts a bin
    in one task, by spilling; bins are bounded by the size rules above.
    """
    w = Window.partitionBy("signature").orderBy("read_id")
    name = F.col("sig_text") if library is None else F.lit(library)
    return binned.withColumn("head", F.concat(F.lit("@"), name, F.lit("."), F.row_number().over(w).cast("string")))
