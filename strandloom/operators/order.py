"""Order and position: shuffles, first records, position steps, size masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import K
from .bins import beside


def shuffled(reads: DataFrame, seed: int = 0) -> DataFrame:
    """A random order that hangs on the seed and read_id alone."""
    return reads.orderBy(F.xxhash64("read_id", F.lit(seed)), "read_id")


def first_records(reads: DataFrame, n: int) -> DataFrame:
    """The first n by read_id (the operator is the limit itself)."""
    return reads.orderBy("read_id").limit(n)


def position_steps(binned: DataFrame) -> DataFrame:
    """read_id, step: distance of signature positions to the read before, by position within the bin."""
    w = Window.partitionBy("signature").orderBy("minim_pos", "read_id")
    return binned.select("read_id", (F.col("minim_pos") - F.lag("minim_pos", 1, 0).over(w)).alias("step"))


def in_sized_bins(binned: DataFrame, least: int, k: int = K) -> DataFrame:
    """Reads of bins with at least ``least`` reads, by a semi-join with the bin counts."""
    sizes = binned.groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return beside(binned, sizes, k, "left_semi")
