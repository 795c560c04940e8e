"""Binned reads from a folder that keeps receiving FASTQ lines, and running bin counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import K
from ..operators.minimizers import minimizer_se
from ..sources.fastq import FastqSource


def follow_reads(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Streaming reads from files of tab-separated records (read_id, head, seq, qua), as ``tabbed`` writes them.

    Files arrive whole, a record a line; each micro-batch is stateless and can
    be redone. ``follow_fastq`` reads FASTQ itself, from files that may grow.
    """
    return spark.readStream.schema("read_id long, head string, seq string, qua string").option("sep", "\t").option("quote", "").option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def follow_fastq(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Streaming reads from FASTQ files in a folder, which may grow and be joined by others: read_id, head, seq, qua, bad."""
    spark.dataSource.register(FastqSource)
    stream = spark.readStream.format("fastq").option("folder", folder)
    for k, v in options.items():
        stream = stream.option(k, str(v))
    return stream.load().drop("mate_seq", "mate_qua")


def tabbed(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat_ws("\t", "read_id", "head", "seq", "qua").alias("value"))


def running_bins(reads: DataFrame, k: int = K, skip: int = 0) -> DataFrame:
    """Reads and bases of each bin so far: state of at most 4^k + 1 rows, so no watermark is needed."""
    return minimizer_se(reads, k, skip).groupBy("signature").agg(F.count("*").alias("n_reads"), F.sum(F.length("seq").cast("long")).alias("raw_dna"))
