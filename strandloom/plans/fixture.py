"""Reads derived from the orders table, since the driver's tables hold no FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"


def _genome(spark: SparkSession) -> DataFrame:
    parts = [F.translate(F.md5(F.concat(F.lit("g"), F.col("g").cast("string"), F.lit(f"-{i}")).cast("binary")), HEX, "ACGT" * 4) for i in range(16)]
    return spark.range(64).withColumnRenamed("id", "g").select("g", F.concat(*parts).alias("bases"))


def _put(seq: Column, at: Column, base: Column) -> Column:
    """seq with another base at 0-based at."""
    return F.concat(F.substr(seq, F.lit(1), at), base, F.substr(seq, at + 2))


def _quality(key: Column, tag: str) -> Column:
    parts = [F.translate(F.md5(F.concat(F.lit(tag), key.cast("string"), F.lit(f"-{i}")).cast("binary")), HEX, "#,/27:<=?@ACEFHI") for i in range(4)]
    return F.substring(F.concat(*parts), 1, 100)


def derived_reads(spark: SparkSession, sf_dir: str, paired: bool = False) -> DataFrame:
    """read_id, head, seq, qua and, if paired, mate_seq, mate_qua, mate_head.

    Two numbers an order become hundreds of letters, so a file of few splits
    is dealt out before; a task's reads are in order of their names.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    orders = orders.repartition("k").sortWithinPartitions("k")
    rows = orders.withColumn("g", F.col("c") % 64).join(F.broadcast(_genome(spark)), "g")  # 64 rows
    k, c = F.col("k"), F.col("c")
    at = lambda expr: expr.cast("int")
    rows = rows.withColumn("s0", F.substr("bases", at(k * 37 % 400 + 1), F.lit(100)))
    p, n = at(k * 13 % 100), at(k * 29 % 100)
    rows = rows.withColumn("s1", F.when(k % 7 == 0, _put(F.col("s0"), p, F.translate(F.substr("s0", p + 1, F.lit(1)), "ACGT", "CATG"))).otherwise(F.col("s0")))
    rows = rows.withColumn(
        "s2", F.when(k % 499 == 0, F.concat(F.lit("N" * 40), F.substr("s1", F.lit(41)))).when(k % 53 == 0, _put(F.col("s1"), n, F.lit("N"))).otherwise(F.col("s1"))
    )
    turned = lambda s: F.reverse(F.translate(s, "ACGTN", "TGCAN"))
    name = F.concat(F.lit("@RUN7."), (k + 1).cast("string"), F.lit(" L"), (c % 4 + 1).cast("string"), F.lit(":"), (k % 1000).cast("string"), F.lit("/"))
    out = [k.alias("read_id"), F.concat(name, F.lit("1")).alias("head"), F.when(k % 2 == 1, turned(F.col("s2"))).otherwise(F.col("s2")).alias("seq"), _quality(k, "q").alias("qua")]
    if paired:
        m = at(k * 17 % 100)
        rows = rows.withColumn("m0", F.substr("bases", at((k * 37 + 150) % 400 + 1), F.lit(100)))
        rows = rows.withColumn("m1", F.when(k % 61 == 0, _put(F.col("m0"), m, F.lit("N"))).otherwise(F.col("m0")))
        out += [F.when(k % 2 == 1, F.col("m1")).otherwise(turned(F.col("m1"))).alias("mate_seq"), _quality(k, "p").alias("mate_qua"), F.concat(name, F.lit("2")).alias("mate_head")]
    return rows.select(*out)
