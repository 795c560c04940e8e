import time

import pytest
from pyspark.sql import functions as F

from strandloom.operators.bins import bin_stats, small_to_n
from strandloom.operators.minimizers import minimizer_se
from strandloom.sources.bins import read_bins, write_bins
from strandloom.sources.fastq import write_fastq
from strandloom.streaming.follow import follow_fastq, follow_reads, running_bins, tabbed
from strandloom.streaming.small_bins import PROVIDER, large_bins_stream, settled, waiting


def some_reads(spark):
    rows = [(i, f"@r.{i}", s, 'I"' * (len(s) // 2)) for i, s in enumerate(["ACGTACGTCCGT", "TTGCATGCATGC", "ACGTACGTCCGT", "N" * 12])]
    return spark.createDataFrame(rows, "read_id long, head string, seq string, qua string")


def test_running_bins_equal_batch_bins(spark, tmp_path):
    reads = some_reads(spark)
    tabbed(reads).write.text(str(tmp_path / "in"))
    q = running_bins(follow_reads(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bins_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["signature"], r["n_reads"]) for r in bin_stats(minimizer_se(reads)).collect()}
    assert {(r["signature"], r["n_reads"]) for r in spark.table("bins_now").collect()} == want


def test_bins_are_pruned(spark, tmp_path):
    binned = minimizer_se(some_reads(spark))
    write_bins(binned, str(tmp_path / "bins"))
    one = binned.where("signature <> 65536").first()["signature"]
    back = read_bins(spark, str(tmp_path / "bins"), one)
    assert back.count() == binned.where(f"signature = {one}").count()
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()


def many_reads(spark, n=400):
    bases = F.expr("transform(sequence(1, 30), i -> substr('ACGT', 1 + pmod(xxhash64(id % 40, i), 4), 1))")
    return spark.range(n).select(F.col("id").alias("read_id"), F.concat(F.lit("@r."), F.col("id")).alias("head"), F.array_join(bases, "").alias("seq"), F.expr("repeat('I', 30)").alias("qua")).where("read_id % 40 < 30 or read_id < 80")


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_small_bins_of_a_stream_equal_those_of_all_reads(rocks, tmp_path):
    reads = many_reads(rocks)
    columns = ["head", "seq", "qua", "signature", "minim_pos", "is_rev"]
    for part in range(2):
        write_fastq(reads.where(F.col("read_id") % 2 == part), str(tmp_path / "in"))
        run(large_bins_stream(minimizer_se(follow_fastq(rocks, str(tmp_path / "in")).drop("bad")), least=8), tmp_path)
    still = waiting(rocks, str(tmp_path / "state"))
    got = settled(rocks.read.parquet(str(tmp_path / "out")), still)
    want = small_to_n(minimizer_se(reads), 8)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert 0 < still.count() < reads.count() / 2


def test_reads_that_wait_too_long_go_to_the_n_bin(rocks, tmp_path):
    reads = many_reads(rocks).where("read_id < 100")
    bins = lambda: large_bins_stream(minimizer_se(follow_fastq(rocks, str(tmp_path / "in")).drop("bad")), least=8, idle_ms=1)
    for some in ("read_id < 99", "read_id = 99"):  # the last read finds those of other bins waiting for too long
        write_fastq(reads.where(some), str(tmp_path / "in"))
        run(bins(), tmp_path)
        time.sleep(0.1)
    out = rocks.read.parquet(str(tmp_path / "out"))
    assert out.where("to_n").count() > 0 and out.select("head").distinct().count() == out.count()
    assert out.count() + waiting(rocks, str(tmp_path / "state")).count() == reads.count()
    n = settled(out).where("signature = 65536")
    assert n.join(reads.select("head", F.col("seq").alias("was")), "head").where("seq <> was").count() == 0
