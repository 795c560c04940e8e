"""Tie rules, edge cases and round trips of single operators."""

import gzip
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna, phred
from strandloom.operators import codecs, contigs, headers, matching, minimizers, pairs, quantize
from strandloom.sources.fastq import read_fastq, write_fastq


def reads_of(spark, *seqs):
    return spark.createDataFrame([(i, f"@r.{i}", s, "I" * len(s)) for i, s in enumerate(seqs)], "read_id long, head string, seq string, qua string")


def test_signature_rules(spark):
    kmers = {"AAGTCCCC": True, "AAACCCCC": False, "AACTCCCC": False, "CAATCCCC": False, "ACGTACGT": True, "ACGTNCGT": False}
    df = spark.createDataFrame([(k,) for k in kmers], "k string").select("k", dna.is_valid_signature(F.col("k")).alias("v"), dna.code_text(dna.kmer_code(F.col("k"))).alias("t"))
    for r in df.collect():
        assert r["v"] is kmers[r["k"]]
        assert r["t"] == (r["k"] if "N" not in r["k"] else "N" * 8)
    assert minimizers.valid_codes(8).sum() == 46269


def test_single_end_minimizers(spark):
    only_last = "T" * 12 + "ACGTACGG"[:8]
    out = {r["read_id"]: r for r in minimizers.minimizer_se(reads_of(spark, "N" * 30, "N" * 10 + "ACGTCCGT" * 3, "N" * 9 + "ACGTCCGT" * 3, "ACGTACGT" * 3, "ACG", only_last)).collect()}
    assert out[0]["signature"] == out[4]["signature"] == 65536
    assert out[1]["signature"] != 65536 or (10 >= 34 // 3 and out[1]["signature"] == 65536)
    assert out[2]["signature"] != 65536
    assert not out[3]["is_rev"]  # equal minima: the forward read wins
    assert out[5]["sig_text"] != "ACGTACGG" or out[5]["is_rev"]  # the last start is not tried


def test_paired_ties_go_to_the_flipped_pair_and_mate_two(spark):
    s = "CCCCACGTACGTCCCC"
    df = spark.createDataFrame([(0, "@a", s, "I" * 16, s, "I" * 16)], "read_id long, head string, seq string, qua string, mate_seq string, mate_qua string")
    r = minimizers.minimizer_pe(df).first()
    assert r["is_rev"] and r["is_swapped"]
    back = minimizers.restored(minimizers.minimizer_pe(df), True).first()
    assert (back["seq"], back["mate_seq"]) == (s, s)


def test_quality_levels():
    assert [phred.level_8(q) for q in (0, 1, 2, 9, 10, 19, 20, 24, 25, 29, 30, 34, 35, 39, 40, 63)] == [0, 0, 6, 6, 15, 15, 22, 22, 27, 27, 33, 33, 37, 37, 40, 40]


def test_header_typing(spark):
    df = spark.createDataFrame([(0, "@a.007 0:x/1"), (1, "@a.8 5:/1"), (2, "@a.9 7:y/2")], "read_id long, head string")
    p = {r["field"]: r for r in headers.profile(df).collect()}
    assert p[0]["is_const"] and not p[1]["is_numeric"] and p[2]["is_numeric"] and not p[3]["is_numeric"]
    assert headers.pair_field(df).first()[0] == 4
    assert {(r[0], r[1]) for r in headers.roundtrip(df).collect()} == {(r[0], r[1]) for r in df.collect()}
    ragged = spark.createDataFrame([(0, "@a.1"), (1, "@a.1.only"), (2, "@a"), (3, "@a.1")], "read_id long, head string")
    assert headers.roundtrip(ragged.limit(0)).count() == 0
    assert {r[0] for r in headers.roundtrip(ragged).collect()} == {0, 1, 2, 3}


def test_codecs():
    rng = random.Random(1)
    for n in (0, 1, 252, 253, 254, 600):
        for p in (0.0, 0.3, 0.95, 1.0):
            flags = [rng.random() < p for _ in range(n)]
            assert codecs.rle_flags(codecs.rle_bytes(flags), n) == flags
            numbers = [0 if rng.random() < p else rng.choice([1, 250, 252, 253, 300, 65533, 65534, 70000]) for _ in range(n)]
            assert codecs.rle0_symbols(codecs.rle0_bytes(numbers)) == numbers


def test_nearest_predecessor_by_brute_force():
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([30, 34]))) for _ in range(40)]
    pos = np.array([rng.randrange(20) for _ in seqs])
    dist, shift, cost = matching.best_before(seqs, pos, 7)
    for i in range(len(seqs)):
        best = None
        for j in range(i - 1, max(-1, i - 8), -1):
            s = int(pos[j] - pos[i])
            a, b = seqs[i][max(-s, 0) :], seqs[j][max(s, 0) :]
            c = abs(s) + 2 * sum(x != y for x, y in zip(a, b))
            if best is None or c < best[0]:
                best = (c, i - j, s)
        if best:
            assert (cost[i], dist[i], shift[i]) == best


def test_contig_vote_order(spark):
    df = spark.createDataFrame([(i, b + "CGTACGTC", 1, 0) for i, b in enumerate("NTCGA")], "read_id long, seq string, minim_pos int, signature int")
    assert contigs.votes(df).where("col = -1").first()["base"] == "A"


def test_quantizer_reaches_the_target():
    pmf = np.zeros(72)
    pmf[[2, 10, 20, 30, 38]] = 0.2
    d = quantize.distortion("mse")
    low, high, share = quantize.mixed(pmf, 1.0, d)
    cost = lambda q: (pmf * d[np.arange(72), q]).sum()
    assert share * cost(low) + (1 - share) * cost(high) <= 1.0 + 1e-9


def test_quantized_reads_keep_the_mean_distortion(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "".join(chr(33 + q) for q in rng.integers(2, 41, 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "read_id long, qua string")
    out = quantize.apply_codebook(df, quantize.train(df)).toPandas().set_index("read_id")["qua"]
    d = [(ord(a) - ord(b)) ** 2 for i, q in rows for a, b in zip(q, out[i])]
    assert 0.5 < np.mean(d) < 1.2


def test_fastq_files(spark, tmp_path):
    text = "@a 1\nACGT\n+\n@III\n@b 2\r\nACGTA\r\n+x\r\nIIIII\r\n@c\nAC\n+\nII"
    (tmp_path / "a.fq").write_text(text, newline="")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@d\nGG\n+\nII\n")
    df = read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")])
    got = [(r["head"], r["seq"], r["qua"]) for r in df.orderBy("read_id").collect()]
    assert got == [("@a 1", "ACGT", "@III"), ("@b 2", "ACGTA", "IIIII"), ("@c", "AC", "II"), ("@d", "GG", "II")]
    write_fastq(df, str(tmp_path / "out"))
    again = read_fastq(spark, [str(p) for p in (tmp_path / "out").glob("part-*")])
    assert sorted(r["seq"] for r in again.collect()) == sorted(x[1] for x in got)
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nII\n@b\nAC\n+\nII\n")
    assert read_fastq(spark, [str(tmp_path / "bad.fq")]).where("bad is null").count() == 1
    with pytest.raises(Exception):
        read_fastq(spark, [str(tmp_path / "bad.fq")], mode="FAILFAST").collect()


def test_fastq_splits_and_pairs(spark, tmp_path):
    rng = random.Random(3)
    recs = [(f"@r.{i}/1", "".join(rng.choice("ACGT") for _ in range(30)), "".join(rng.choice("@+IJ") for _ in range(30))) for i in range(200)]
    for name in ("x.fq", "y.fq"):
        (tmp_path / name).write_text("".join(f"{h}\n{s}\n+\n{q}\n" for h, s, q in recs))
    df = read_fastq(spark, [str(tmp_path / "x.fq")], split_bytes=997)
    assert [(r["head"], r["seq"], r["qua"]) for r in df.orderBy("read_id").collect()] == recs
    two = read_fastq(spark, [str(tmp_path / "x.fq")], [str(tmp_path / "y.fq")])
    assert two.count() == 200 and two.where("seq <> mate_seq").count() == 0


def test_empty_tables(spark):
    empty = reads_of(spark).limit(0)
    assert minimizers.minimizer_se(empty).count() == 0
    assert matching.lz_nodes(minimizers.minimizer_se(empty)).count() == 0
    both = empty.withColumns({"mate_seq": F.col("seq"), "mate_qua": F.col("qua")})
    assert pairs.pair_matches(minimizers.minimizer_pe(both)).count() == 0
    assert isinstance(headers.profile(empty).toPandas(), pd.DataFrame)
