"""Work and memory that must not grow with copies, bins or batches."""

import random
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import bins, lineage, matching, minimizers, pairs, rebin
from strandloom.plans import archive, fixture, oracle, queries

rng = random.Random(5)
FIELDS = "read_id long, head string, seq string, qua string, mate_seq string, mate_qua string"


def dna(n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_mates_need_no_search(spark):
    first, mates = dna(100), [dna(100) for _ in range(3)]
    rows = [(i, "@r", first, "I" * 100, mates[i % 3], "I" * 100) for i in range(24_000)]
    binned = minimizers.minimizer_pe(spark.createDataFrame(rows, FIELDS).repartition(4))
    began = time.time()
    got = pairs.pair_matches(binned).toPandas().sort_values(["signature", "rank"])
    assert time.time() - began < 40
    for _, part in got.groupby("signature"):
        again = (part["flag"] == "Identical").to_numpy()
        assert (part["parent_id"].to_numpy()[again] == part["read_id"].shift().to_numpy()[again]).all()
    assert len(got) == 24_000 and (got["flag"] != "Identical").sum() <= 3


def test_scan_holds_some_reads_at_once():
    data, offsets = minimizers.single_bytes(pa.array([dna(100) for _ in range(20_000)]))
    tracemalloc.start()
    found = minimizers.scan(data, offsets, 8, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and all(len(x) == 20_000 for x in found)
    alone = [minimizers.scan(*minimizers.single_bytes(pa.array([bytes(data[offsets[i] : offsets[i + 1]]).decode()])), 8, 0) for i in (0, 1023, 1024, 19_999)]
    assert [[int(x[0]) for x in y] for y in alone] == [[int(x[i]) for x in found] for i in (0, 1023, 1024, 19_999)]


def test_scan_counts_characters():
    assert [int(x[0]) for x in minimizers.scan(*minimizers.single_bytes(pa.array(["é一" + "ACGTCGTCCGT"])), 8, 0)][:2] == [int(x[0]) + d for x, d in zip(minimizers.scan(*minimizers.single_bytes(pa.array(["XX" + "ACGTCGTCCGT"])), 8, 0), (0, 0))][:2]


def test_bin_rules_read_twice_and_move_no_reads(spark):
    rows = [(i, "@r", dna(40), "I" * 40) for i in range(50)]
    binned = minimizers.minimizer_se(spark.createDataFrame(rows, FIELDS[: FIELDS.index(", mate_seq")]))
    for df in (bins.small_to_n(binned, 8), bins.large_bins(binned, 2), bins.small_and_n(binned, 8)):
        plan = optimized(df)
        assert plan.count("ArrowEvalPython") <= 2 and plan.count("rightHint=(strategy=broadcast)") == plan.count("Join")


@pytest.mark.parametrize("name", ["small_and_n_union", "small_bins_to_n", "bin_filter_min"])
def test_bin_rules_over_one_file(spark, tmp_path, name):
    folder = str(tmp_path / "orders.parquet")
    spark.range(6000).selectExpr("id * 7 as o_orderkey", "id * id % 1000 as o_custkey").coalesce(1).write.parquet(folder)
    df = queries.QUERIES[name](spark, str(tmp_path))
    plan = optimized(df)
    assert plan.count("ArrowEvalPython") == plan.count("RepartitionByExpression") == 2 and "Union" not in plan
    assert plan.count("rightHint=(strategy=broadcast)") == plan.count("Join")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{folder}/*.parquet'")
    wanted = con.execute(oracle.ORACLE[name]).df()[df.columns]
    got = df.toPandas()
    assert 0 < len(got) and sorted(got.itertuples(index=False, name=None)) == sorted(wanted.itertuples(index=False, name=None))


def test_pair_repeats_without_join(spark):
    rows = [(i, "@r", dna(40), "I" * 40, dna(40), "I" * 40) for i in range(50)]
    assert "Join" not in optimized(matching.pair_duplicates(minimizers.minimizer_pe(spark.createDataFrame(rows, FIELDS)), 8))


def test_signature_difference_on_odd_texts(spark):
    texts = ["", "ACGT", "ACGTCGTC", "ACGTCGTCA", "N" * 30, None, "ACGTNCGTCCGTACCGT", dna(60), dna(300), "acgtacgtacgt"]
    cells = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(cells, "read_id long, seq string, mate_seq string")

    def kmers(s):
        return {x for i in range(max(len(s) - 8, 1)) if len(x := s[i : i + 8]) == 8 and not set(x) - set("ACGT") and x[:3] not in ("AAA", "AAC") and "AA" not in x[1:]}

    got = {r["read_id"]: r["only_mate"] for r in pairs.signature_difference(df).collect()}
    assert got == {i: None if a is None or b is None else len(kmers(b) - kmers(a)) for i, a, b in cells}
    assert "ArrowEvalPython" in optimized(pairs.signature_difference(df))


def test_numbers_of_kmers_turned():
    bases = minimizers.wall(np.frombuffer(b"ACGTTGCAN", np.uint8), np.array([0, 9]))
    assert minimizers.kmer_numbers(bases, 2).tolist() == [[1, 6, 11, 15, 14, 9, 4, 16]]
    assert minimizers.kmer_numbers(bases, 2, True).tolist() == [[11, 6, 1, 0, 4, 9, 14, 16]]


def test_archive_of_equal_pairs(spark, tmp_path):
    first, mates = [dna(100) for _ in range(2)], [dna(100), dna(100)]
    rows = [(i, "@r", first[i % 2], "I" * 100, mates[i // 2 % 2], "I" * 100) for i in range(200)]
    reads = spark.createDataFrame(rows, FIELDS)
    tables = archive.pack(reads, archive.PROFILES["lossless"])
    archive.store(tables, str(tmp_path / "a"), archive.PROFILES["lossless"])
    assert sorted(map(tuple, archive.unpack(archive.load(spark, str(tmp_path / "a"))).select("read_id", "seq", "mate_seq").collect())) == [(r[0], r[2], r[4]) for r in rows]
    assert sum(r["n_reads"] for r in spark.read.parquet(str(tmp_path / "a/stats")).collect()) == 200


def test_lossy_qualities_without_join(spark):
    reads = spark.createDataFrame([(i, "@r", dna(40), "I" * 20 + "#" * 20) for i in range(50)], FIELDS[: FIELDS.index(", mate_seq")])
    assert "Join" not in optimized(archive.lossy(reads, archive.PROFILES["lossy"]))


def few_copied_reads(spark):
    texts = [dna(40) for _ in range(20)]
    return minimizers.minimizer_se(spark.createDataFrame([(i, "@r", texts[i % 20], "I" * 40) for i in range(60)], FIELDS[: FIELDS.index(", mate_seq")]))


def test_rebin_round_finds_signatures_once(spark):
    moved = rebin.rebin_round(few_copied_reads(spark), 2, window=8)
    assert "ArrowEvalPython" not in optimized(moved)
    assert sorted(r["read_id"] for r in moved.collect()) == list(range(60))


def test_prefix_search_matches_once(spark):
    binned = few_copied_reads(spark)
    assert optimized(matching.by_prefix(matching.lz_nodes(binned, 3), binned, 8)).count("MapInPandas") <= 2


def test_contigs_are_made_of_kept_reads(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(60)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("contig_growth", "contig_members_sound", "contig_position_steps"):
        assert "ArrowEvalPython" not in optimized(queries.QUERIES[name](spark, str(tmp_path)))
    assert "Repartition" in optimized(fixture.derived_reads(spark, str(tmp_path)))


def test_members_are_dealt_in_parts_of_bounded_size(spark, monkeypatch):
    reads = spark.createDataFrame([(i, "@r", dna(40), "I" * 40) for i in range(60)], FIELDS[: FIELDS.index(", mate_seq")])
    monkeypatch.setattr(archive, "PART", 10)
    tables = archive.pack(reads, archive.PROFILES["lossless"])
    assert optimized(tables["members"]).count("RepartitionByExpression") == 2
    assert sorted(tuple(r) for r in archive.unpack(tables).select("read_id", "seq").collect()) == sorted(tuple(r) for r in reads.select("read_id", "seq").collect())


def test_stream_sizes_read_members_once(spark):
    reads = spark.createDataFrame([(i, "@r", "ACGTCGTCCGTACCGTTGCA" * 2, "I" * 40) for i in range(60)], FIELDS[: FIELDS.index(", mate_seq")])
    tables = archive.pack(reads, archive.PROFILES["lossless"])
    sizes = archive.stream_sizes(tables)
    assert optimized(sizes).count("Join") == optimized(tables["members"]).count("Join") + optimized(tables["raw"]).count("Join")
    assert {r["stream"]: r["symbols"] for r in sizes.collect()}["qualities"] == 2400


def odd_pairs():
    """Copies of pairs and of either mate, pairs of the N bin and of small bins, texts of unequal length, empty and missing ones."""
    firsts, mates = [dna(60) for _ in range(3)], [dna(60) for _ in range(3)]
    rows = [(i, f"@r.{i} x/1", firsts[i % 3], "I" * 30 + "#" * 30, mates[i // 3 % 3], "5" * 60) for i in range(90)]
    rows += [(100 + i, "@n", "N" * 60, "#" * 60, "N" * 50, "#" * 50) for i in range(5)] + [(110, "@short", "ACGT", "IIII", "", ""), (111, "@small", dna(60), "I" * 60, dna(40), "I" * 40)]
    rows += [(200 + i, "@none", firsts[0], "I" * 60, None, None) for i in range(3)] + [(210 + i, "@cut", firsts[1][: 30 + i], "I" * (30 + i), mates[1][: 60 - i], "I" * (60 - i)) for i in range(20)]
    return rows


def check_pair_archive(spark, folder, p):
    """Rows of pairs come back; whole rows are not shuffled again, neither to be stored nor for either mate."""
    rows = [r for r in odd_pairs() if p.quality != "qvz" or r[5] is not None]  # quantizers take no missing texts
    reads = spark.createDataFrame(rows, FIELDS).repartition(3)
    scratch = f"{folder}/rows"
    tables = archive.pack(reads, p, scratch=scratch)
    assert not {"Join", "Repartition", "Window"} & set(optimized(tables["members"]).replace("\n", " ").split())
    archive.store(tables, f"{folder}/a", p)
    lineage.remove(spark, scratch)
    loaded = archive.load(spark, f"{folder}/a")
    back = archive.unpack(loaded)
    above = optimized(back).split("pair_id")[0]
    assert above.count("Join") == 1 and "Repartition" not in above
    order = lambda rows: sorted(map(tuple, rows), key=str)
    fields = reads.columns
    whole = order(back.select(*fields).collect())
    assert whole == order(archive.lossy(reads, p).select(*fields).collect()) and len(whole) == len(rows)
    middle = loaded["nodes"].where("kind = 'HARD'").agg({"signature": "max"}).first()[0]
    halves = [order(archive.unpack(archive.load(spark, f"{folder}/a", x)).select(*fields).collect()) for x in ((0, middle), (middle, 4**8))]
    assert all(halves) and order(halves[0] + halves[1] + [tuple(r) for r in loaded["raw"].select(*fields).collect()]) == whole


def test_lossless_archive_of_pairs(spark, tmp_path):
    check_pair_archive(spark, tmp_path, archive.PROFILES["lossless"])


def test_lossy_archive_of_pairs(spark, tmp_path):
    check_pair_archive(spark, tmp_path, archive.PROFILES["lossy"])


def test_reduced_archive_of_pairs(spark, tmp_path):
    check_pair_archive(spark, tmp_path, archive.PROFILES["reduced"])


def test_max_archive_of_pairs(spark, tmp_path):
    check_pair_archive(spark, tmp_path, archive.PROFILES["max"])


def test_thorough_archive_of_pairs(spark, tmp_path):
    check_pair_archive(spark, tmp_path, archive.thorough(archive.PROFILES["lossless"], 64))
