"""The FASTQ source: equal rows for any split, pairs cut at equal records, streams, and the committed sink."""

import gzip
import pathlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import pairs
from strandloom.sources import fastq
from strandloom.sources.fastq import read_fastq, write_fastq, write_qualities
from strandloom.streaming.follow import follow_fastq


def damaged(seed, n=120):
    """A file's text, and its good records."""
    rng = random.Random(seed)
    text, good = [], []
    for i in range(n):
        size = rng.choice([0, 1, 30, 30, 30])
        head = f"@r.{i}/1" + rng.choice(["", " x@y", " +"])
        seq, qua = "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+IJ") for _ in range(size))
        end = rng.choice(["\n", "\n", "\r\n"])
        record = [head, seq, rng.choice(["+", "+" + head[1:]]), qua]
        kind = rng.random()
        if kind < 0.1 and size > 1:
            record.pop(rng.randrange(4))
        elif kind < 0.15 and size > 1:
            record[3] = record[3][1:]
        elif kind < 0.2 and size > 1:
            record[rng.randrange(4)] = "junk"
        elif kind < 0.25:
            record.insert(0, "")
            good.append((head, seq, qua))
        else:
            good.append((head, seq, qua))
        text += [x + end for x in record]
    return "".join(text), good


def whole(rows):
    return [(r["head"], r["seq"], r["qua"]) for r in rows if r["bad"] is None]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_damaged_files_give_the_same_rows_for_any_split(spark, tmp_path, monkeypatch, seed):
    text, good = damaged(seed)
    (tmp_path / "a.fq").write_text(text, newline="")
    with gzip.open(tmp_path / "a.fq.gz", "wt", newline="") as f:
        f.write(text)
    path = str(tmp_path / "a.fq")
    one = list(fastq.records(path))
    found = [(h, s, q) for _, h, s, q, bad in one if bad is None]
    assert set(good) <= set(found) and len(found) - len(good) <= 2  # two damaged neighbours may look like one whole record
    assert [r[0] for r in one] == sorted({r[0] for r in one})
    lines = Counter(x for x in text.replace("\r", "").split("\n") if x)
    kept = Counter(x for _, h, s, q, bad in one for x in (bad.split("\n") if bad is not None else [h, s, q]) if x)
    assert not kept - lines and sum(lines.values()) == sum(kept.values()) + len(found)  # the third lines are not kept
    for step in (11, 64):
        monkeypatch.setattr(fastq, "STEP", step)
        for split in (13, 977):
            parts = [r for a in range(0, len(text), split) for r in fastq.records(path, a, min(a + split, len(text)))]
            assert parts == one
    monkeypatch.setattr(fastq, "STEP", 4 << 20)
    for split in (200, 1 << 20):
        assert [tuple(r) for r in read_fastq(spark, [path], split_bytes=split).orderBy("read_id").collect()] == [(a, h, s, q, bad) for a, h, s, q, bad in one]
    assert whole(read_fastq(spark, [str(tmp_path / "a.fq.gz")]).orderBy("read_id").collect()) == found
    with pytest.raises(Exception):
        read_fastq(spark, [path], mode="FAILFAST").collect()


def test_one_lost_line_costs_one_record(spark, tmp_path):
    records = [f"@r.{i}\nACGT\n+\nIIII\n" for i in range(2000)]
    records[700] = records[700].replace("+\n", "")
    (tmp_path / "a.fq").write_text("".join(records))
    for split in (20_000, 50_000, 1 << 20):
        df = read_fastq(spark, [str(tmp_path / "a.fq")], split_bytes=split)
        assert df.where("bad is null").count() == 1999 and [r["bad"] for r in df.where("bad is not null").collect()] == ["@r.700\nACGT\nIIII"]


def test_trimmed_names_and_other_bytes(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(b"@a b c\nAC\n+\nII\n@\xe9 x\nGG\n+\nII\n@e\n\n+\n")
    got = read_fastq(spark, [str(tmp_path / "a.fq")], trim="true").orderBy("read_id").collect()
    assert whole(got) == [("@a", "AC", "II"), ("@\xe9", "GG", "II"), ("@e", "", "")]
    (tmp_path / "none.fq").write_text("")
    assert read_fastq(spark, [str(tmp_path / "none.fq")]).count() == 0


@pytest.mark.parametrize("name,lost", [("@run.{n} x/{m}", True), ("@run.{n} x/{m}", False), ("@lane x{m}", False)])
def test_large_pairs_are_cut_at_equal_records(spark, tmp_path, name, lost):
    rng = random.Random(4)
    numbers = list(range(1, 1500))
    one, two = ([n for n in numbers if not lost or rng.random() > 0.05] for _ in range(2))
    record = lambda n, m: f"{name.format(n=n, m=m)}\n{'ACGT'[n % 4] * (5 + n % 7)}{m}\n+\n{'I' * (6 + n % 7)}\n"
    (tmp_path / "a.fq").write_text("".join(record(n, 1) for n in one))
    (tmp_path / "b.fq").write_text("".join(record(n, 2) for n in two))
    files = [str(tmp_path / "a.fq")], [str(tmp_path / "b.fq")]
    alone = sorted(map(tuple, read_fastq(spark, *files, split_pairs=False).collect()))
    split = read_fastq(spark, *files, split_bytes=3000)
    assert sorted(map(tuple, split.collect())) == alone and len({r[0] for r in alone}) == len(alone)
    assert split.rdd.getNumPartitions() > 10
    got = {r[0]: (r[2], r[4], r[6]) for r in alone}
    if lost:
        assert sum(x[2] is None for x in got.values()) == len(set(one) & set(two)) and len(got) == len(set(one) | set(two))
    else:
        assert all(a[:-1] == b[:-1] and a[-1] == "1" and b[-1] == "2" for a, b, _ in got.values()) and len(got) == len(numbers)
    assert all((r["seq"], r["mate_seq"], r["bad"]) in set(got.values()) for r in pairs.by_number(*(read_fastq(spark, f) for f in files)).collect()) or not lost


def test_stream_equals_batch_while_files_grow(spark, tmp_path):
    text, _ = damaged(7, 120)
    text = text.rstrip("\r\n") + "\n@end\nA\n+\nI\n"
    folder = tmp_path / "in"
    folder.mkdir()
    query = lambda: (
        follow_fastq(spark, str(folder), split_bytes=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    )
    b = folder / "b.fq"
    for cut in (1, 333, 1000, 2500, len(text)):
        b.write_text(text[:cut], newline="")
        if cut == 1000:
            (folder / "a.fq").write_text("@x\nAC\n+\nII\n")
        query()
    got = sorted((r["head"], r["seq"], r["qua"], r["bad"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["bad"] is None)
    want = sorted((r["head"], r["seq"], r["qua"], r["bad"]) for r in read_fastq(spark, [str(folder)]).collect() if r["bad"] is None)
    assert got == want and len(want) > 80
    ids = [r["read_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(ids) == len(set(ids)) == read_fastq(spark, [str(folder)]).count()


def some(spark, n=500, parts=3):
    rows = spark.range(n).repartition(parts).select(F.col("id").alias("read_id"), F.concat(F.lit("@r."), F.col("id"), F.lit("/1")).alias("head"), F.expr("repeat('ACGT', 1 + id % 5)").alias("seq"), F.expr("repeat('@+II', 1 + id % 5)").alias("qua"))
    return rows.withColumns({"mate_head": F.concat(F.lit("@r."), F.col("read_id"), F.lit("/2")), "mate_seq": F.reverse("seq"), "mate_qua": F.reverse("qua"), "extra": F.lit(1)})


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_sink_round_trip(spark, tmp_path, compression):
    rows = some(spark)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write_fastq(rows, one, two, compression=compression)
    assert sorted(p.name for p in pathlib.Path(one).iterdir()) == sorted(p.name for p in pathlib.Path(two).iterdir()) and len(list(pathlib.Path(one).iterdir())) == 3
    names = ["head", "seq", "qua", "mate_seq", "mate_qua"]
    back = read_fastq(spark, [one], [two], split_bytes=2000)
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, rows.select(*names).collect())) and back.where("bad is not null").count() == 0
    write_fastq(rows.limit(10), one, mode="overwrite", compression=compression)
    write_fastq(rows.limit(5), one, compression=compression)
    assert read_fastq(spark, [one]).count() == 15
    write_qualities(rows, str(tmp_path / "q"), str(tmp_path / "q2"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "q").iterdir()))
    assert sorted(text.split()) == sorted(r["qua"] for r in rows.collect()) and len(list((tmp_path / "q2").iterdir())) == 3
    write_fastq(rows.limit(0), str(tmp_path / "none"))
    assert read_fastq(spark, [str(tmp_path / "none")]).count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    rows = some(spark, 900)
    one, two = tmp_path / "one", tmp_path / "two"
    write_fastq(rows.limit(7), str(one), str(two))
    held = {p: p.read_bytes() for f in (one, two) for p in f.iterdir()}
    broken = rows.withColumn("mate_qua", F.when(F.col("read_id") == 700, F.lit("I")).otherwise(F.col("mate_qua")))
    for bad in (broken, rows.withColumn("seq", F.when(F.col("read_id") != 3, F.col("seq")))):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception):
                write_fastq(bad, str(one), str(two), mode=mode)
            assert {p: p.read_bytes() for f in (one, two) for p in f.iterdir()} == held


def test_a_split_reads_little_beside_itself(tmp_path, monkeypatch):
    path = tmp_path / "a.fq"
    path.write_text("".join(f"@r.{i}\n{'ACGT' * 25}\n+\n{'I' * 100}\n" for i in range(40_000)))
    seen = []
    plain = fastq._stream

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            data = self.f.read(n)
            seen.append(len(data))
            return data

        __enter__, __exit__ = lambda self: self, lambda self, *_: None

    monkeypatch.setattr(fastq, "_stream", lambda p, a: Counted(plain(p, a)))
    got = sum(b.num_rows for b in fastq.batches(str(path), 1 << 20, (1 << 20) + (1 << 18)))
    assert got > 1000 and sum(seen) < 2 << 18


def test_steps_of_batches_are_those_of_records():
    import random

    import pyarrow as pa

    rng = random.Random(3)

    def batch(numbers):
        head = ["@odd" if x is None else f"@r.{x} a" for x in numbers]
        return pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int64()), *[pa.array(head, pa.string())] * 4], names=["at", "head", "seq", "qua", "bad"])

    def cut(numbers):
        while numbers:
            n = rng.randint(0, 5)
            yield batch(numbers[:n])
            numbers = numbers[n:]

    def plain(x, y):
        while x or y:
            if x and y and (x[0] is None or y[0] is None or x[0] == y[0]):
                yield x.pop(0), y.pop(0)
            elif x and (not y or x[0] < y[0]):
                yield x.pop(0), "none"
            else:
                yield "none", y.pop(0)

    for _ in range(300):
        x, y = (sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(2))
        x, y = ([None if rng.random() < 0.05 else i for i in z] for z in (x, y))
        found = []
        for a, b in fastq.in_step(cut(list(x)), cut(list(y))):
            names = [["none"] * (a or b).num_rows if c is None else [fastq.number_of(h) for h in c.column(1).to_pylist()] for c in (a, b)]
            found += zip(*names, strict=True)
        assert found == list(plain(list(x), list(y)))


def test_mates_are_indexed_in_one_job_and_read_up_to_their_end(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / str(n)).mkdir()
        for f in range(3):
            (tmp_path / str(n) / f"{f}.fq").write_text("".join(f"@r.{f * 1000 + i} x/{n}\nACGT\n+\nIIII\n" for i in range(1000)))
    spark.dataSource.register(fastq.FastqSource)
    group = "mates-in-one-job"
    spark.sparkContext.setJobGroup(group, group)
    cuts = fastq.pair_cuts(spark, str(tmp_path / "1"), str(tmp_path / "2"), 4096)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    assert sorted(cuts) == ["0", "1", "2"] and all(p["mate_stop"] - p["mate_start"] <= 3 * 4096 for c in cuts.values() for p in c[:-1])
    rows = fastq.read_fastq(spark, [str(tmp_path / "1")], [str(tmp_path / "2")], split_bytes=4096).collect()
    assert len(rows) == 3000 and all(r["bad"] is None for r in rows) and len({r["head"] for r in rows}) == 3000
