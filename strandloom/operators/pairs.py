"""Mates: positional joins, signature sets, matching of second mates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import K, is_valid_signature
from .lineage import durable
from .matching import MISMATCH_COST, SHIFT_COST, best_before, order_of, whole_groups
from .minimizers import ROWS, kmer_numbers, single_bytes, valid_codes, wall


def zip_mates(first: DataFrame, second: DataFrame, on: str = "read_id") -> DataFrame:
    """Pairs by record ordinal; the name of mate 1 is kept."""
    mate = second.select(on, F.col("seq").alias("mate_seq"), F.col("qua").alias("mate_qua"))
    return first.join(mate, on)


SEPARATORS = " ._,=:/#-"


def read_number(head: Column) -> Column:
    """The number between the first and the second separator of a name; null if there is none."""
    between = F.regexp_extract(head, f"^[^{SEPARATORS}]*[{SEPARATORS}]([0-9]{{1,18}})(?:[{SEPARATORS}]|$)", 1)
    return F.when(between != "", between.cast("long"))


def by_number(first: DataFrame, second: DataFrame) -> DataFrame:
    """number, head, seq, qua, mate_seq, mate_qua, bad: pairs of two files that lack some records each, by the number in the names.

    Names of one file have different numbers. A record without a mate, or
    without a number, has bad set. Both files may be read in splits.
    """
    a = first.select(read_number(F.col("head")).alias("number"), "head", "seq", "qua")
    b = second.select(read_number(F.col("head")).alias("number"), F.col("head").alias("mate_head"), F.col("seq").alias("mate_seq"), F.col("qua").alias("mate_qua"))
    both = a.join(b, "number", "full_outer")
    bad = F.when(F.col("seq").isNull(), F.lit("no mate 1")).when(F.col("mate_seq").isNull(), F.lit("no mate 2"))
    return both.select("number", F.coalesce("head", "mate_head").alias("head"), "seq", "qua", "mate_seq", "mate_qua", bad.alias("bad"))


def replace_qualities(reads: DataFrame, qualities: DataFrame, on: str = "read_id") -> DataFrame:
    """Reads with the qualities of the record of the same ordinal; lengths must agree."""
    both = reads.join(qualities.select(on, F.col("qua").alias("_q")), on)
    return both.where(F.length("_q") == F.length("seq")).withColumn("qua", F.col("_q")).drop("_q")


def signatures(seq: Column, k: int = K) -> Column:
    """Sorted distinct valid k-mers."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k, F.lit(1))), lambda i: F.substr(seq, i, F.lit(k)))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: (F.length(x) == k) & is_valid_signature(x))))


def signature_difference(pairs: DataFrame, k: int = K) -> DataFrame:
    """read_id, only_mate: valid k-mers of mate 2 that mate 1 lacks, counted."""
    return pairs.select("read_id", _only_second(F.col("seq"), F.col("mate_seq"), k).alias("only_mate"))


def _only_second(first: Column, second: Column, k: int) -> Column:
    """Number of ``signatures`` of the second text that the first lacks; null if one is null."""
    good = np.append(valid_codes(k), False)

    def numbers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Codes of each row's signatures, 4^k in other places."""
        bases, size = wall(data, offsets), np.diff(offsets)
        if bases.shape[1] < k:
            return np.full((len(size), 1), 4**k)
        code = kmer_numbers(bases, k).astype(np.int64)
        code[~good[code] | (np.arange(code.shape[1]) >= np.where(size == k, 1, size - k)[:, None])] = 4**k
        return code

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        texts, out = [single_bytes(a), single_bytes(b)], np.zeros(len(a), np.int32)
        for at in range(0, len(a), ROWS):
            x, y = (numbers(d[o[at] : o[min(at + ROWS, len(a))]], o[at : at + ROWS + 1]) for d, o in texts)
            # both in order, a code of the first text before its equals of the second
            both = np.sort(np.concatenate([2 * x, 2 * y + 1], axis=1), axis=1)
            new = np.diff(both >> 1, axis=1, prepend=-1) != 0
            out[at : at + ROWS] = (new & (both & 1 == 1) & (both >> 1 < 4**k)).sum(axis=1)
        return pa.array(out, mask=np.asarray(pa.compute.or_(a.is_null(), b.is_null())))

    return run(first, second)


def alphabet_union(pairs: DataFrame) -> DataFrame:
    """One row a quality symbol in either mate, sorted."""
    each = lambda c: pairs.select(F.explode(F.array_distinct(F.split(c, ""))).alias("symbol")).distinct()
    return each("qua").unionByName(each("mate_qua")).where("symbol <> ''").distinct()


def has_signature(seq: Column, k: int = K) -> Column:
    """Whether ``signatures`` has any, by one pattern."""
    starts = F.when(F.length(seq) > k, F.substr(seq, F.lit(1), F.length(seq) - 1)).otherwise(seq)
    return starts.rlike(f"(?!AA[AC])[^N](?:(?!AA)[^N]){{{k - 2}}}[^N]")


def pair_matches(pairs: DataFrame, window: int = 4096, per_read: int = 4, k: int = K) -> DataFrame:
    """signature, rank, read_id, flag, parent_id, shift, cost of second mates.

    In the order of the bin each mate 2 offers its ``per_read`` smallest valid
    k-mers; earlier mates of the bin within ``window`` ranks that offered one
    of them are candidates, costed with that k-mer aligned (on equal costs the
    smaller k-mer, then the nearer mate). Up to two thirds of the length:
    Identical, ShiftOnly, FullEncode or FullExpensive (over 4 mismatches);
    otherwise Difficult. Mates meet by (signature, k-mer, block of ``window``
    ranks) with the block before in front, so a task holds a part of a bin.

    A mate equal to the one before it has that one as its match: nothing is
    cheaper, of a smaller k-mer or nearer. Of such a run only the first mate
    asks, and for others only the last one counts, the nearest of equal ones.
    """
    order = Window.partitionBy("signature").orderBy(*order_of(mate=True))
    std = pairs.where(F.col("signature") != 4**k).select("signature", "read_id", "seq", "minim_pos", "mate_seq", has_signature(F.col("mate_seq"), k).alias("offers"))
    same = lambda c: F.coalesce((c == F.col("mate_seq")) & F.col("offers"), F.lit(False))
    rows = std.select(
        "signature", F.row_number().over(order).alias("rank"), "read_id", "mate_seq", "offers",
        F.lag("read_id").over(order).alias("before"), same(F.lag("mate_seq").over(order)).alias("again"), same(F.lead("mate_seq").over(order)).alias("goes_on"),
    )
    end = F.col("offers") & ~(F.col("again") & F.col("goes_on"))
    rows = durable(rows.select("signature", "rank", "read_id", F.when(F.col("again"), F.col("before")).alias("before"), "goes_on", F.when(end, F.col("mate_seq")).alias("mate_seq")))
    # a run: its first rank and read, its last rank and read
    after = Window.partitionBy("signature").orderBy("rank")
    last = lambda c: F.when(F.col("goes_on"), F.lead(c).over(after)).otherwise(F.col(c))
    runs = rows.where("mate_seq is not null").select("signature", "rank", "read_id", "before", "mate_seq", last("rank").alias("last"), last("read_id").alias("last_id")).where("before is null")
    best = best_matches(runs, window, per_read, k)
    heads = rows.where("before is null").select("signature", "rank", "read_id").join(best, "read_id", "left").select("signature", "rank", "read_id", flag_of().alias("flag"), "parent_id", "shift", "cost")
    copies = rows.where("before is not null").select("signature", "rank", "read_id", F.lit("Identical").alias("flag"), F.col("before").alias("parent_id"), F.lit(0).alias("shift"), F.lit(0).alias("cost"))
    return heads.unionByName(copies)


def flag_of() -> Column:
    """What a mate's match is, from its shift and cost."""
    wrong = (F.col("cost") - F.abs("shift") * SHIFT_COST) / MISMATCH_COST
    return F.when(F.col("cost").isNull(), "Difficult").when(F.col("cost") == 0, "Identical").when(wrong == 0, "ShiftOnly").when(wrong > 4, "FullExpensive").otherwise("FullEncode")


def best_matches(runs: DataFrame, window: int = 4096, per_read: int = 4, k: int = K) -> DataFrame:
    """read_id, parent_id, shift, cost of the best match of mates, for those that have one, by the rules of ``pair_matches``.

    A row stands for a run of equal mates (signature, rank, read_id, mate_seq,
    last, last_id): its first asks, and matches of others are named by their last.
    """
    found = F.transform(F.slice(signatures(F.col("mate_seq"), k), 1, per_read), lambda s: F.struct(s.alias("kmer"), (F.instr(F.col("mate_seq"), s) - 1).alias("p")))
    index = durable(runs.withColumn("sigs", found)).select("signature", "rank", "read_id", "last", "last_id", "mate_seq", F.posexplode("sigs").alias("nth", "sig"))
    block = lambda c: F.expr(f"cast(({c} - 1) div {window} as int)")
    index = index.select("signature", "sig.kmer", "sig.p", "rank", "read_id", "last", "last_id", "mate_seq", "nth", block("rank").alias("own"))
    index = index.withColumn("block", F.explode(F.array_distinct(F.array("own", block("last"), block("last") + 1))))
    keys = ["signature", "kmer", "block"]

    def match(f: pd.DataFrame) -> pd.DataFrame:
        group = f.groupby(keys, sort=False).ngroup().to_numpy(np.int64)
        seqs, rank, ids = f["mate_seq"].tolist(), f["rank"].to_numpy(np.int64), f["read_id"].to_numpy()
        last, last_ids = f["last"].to_numpy(np.int64), f["last_id"].to_numpy()
        dist, shift, cost = best_before(seqs, f["p"].to_numpy(np.int64), len(f), group, rank, window, last, (f["own"] == f["block"]).to_numpy())
        limit = np.array([int(len(s) / 1.5) for s in seqs], np.int64)
        x = np.flatnonzero((f["own"] == f["block"]).to_numpy() & (dist > 0) & (cost <= limit))
        from_ = x - dist[x]
        return pd.DataFrame({"read_id": ids[x], "cost": cost[x].astype(np.int32), "nth": f["nth"].to_numpy()[x], "back": (rank[x] - last[from_]).astype(np.int32), "parent_id": last_ids[from_], "shift": shift[x].astype(np.int32)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(match, whole_groups(frames, keys))

    offers = index.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInPandas(run, "read_id long, cost int, nth int, back int, parent_id long, shift int")
    return offers.groupBy("read_id").agg(F.min(F.struct("cost", "nth", "back", "parent_id", "shift")).alias("b")).select("read_id", "b.parent_id", "b.shift", "b.cost")
