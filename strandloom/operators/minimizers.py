"""Signature assignment: the smallest valid k-mer of a read in either orientation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counting import letters
from ..functions.dna import K, code_text, revcomp


@lru_cache(maxsize=4)
def valid_codes(k: int) -> np.ndarray:
    """Which of the 4^k codes are signatures: not AAA or AAC in front, no AA from the second base on."""
    code = np.arange(4**k)
    digit = [(code >> 2 * (k - 1 - j)) & 3 for j in range(k)]
    bad = (digit[0] == 0) & (digit[1] == 0) & (digit[2] <= 1)
    for j in range(1, k - 1):
        bad |= (digit[j] == 0) & (digit[j + 1] == 0)
    return ~bad


#: Reads that are scanned at once: their codes stay in the processor's cache.
ROWS = 1024


def wall(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Base numbers (A, C, G, T: 0 to 3; N: 4; others: 5) of texts, a row each, padded with 6."""
    table = np.full(256, 5, np.uint8)
    table[[65, 67, 71, 84, 78]] = range(5)
    size = np.diff(offsets)
    out = np.full((len(size), int(size.max(initial=0))), 6, np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = table[data]
    return out


def kmer_numbers(bases: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """Codes of the k-mers at all places of rows of base numbers, or of their reverse complements; 4^k where one has another letter."""
    starts = bases.shape[1] - k + 1
    known = bases < 4
    number = np.where(known, 3 - bases if back else bases, 0).astype(np.int32 if k < 15 else np.int64)
    code, whole = np.zeros((len(bases), starts), number.dtype), np.ones((len(bases), starts), bool)
    for j in range(k - 1, -1, -1) if back else range(k):
        code <<= 2
        code |= number[:, j : j + starts]
        whole &= known[:, j : j + starts]
    code[~whole] = 4**k
    return code


def scan(data: np.ndarray, offsets: np.ndarray, k: int, skip: int, divisor: int = 1, other: np.ndarray | None = None, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Codes and positions of the smallest signatures of texts (letters and offsets) and of their reverse complements; 4^k and 0 for none."""
    good = valid_codes(k) & (np.arange(4**k) % divisor == 0)
    if allowed is not None:
        good &= allowed
    good = np.append(good, False)  # 4^k is no signature
    out = [np.zeros(len(offsets) - 1, np.int64) for _ in range(4)]
    for a in range(0, len(offsets) - 1, ROWS):
        o = offsets[a : a + ROWS + 1]
        bases, size = wall(data[o[0] : o[-1]], o), np.diff(o)
        if bases.shape[1] < k:
            bases = np.pad(bases, ((0, 0), (0, k - bases.shape[1])), constant_values=6)
        heavy = (bases == 4).sum(axis=1) >= size // 3
        wide, at = bases.shape[1], np.arange(bases.shape[1] - k + 1)
        stop = np.where(heavy, 0, size - k - skip)
        for i, back in ((0, False), (2, True)):
            code = kmer_numbers(bases, k, back)
            place = (size - k)[:, None] - at[None, :] if back else np.broadcast_to(at, code.shape)
            fit = good[code] & (place >= 0) & (place < stop[:, None])
            if other is not None:
                fit &= code != other[a : a + ROWS, None]
            best = np.where(fit, code * np.int64(wide) + place, 4**k * wide).min(axis=1)
            out[i][a : a + ROWS], out[i + 1][a : a + ROWS] = best // wide, best % wide
    return tuple(out)


def single_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``letters`` with a byte a character, so that places are those of characters."""
    data, offsets = letters(column)
    if (data < 128).all():
        return data, offsets
    return letters(pa.array([None if x is None else "".join(c if c < "\x80" else "?" for c in x) for x in column.to_pylist()], pa.string()))


FOUND = "f_code int, f_pos int, r_code int, r_pos int"


def smallest(seq: Column, k: int = K, skip: int = 0, divisor: int = 1, other: Column | None = None, allowed: np.ndarray | None = None) -> Column:
    """struct(f_code, f_pos, r_code, r_pos): the smallest valid k-mer of a read and of its reverse complement.

    Starts 0 <= i < length - k - skip are tried: the last possible start is not;
    the leftmost wins ties; 4^k stands for none, as for reads rich in N.
    ``divisor`` keeps codes that it divides, ``other`` leaves out one code,
    ``allowed`` (4^k booleans) all that it does not name.
    NumPy passes over the letters of an Arrow batch, many times as fast as array lambdas.
    """
    names = ["f_code", "f_pos", "r_code", "r_pos"]

    def found(s: pa.Array, o: np.ndarray | None) -> pa.Array:
        cells = scan(*single_bytes(s), k, skip, divisor, o, allowed)
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in cells], names=names)

    @F.arrow_udf(FOUND)
    def run(s: pa.Array) -> pa.Array:
        return found(s, None)

    @F.arrow_udf(FOUND)
    def run_without(s: pa.Array, o: pa.Array) -> pa.Array:
        return found(s, o.to_numpy(zero_copy_only=False).astype(np.int64))

    # so called, it stays one step: Spark would run it once for each filter that it moves below, and again above
    return run.asNondeterministic()(seq) if other is None else run_without.asNondeterministic()(seq, other)


def minimizer_se(reads: DataFrame, k: int = K, skip: int = 0) -> DataFrame:
    """Single-end reads with signature, sig_text, minim_pos, is_rev.

    The forward read wins ties. Where the reverse complement wins, seq and qua
    are stored reversed. Reads with no valid k-mer, too short or rich in N go
    to bin 4^k, as they are, at position 0.
    """
    df = reads.withColumn("_m", smallest(F.col("seq"), k, skip))
    rev = F.col("_m.r_code") < F.col("_m.f_code")
    df = df.withColumns({"signature": F.least("_m.f_code", "_m.r_code"), "minim_pos": F.when(rev, F.col("_m.r_pos")).otherwise(F.col("_m.f_pos")), "is_rev": rev}).drop("_m")
    turned = {"seq": F.when(F.col("is_rev"), revcomp(F.col("seq"))).otherwise(F.col("seq")), "qua": F.when(F.col("is_rev"), F.reverse("qua")).otherwise(F.col("qua"))}
    return df.withColumns({**turned, "sig_text": code_text(F.col("signature"), k)})


def flip_pair(df: DataFrame, when: Column) -> DataFrame:
    """Reverse complement of the whole pair: the mates also change places."""
    return df.withColumn("_w", when).withColumns(
        {
            "seq": F.when(F.col("_w"), revcomp(F.col("mate_seq"))).otherwise(F.col("seq")),
            "mate_seq": F.when(F.col("_w"), revcomp(F.col("seq"))).otherwise(F.col("mate_seq")),
            "qua": F.when(F.col("_w"), F.reverse("mate_qua")).otherwise(F.col("qua")),
            "mate_qua": F.when(F.col("_w"), F.reverse("qua")).otherwise(F.col("mate_qua")),
        }
    ).drop("_w")


def swap_mates(df: DataFrame, when: Column) -> DataFrame:
    return df.withColumn("_w", when).withColumns(
        {a: F.when(F.col("_w"), F.col(b)).otherwise(F.col(a)) for a, b in (("seq", "mate_seq"), ("mate_seq", "seq"), ("qua", "mate_qua"), ("mate_qua", "qua"))}
    ).drop("_w")


def minimizer_pe(pairs: DataFrame, k: int = K, skip: int = 0) -> DataFrame:
    """Read pairs with signature, sig_text, minim_pos, is_rev, is_swapped.

    Four candidates: both mates, forward and in the flipped pair. Ties go to the
    flipped pair and, within an orientation, to mate 2. A winning mate 2 is
    swapped to the front. Without any candidate: bin 4^k, as they are.
    """
    df = pairs.withColumns({"_1": smallest(F.col("seq"), k, skip), "_2": smallest(F.col("mate_seq"), k, skip)})
    # in order of preference among equal codes; the flipped pair's mate 1 is the complement of mate 2
    options = [("_1.r", True, True), ("_2.r", True, False), ("_2.f", False, True), ("_1.f", False, False)]
    cells = [F.struct(F.col(f"{x}_code").alias("code"), F.lit(i).alias("rank"), F.col(f"{x}_pos").alias("pos"), F.lit(rev).alias("rev"), F.lit(swapped).alias("swapped")) for i, (x, rev, swapped) in enumerate(options)]
    df = df.withColumn("_b", F.least(*cells))
    some = F.col("_b.code") < 4**k
    df = df.withColumns({"signature": F.col("_b.code"), "minim_pos": F.col("_b.pos"), "is_rev": some & F.col("_b.rev"), "is_swapped": some & F.col("_b.swapped")}).drop("_b", "_1", "_2")
    df = df.withColumn("sig_text", code_text(F.col("signature"), k))
    return swap_mates(flip_pair(df, F.col("is_rev")), F.col("is_swapped"))


def restored(df: DataFrame, paired: bool = False, when: Column | None = None) -> DataFrame:
    """Orientation as read from the instrument: un-swap, then un-flip (of the rows that ``when`` names, if given)."""
    of = lambda c: F.col(c) if when is None else when & F.col(c)
    if paired:
        return flip_pair(swap_mates(df, of("is_swapped")), of("is_rev"))
    return df.withColumns({"seq": F.when(of("is_rev"), revcomp(F.col("seq"))).otherwise(F.col("seq")), "qua": F.when(of("is_rev"), F.reverse("qua")).otherwise(F.col("qua"))})
