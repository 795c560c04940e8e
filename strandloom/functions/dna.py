"""Column functions on bases, k-mers and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 8


def revcomp(seq: Column) -> Column:
    """Reverse complement over A, C, G, T, N."""
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def is_n_heavy(seq: Column) -> Column:
    """At least a third of the bases (rounded down) are N: such a read has no signature."""
    return n_count(seq) >= F.floor(F.length(seq) / 3)


def is_plain(seq: Column) -> Column:
    return F.instr(seq, "N") == 0


def kmer_code(kmer: Column, k: int = K) -> Column:
    """Base-4 number of a k-mer with A0 C1 G2 T3; 4^k if it has an N."""
    return F.when(is_plain(kmer), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("int")).otherwise(F.lit(4**k))


def code_text(code: Column, k: int = K) -> Column:
    """The k-mer of a code; N's for 4^k."""
    return F.when(code == 4**k, F.lit("N" * k)).otherwise(F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT"))


def code_revcomp(code: Column, k: int = K) -> Column:
    return kmer_code(revcomp(code_text(code, k)), k)


def is_valid_signature(kmer: Column) -> Column:
    """No N, not starting with AAA or AAC, and no AA from the second base on."""
    return is_plain(kmer) & ~kmer.like("AAA%") & ~kmer.like("AAC%") & (F.instr(F.substring(kmer, 2, 100), "AA") == 0)


def min_quality_at(qua: Column, pos: Column, k: int = K) -> Column:
    """Smallest quality byte of the k bases from 0-based pos."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.ascii(F.substr(qua, pos + i, F.lit(1)))))
