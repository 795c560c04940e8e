"""Column functions on quality strings: maps of one character to one character."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds and outputs of the eight-level binning.
LEVELS_8 = [(1, 0), (9, 6), (19, 15), (24, 22), (29, 27), (34, 33), (39, 37), (63, 40)]


def mapped(qua: Column, rule: Callable[[int], int], offset: int = 33, to_offset: int | None = None) -> Column:
    """Each quality 0..63 through a rule; one translate, no explosion of the string."""
    out = offset if to_offset is None else to_offset
    return F.translate(qua, "".join(chr(q + offset) for q in range(64)), "".join(chr(rule(q) + out) for q in range(64)))


def level_8(q: int) -> int:
    return next(out for top, out in LEVELS_8 if q <= top)


def illumina_8(qua: Column, offset: int = 33) -> Column:
    return mapped(qua, level_8, offset)


def binary(qua: Column, threshold: int = 20, offset: int = 33) -> Column:
    """40 from the threshold on, 6 below."""
    return mapped(qua, lambda q: 40 if q >= threshold else 6, offset)


def rebased(qua: Column, offset: int, to_offset: int) -> Column:
    return mapped(qua, lambda q: q, offset, to_offset)


def n_masked(seq: Column, qua: Column, value: int, offset: int = 33) -> Column:
    """Quality at each N replaced by one value, as after decoding of lossy modes."""
    i = F.sequence(F.lit(1), F.length(seq))
    each = F.transform(i, lambda p: F.when(F.substr(seq, p, F.lit(1)) == "N", F.lit(chr(value + offset))).otherwise(F.substr(qua, p, F.lit(1))))
    return F.when(F.instr(seq, "N") > 0, F.array_join(each, "")).otherwise(qua)
