"""Run-length codes of match flags and of small numbers."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A full run is the byte 255, a run of n matches is n + 2.
FULL, SHIFT = 255, 2


def rle_bytes(flags: Iterable[bool]) -> bytes:
    """Runs of matches as n + 2 (255: 253 and no end), a mismatch that ends no run as 0."""
    out, run = bytearray(), 0
    for f in flags:
        if f:
            run += 1
            if run == FULL - SHIFT:
                out.append(FULL)
                run = 0
        elif run:
            out.append(run + SHIFT)
            run = 0
        else:
            out.append(0)
    if run:
        out.append(run + SHIFT)
    return bytes(out)


def rle_flags(data: bytes, n: int) -> list[bool]:
    """The n flags of ``rle_bytes``."""
    out: list[bool] = []
    for b in data:
        if b == 0:
            out.append(False)
        else:
            out += [True] * (b - SHIFT)
            if b != FULL:
                out.append(False)
    return out[:n]


def rle0_bytes(symbols: Iterable[int]) -> bytes:
    """A byte 0 for each two zeros of a run and a byte 1 for an odd one; s > 0 as s + 1 in 8 bits, or 254 and 16, or 255 and 32 bits."""
    out, zeros = bytearray(), 0

    def flush() -> None:
        nonlocal zeros
        out.extend(bytes(zeros // 2) + b"\1" * (zeros % 2))
        zeros = 0

    for s in symbols:
        if s == 0:
            zeros += 1
            continue
        flush()
        x = s + 1
        out.extend([x] if x < 254 else [254, *x.to_bytes(2, "big")] if x < 65535 else [255, *x.to_bytes(4, "big")])
    flush()
    return bytes(out)


def rle0_symbols(data: bytes) -> list[int]:
    out: list[int] = []
    i = 0
    while i < len(data):
        b = data[i]
        if b < 2:
            out += [0] * (2 - b)
            i += 1
            continue
        wide = {254: 2, 255: 4}.get(b, 0)
        out.append((int.from_bytes(data[i + 1 : i + 1 + wide], "big") if wide else b) - 1)
        i += 1 + wide
    return out


def match_runs(matches: DataFrame) -> DataFrame:
    """From read_id, flags (array<boolean>): read_id, start, is_match, n of the runs, within each row."""
    n = F.size("flags")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("flags", i) != F.get("flags", i - 1)))
    rows = matches.select("read_id", "flags", starts.alias("starts")).withColumn("ends", F.array_append(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), n))
    runs = rows.select("read_id", "flags", F.explode(F.arrays_zip("starts", "ends")).alias("run")).where("run.starts is not null")
    return runs.select("read_id", F.col("run.starts").alias("start"), F.get("flags", F.col("run.starts")).alias("is_match"), (F.col("run.ends") - F.col("run.starts")).cast("long").alias("n"))


def match_flags(nodes: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, flags: equal bases over the overlap of an LZ read and its parent."""
    own = reads.select("read_id", "seq")
    up = reads.select(F.col("read_id").alias("parent_id"), F.col("seq").alias("parent_seq"))
    rows = nodes.where("node_type = 'LZ'").join(own, "read_id").join(up, "parent_id")
    off, lz = F.greatest(-F.col("shift"), F.lit(0)), F.greatest(F.col("shift"), F.lit(0))
    n = F.least(F.length("seq") - off, F.length("parent_seq") - lz)
    flags = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("seq", off + i, F.lit(1)) == F.substr("parent_seq", lz + i, F.lit(1)))
    return rows.select("read_id", flags.alias("flags"))


def rle0_streams(distances: DataFrame) -> DataFrame:
    """From signature, rank, lz_id: signature, n_symbols and the coded stream of each bin."""

    def code(f: pd.DataFrame) -> pd.DataFrame:
        data = rle0_bytes(f.sort_values("rank")["lz_id"].tolist())
        return pd.DataFrame({"signature": [f["signature"].iat[0]], "n_symbols": [len(f)], "stream": [data]})

    return distances.groupBy("signature").applyInPandas(code, "signature int, n_symbols long, stream binary")
