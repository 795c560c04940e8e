"""Order within bins, exact duplicates and the cheapest overlapping predecessor."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import K
from .lineage import durable

BLOCK = 8192
SHIFT_COST, MISMATCH_COST, MAX_SHIFT = 1, 2, 127


def order_of(mate: bool = False) -> list[Column]:
    """Bases from the signature on, then backwards from it, then read_id."""
    whole = F.concat("seq", "mate_seq") if mate else F.col("seq")
    return [F.substr(whole, F.col("minim_pos") + 1), F.reverse(F.substr("seq", F.lit(1), F.col("minim_pos") + 1)), F.col("read_id")]


def ranked(binned: DataFrame, mate: bool = False) -> DataFrame:
    """Adds rank (from 1) within the bin: an external sort of each bin on the JVM."""
    return binned.withColumn("rank", F.row_number().over(Window.partitionBy("signature").orderBy(*order_of(mate))))


def duplicates(binned: DataFrame) -> DataFrame:
    """signature, seq, minim_pos, read_id (the first) and n_copies of equal reads (single-end)."""
    return binned.groupBy("signature", "seq", "minim_pos").agg(F.min("read_id").alias("read_id"), F.count("*").alias("n_copies"))


def pair_duplicates(pairs: DataFrame, window: int = 4096, k: int = K) -> DataFrame:
    """signature, rank, read_id, first_id of all pairs outside the N bin: the read whose first mate a pair repeats within the window, else its own.

    In the order of both mates, pairs with equal first mates need not be
    neighbours. A pair repeats one whose first mate has the same bases and
    position and which is among the last ``window`` - 1 pairs that repeat
    none. A bin is scanned in order; a task holds the window's numbers only.
    """
    return _pair_repeats(pairs, window, k).select("signature", "rank", "read_id", "first_id")


def _pair_repeats(pairs: DataFrame, window: int, k: int) -> DataFrame:
    """``pair_duplicates`` with seq, minim_pos and mate_seq of the reads that repeat none.

    Neighbours with equal first mates repeat the same read, so the scan steps
    from the first of such a run to the next, and only these take their bases
    along.
    """
    order, after = Window.partitionBy("signature").orderBy(*order_of(mate=True)), ["seq", "minim_pos"]
    std = pairs.where(F.col("signature") != 4**k).select("signature", "seq", "minim_pos", "mate_seq", "read_id")
    same = F.coalesce((F.lag("seq").over(order) == F.col("seq")) & (F.lag("minim_pos").over(order) == F.col("minim_pos")), F.lit(False))
    rows = std.select("signature", F.row_number().over(order).alias("rank"), "read_id", *after, "mate_seq", (same if window > 1 else F.lit(False)).alias("again"))
    rows = rows.select("signature", "rank", "read_id", *(F.when(~F.col("again"), F.col(c)).alias(c) for c in (*after, "mate_seq")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bin_, distinct, last, first = None, 0, {}, None
        for f in frames:
            if not len(f):
                continue
            heads = np.flatnonzero(f["seq"].notna().to_numpy())
            h, firsts = f.iloc[heads], [first]
            for sig, read, value in zip(h["signature"].tolist(), h["read_id"].tolist(), zip(h["seq"].tolist(), h["minim_pos"].tolist(), strict=True), strict=True):
                if sig != bin_:
                    bin_, distinct, last = sig, 0, {}
                at, first = last.get(value, (-window, read))
                if at < 0 or distinct - at > window - 1:
                    first = read
                    last[value] = (distinct, read)
                    if len(last) > 2 * window:
                        last = {x: y for x, y in last.items() if distinct - y[0] < window}
                    distinct += 1
                firsts.append(first)
            # rows go on with the first of the run they are in; the first rows of a batch, with that of the batch before
            of = np.searchsorted(heads, np.arange(len(f)), side="right")
            firsts[0] = -1 if firsts[0] is None else firsts[0]
            out = f[["signature", "rank", "read_id"]].assign(first_id=np.array(firsts, np.int64)[of])
            own = (out["first_id"] == f["read_id"]).to_numpy()
            for c in (*after, "mate_seq"):
                out[c] = f[c].where(own, None)
            out["minim_pos"] = out["minim_pos"].astype("Int32")
            yield out

    rows = rows.repartition("signature").sortWithinPartitions("signature", "rank")
    return rows.mapInPandas(run, "signature int, rank int, read_id long, first_id long, seq string, minim_pos int, mate_seq string")


def pair_firsts(pairs: DataFrame, window: int = 4096, k: int = K) -> DataFrame:
    """signature, seq, minim_pos, mate_seq, read_id and n_copies of the pairs that repeat none within the window (``pair_duplicates``)."""
    rows = durable(_pair_repeats(pairs, window, k).drop("rank"))
    copies = rows.groupBy(F.col("first_id").alias("read_id")).agg(F.count("*").alias("n_copies"))
    return rows.where("seq is not null").select("signature", "seq", "minim_pos", "mate_seq", "read_id").join(copies, "read_id")


def laid_out(seqs: list[str], pos: np.ndarray) -> np.ndarray:
    """Letters of the sequences, a row each, with all signatures in one column; 0 where a sequence has none."""
    size = np.array([len(s) for s in seqs])
    left, right = int(pos.max(initial=0)), int((size - pos).max(initial=0))
    wall = np.zeros((len(seqs), left + right), np.uint8)
    for i, s in enumerate(seqs):
        wall[i, left - pos[i] : left - pos[i] + size[i]] = np.frombuffer(s.encode(), np.uint8)
    return wall


def costs(
    seqs: list[str], pos: np.ndarray, back: int, group: np.ndarray | None = None, rank: np.ndarray | None = None, reach: int = 0, last: np.ndarray | None = None, asks: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance d = 1..back: d, shifts and costs of every row against the row d before, in its group (and at most ``reach`` ranks before, if ranks are given).

    A row may stand for a run of ranks from ``rank`` to ``last``: its first is
    compared with the lasts of the rows before. ``asks`` names the rows that
    are compared, all unless given. Rows are laid out so that signatures meet in one column; a mismatch is a
    column that both rows fill with different bases.
    """
    wall = laid_out(seqs, pos)
    group = np.zeros(len(seqs), np.int64) if group is None else group
    most = int(np.unique(group, return_counts=True)[1].max(initial=0)) - 1
    last = rank if last is None else last
    for d in range(1, min(back, most) + 1):
        shift = pos[:-d] - pos[d:]
        cost = np.full(len(shift), np.iinfo(np.int32).max, np.int64)
        near = (group[d:] == group[:-d]) & (np.abs(shift) <= MAX_SHIFT)
        if rank is not None:
            near &= rank[d:] - last[:-d] <= reach
        pair = np.flatnonzero(near if asks is None else near & asks[d:])
        for at in range(0, len(pair), 8192):
            x = pair[at : at + 8192]
            a, b = wall[x + d], wall[x]
            cost[x] = np.abs(shift[x]) * SHIFT_COST + ((a != b) & (a != 0) & (b != 0)).sum(axis=1) * MISMATCH_COST
        yield d, shift, cost


def best_before(seqs: list[str], pos: np.ndarray, back: int, group: np.ndarray | None = None, rank: np.ndarray | None = None, reach: int = 0, last: np.ndarray | None = None, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the distance of the cheapest of the ``back`` rows before (0: none), its shift and cost; the nearest wins ties."""
    best = np.full(len(seqs), np.iinfo(np.int32).max, np.int64)
    dist, shift = np.zeros(len(seqs), np.int64), np.zeros(len(seqs), np.int64)
    for d, s, c in costs(seqs, pos, back, group, rank, reach, last, asks):
        better = np.flatnonzero(c < best[d:]) + d
        best[better], dist[better], shift[better] = c[better - d], d, s[better - d]
    return dist, shift, best


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a sorted partition, cut only between groups: the last group of a batch may go on in the next one."""
    held: list[pd.DataFrame] = []  # pieces of one group, put together once
    for f in frames:
        if not len(f):
            continue
        if held and not (held[0][keys].iloc[0] == f[keys].iloc[0]).all():
            yield pd.concat(held, ignore_index=True)
            held = []
        last = (f[keys] == f[keys].iloc[-1]).all(axis=1).to_numpy()
        if last.all():
            held.append(f)
            continue
        yield pd.concat([*held, f[~last]], ignore_index=True)
        held = [f[last]]
    if held:
        yield pd.concat(held, ignore_index=True)


def lz_nodes(binned: DataFrame, window: int = 255, threshold: int | None = None, k: int = K, paired: bool = False) -> DataFrame:
    """signature, read_id, rank, node_type, parent_id, shift, cost, no_mismatch, n_copies of distinct reads.

    A read is compared with the ``window`` - 1 distinct reads before it in its
    bin; cost = |shift| + 2 * mismatches over the overlap. Up to the threshold
    (half the read's length unless given) it is an LZ child of the cheapest,
    else HARD. The N bin has no nodes. Bins are cut into blocks of ranks with
    the window's reads in front, so a large bin is many bounded tasks. Paired
    reads stand in the order of both mates, and are distinct within the window.
    """
    rows = ranked(pair_firsts(binned, window, k), mate=True) if paired else ranked(duplicates(binned.where(F.col("signature") != 4**k)))
    own = F.expr(f"cast((rank - 1) div {BLOCK} as int)")
    reach = F.expr(f"cast((rank - 1 + {window - 1}) div {BLOCK} as int)")
    cells = rows.withColumn("own", own).withColumn("block", F.explode(F.sequence("own", reach)))

    names = ["signature", "read_id", "rank", "node_type", "parent_id", "shift", "cost", "no_mismatch", "n_copies"]

    def match(f: pd.DataFrame) -> pd.DataFrame:
        """Whole groups of one (signature, block) each, in order of rank: one pass of array operations over all of them."""
        f = f.reset_index(drop=True)
        group = ((f["signature"] != f["signature"].shift()) | (f["block"] != f["block"].shift())).cumsum().to_numpy(np.int64)
        seqs, pos = f["seq"].tolist(), f["minim_pos"].to_numpy(np.int64)
        dist, shift, cost = best_before(seqs, pos, window - 1, group)
        limit = f["seq"].str.len().to_numpy() // 2 if threshold is None else np.full(len(f), threshold)
        lz = (dist > 0) & (cost <= limit)
        ids = f["read_id"].to_numpy()
        out = f[["signature", "read_id", "rank", "n_copies"]].copy()
        out["node_type"] = np.where(lz, "LZ", "HARD")
        out["parent_id"] = pd.array(np.where(lz, ids[np.arange(len(f)) - dist], 0), "Int64")
        out["shift"], out["cost"] = pd.array(shift, "Int32"), pd.array(np.minimum(cost, 1 << 30), "Int32")
        out.loc[~lz, ["parent_id", "shift", "cost"]] = pd.NA
        out["no_mismatch"] = lz & (cost == np.abs(shift))
        return out[f["own"] == f["block"]][names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(match, whole_groups(frames, ["signature", "block"]))

    schema = "signature int, read_id long, rank int, node_type string, parent_id long, shift int, cost int, no_mismatch boolean, n_copies long"
    return cells.repartition("signature", "block").sortWithinPartitions("signature", "block", "rank").mapInPandas(run, schema)


def parent_distance(nodes: DataFrame) -> DataFrame:
    """read_id, lz_id: ranks between a read and its parent, less one."""
    parent = nodes.select("signature", F.col("read_id").alias("parent_id"), F.col("rank").alias("parent_rank"))
    return nodes.where("node_type = 'LZ'").join(parent, ["signature", "parent_id"]).select("read_id", (F.col("rank") - F.col("parent_rank") - 1).alias("lz_id"))


def histogram(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.where("node_type = 'LZ'").groupBy(F.col(column).alias("key")).agg(F.count("*").alias("cnt"))


LEAST_POS, HISTORY = 8, 65_536


def by_prefix(nodes: DataFrame, binned: DataFrame, window: int = 255, threshold: int | None = None, history: int = HISTORY) -> DataFrame:
    """Nodes of ``lz_nodes`` whose HARD reads have also been looked up by the bases in front of their signature.

    Reads with at least LEAST_POS bases there are kept in order of these bases,
    read backwards (of equal ones the longer first, then by rank), in one list
    for each bin and pair of bases next to the signature. A HARD read is
    compared with the window // 2 + 1 next entries on either side, among all
    reads before it by rank. The cheapest one becomes its parent if its cost is
    under the threshold; nearest first, the lower side on ties.

    A list is cut into blocks of ``history`` ranks. A HARD read is sent to its
    own block and to those before; each gives its next entries there, and the
    next ones of all are chosen from these by their places in the list. So a
    task holds one block, and the result does not depend on ``history``.
    """
    nodes, pos = durable(nodes), F.col("minim_pos")  # read several times below
    rows = nodes.select("signature", "read_id", "rank", "node_type").join(binned.select("read_id", "seq", "minim_pos"), "read_id").where(pos >= LEAST_POS)
    rows = rows.withColumns({"pair": F.substr("seq", pos - 1, F.lit(2)), "prefix": F.concat(F.reverse(F.substr("seq", F.lit(1), pos - 1)), F.lit("~"))})
    listed = Window.partitionBy("signature", "pair").orderBy("prefix", "rank")
    ahead = F.rank().over(Window.partitionBy("signature", "pair").orderBy("prefix"))  # a read's place before its equals
    rows = rows.withColumns({"spot": F.row_number().over(listed), "ahead": ahead, "own": F.expr(f"cast((rank - 1) div {history} as int)")}).drop("prefix")
    rows = durable(rows)
    held = rows.withColumn("block", F.col("own")).withColumn("asks", F.lit(False))
    asked = rows.where((F.col("node_type") == "HARD") & (F.col("own") > 0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumn("asks", F.lit(True))
    side, keys = window // 2 + 1, ["signature", "pair", "block"]

    def limit_of(size: np.ndarray) -> np.ndarray:
        return size // 2 if threshold is None else np.full(len(size), threshold)

    class Block:
        """Reads of one block by spot, and their next entries."""

        def __init__(self, f: pd.DataFrame):
            self.seqs, self.at, self.ids, self.spot = f["seq"].tolist(), f["minim_pos"].to_numpy(np.int64), f["read_id"].to_numpy(), f["spot"].to_numpy(np.int64)

        def priced(self, wall: np.ndarray, at: np.ndarray, i: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shift = at[y] - at[i]
            differ = ((wall[y] != wall[i]) & (wall[y] != 0) & (wall[i] != 0)).sum(axis=1)
            return shift, np.where(np.abs(shift) > MAX_SHIFT, np.iinfo(np.int32).max, np.abs(shift) * SHIFT_COST + differ * MISMATCH_COST)

    def answer(read: int, block: Block, y: np.ndarray, up: np.ndarray, shift: np.ndarray, cost: np.ndarray, limit: int, last: bool) -> tuple | None:
        """What a read learns in a block: the best entry if there is no other block, else its next entries."""
        if last:
            j = int(np.argmin(cost)) if len(cost) else 0
            return (read, int(block.ids[y[j]]), int(shift[j]), int(cost[j]), None) if len(cost) and cost[j] < limit else None
        return (read, None, None, None, [{"up": bool(u), "spot": int(block.spot[k]), "c": int(min(c, 1 << 30)), "p": int(block.ids[k]), "s": int(s)} for k, u, s, c in zip(y, up, shift, cost, strict=True)])

    def own_block(f: pd.DataFrame) -> list[tuple]:
        """Reads of a block in order of rank, each HARD one against those before it."""
        block, out = Block(f), []
        hard, first, ahead_, limit = (f["node_type"] == "HARD").to_numpy(), (f["own"] == 0).to_numpy(), f["ahead"].to_numpy(), limit_of(np.array([len(x) for x in block.seqs]))
        if not hard.any():
            return out
        wall = laid_out(block.seqs, block.at)
        kept: list[int] = []
        place = dict(zip(block.spot.tolist(), range(len(f)), strict=True))
        for i in range(len(f)):
            if hard[i] and kept:
                here = bisect.bisect_left(kept, int(ahead_[i]))
                lower, upper = kept[max(0, here - side) : here][::-1], kept[here : here + side]
                y = np.array([place[x] for x in lower + upper])
                shift, cost = block.priced(wall, block.at, i, y)
                out.append(answer(int(block.ids[i]), block, y, np.arange(len(y)) >= len(lower), shift, cost, int(limit[i]), bool(first[i])))
            bisect.insort(kept, int(block.spot[i]))
        return [x for x in out if x]

    def later(f: pd.DataFrame, q: pd.DataFrame) -> list[tuple]:
        """HARD reads of later blocks against all of this one."""
        f = f.sort_values("spot")
        block = Block(f)
        at = np.concatenate([block.at, q["minim_pos"].to_numpy(np.int64)])
        wall = laid_out(block.seqs + q["seq"].tolist(), at)
        out = []
        for n, (read, ahead_) in enumerate(zip(q["read_id"].tolist(), q["ahead"].tolist(), strict=True)):
            here = int(np.searchsorted(block.spot, ahead_))
            lower, upper = np.arange(max(0, here - side), here)[::-1], np.arange(here, min(len(f), here + side))
            y = np.concatenate([lower, upper])
            shift, cost = block.priced(wall, at, len(f) + n, y)
            out.append(answer(read, block, y, np.arange(len(y)) >= len(lower), shift, cost, 0, False))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["read_id", "p", "s", "c", "next"]
        table = lambda rows: pd.DataFrame(rows, columns=names).astype({"read_id": "int64", "p": "Int64", "s": "Int32", "c": "Int32"})
        now, reads = None, None
        for f in whole_groups(frames, [*keys, "asks"]):  # asking reads come behind their block
            for key, part in f.groupby([*keys, "asks"], sort=False):
                if not key[3]:
                    now, reads = key[:3], part
                    if out := own_block(part):
                        yield table(out)
                elif now == key[:3]:
                    for a in range(0, len(part), 4096):
                        yield table(later(reads, part.iloc[a : a + 4096]))

    columns = [*keys, "asks", "rank", "own", "read_id", "node_type", "seq", "minim_pos", "spot", "ahead"]
    both = held.select(*columns).unionByName(asked.select(*columns))
    entry = "struct<up:boolean,spot:int,c:int,p:long,s:int>"
    found = both.repartition(*keys).sortWithinPartitions(*keys, "asks", "rank").mapInPandas(run, f"read_id long, p long, s int, c int, next array<{entry}>")
    limit = F.expr("length(seq) div 2" if threshold is None else str(threshold))
    # of reads with several blocks: the next entries of all of them
    merged = found.where("next is not null").groupBy("read_id").agg(F.flatten(F.collect_list("next")).alias("next"))
    lower = F.slice(F.reverse(F.array_sort(F.transform(F.filter("next", lambda x: ~x["up"]), lambda x: F.struct(x["spot"], x["c"], x["p"], x["s"])))), 1, side)
    upper = F.slice(F.array_sort(F.transform(F.filter("next", lambda x: x["up"]), lambda x: F.struct(x["spot"], x["c"], x["p"], x["s"]))), 1, side)
    ordered = lambda x, up: F.transform(x, lambda e, i: F.struct(e["c"].alias("c"), F.lit(up).alias("up"), i.alias("far"), e["p"].alias("p"), e["s"].alias("s")))
    best = F.array_min(F.concat(ordered(lower, 0), ordered(upper, 1)))
    merged = merged.join(binned.select("read_id", limit.alias("most")), "read_id").select("read_id", best.alias("b"), "most").where("b.c < most").select("read_id", "b.p", "b.s", "b.c")
    found = found.where("next is null").select("read_id", "p", "s", "c").unionByName(merged)
    better = F.col("p").isNotNull()
    pick = {"node_type": F.when(better, F.lit("LZ")).otherwise(F.col("node_type")), "no_mismatch": F.when(better, F.col("c") == F.abs("s")).otherwise(F.col("no_mismatch"))}
    pick |= {x: F.coalesce(y, x) for x, y in (("parent_id", "p"), ("shift", "s"), ("cost", "c"))}
    return nodes.join(found, "read_id", "left").withColumns(pick).drop("p", "s", "c")


def mismatches() -> Column:
    """Mismatches of an LZ node, from its cost."""
    return ((F.col("cost") - F.abs("shift") * SHIFT_COST) / MISMATCH_COST).cast("int")


def expensive(nodes: DataFrame, most: int = 4) -> DataFrame:
    """read_id, mismatches, is_expensive: more mismatches than a cheap match may have."""
    m = mismatches()
    return nodes.where("node_type = 'LZ'").select("read_id", m.alias("mismatches"), (m > most).alias("is_expensive"))
