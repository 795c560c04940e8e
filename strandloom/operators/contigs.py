"""Consensus: column votes of aligned reads, and contigs grown from match trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions.dna import K
from .matching import laid_out, whole_groups

VOTE_ORDER = "AGCTN"
#: Bases at each end of a read that a contig does not look at; most new variants of a read, and differences of one that brings some.
CUT, MOST_NEW, MOST_HAMMING = 2, 1, 8
#: Most reads of a tree that grow together; None: a tree is never cut. If a number is set, larger trees are cut by rank.
TREE: int | None = None
#: Most reads that are laid out, or looked at for variants, at once.
ROWS = 16_384


def column_counts(binned: DataFrame, k: int = K) -> DataFrame:
    """signature, col, base, cnt: bases of each bin with signatures in one column (col 0)."""
    half = 1 << 23

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        data, o = counting.letters(batch.column(2))
        size = np.diff(o)
        sig, pos = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), size) for i in (0, 1))
        return (sig << 32) + (counting.places(o) - pos + half << 8) + data

    def named(x: np.ndarray) -> dict:
        return {"signature": (x >> 32).astype(np.int32), "col": ((x >> 8 & 2 * half - 1) - half).astype(np.int32), "base": (x & 255).astype(np.int32)}

    rows = binned.where(F.col("signature") != 4**k).select("signature", "minim_pos", "seq")
    parts = rows.mapInArrow(lambda batches: counting.tallied(batches, keys, named), "signature int, col int, base int, n long")
    return parts.groupBy("signature", "col", F.char("base").alias("base")).agg(F.sum("n").alias("cnt"))


def votes(binned: DataFrame, k: int = K) -> DataFrame:
    """signature, col, base: the most frequent base of a column; ties by A, G, C, T, N."""
    best = F.max_by("base", F.struct("cnt", -F.instr(F.lit(VOTE_ORDER), F.col("base"))))
    return column_counts(binned, k).groupBy("signature", "col").agg(best.alias("base"))


def variants(binned: DataFrame, k: int = K) -> DataFrame:
    """signature, col, depth, n_variant: reads over a column and those off its most frequent base; columns with any such."""
    c = column_counts(binned, k).groupBy("signature", "col").agg(F.sum("cnt").alias("depth"), (F.sum("cnt") - F.max("cnt")).alias("n_variant"))
    return c.where("n_variant > 0")


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = -(-max(1, bits.shape[1]) // 64) * 64
    padded = np.zeros((len(bits), wide), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


@dataclass
class Contig:
    """Places (in the tree's order) of a contig: all members in order of acceptance, the one that stays an LZ match, and reads that hang from it now."""

    members: list[int]
    main: int
    rehung: list[int]


class Tree:
    """Reads of one match tree without its root, in order of rank, laid out with all signatures in one column.

    ``parent`` holds places, -1 for the root or a read of another block. The
    letters of a read without CUT ones at each end are two bits a column, so
    all reads are compared with a consensus in one pass over a few words each.
    """

    def __init__(self, seqs: list[str], pos: np.ndarray, parent: np.ndarray, cost: np.ndarray, shift: np.ndarray, barred: np.ndarray | None = None):
        self.pos, self.size, self.parent = pos, np.array([len(s) for s in seqs], np.int64), parent
        self.seqs, self.left = seqs, int(pos.max(initial=0))  # column of the signature
        self.width = self.left + int((self.size - pos).max(initial=0))
        words = [[_words(x) for x in (c != 0, np.isin(c, [71, 84]), np.isin(c, [67, 84]), c == 78)] for c in self._cells(np.arange(len(seqs)))]
        self.there, self.b0, self.b1, self.n = (np.concatenate(x) for x in zip(*words, strict=True))
        self.some_n = np.array(["N" in s for s in seqs], bool)
        self.inner_n = self.n.any(1)
        #: Thirty times the price of the LZ match: 3 + cost, and 1 + cost / 1.5 more unless it has no mismatch.
        self.price = 30 * (3 + cost) + np.where(cost != np.abs(shift), 30 + 20 * cost, 0)
        self.cost = cost
        self.barred = np.zeros(len(seqs), bool) if barred is None else barred
        self.below: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
        held = np.flatnonzero(parent >= 0)
        inner = np.zeros(len(seqs), bool)
        inner[parent[held]] = True
        # children without children first, each kind in order of rank
        order = np.lexsort((held, inner[held], parent[held]))
        kids = held[order]
        lead = np.flatnonzero(np.diff(parent[kids], prepend=-1))
        for part in np.split(kids, lead[1:]) if len(kids) else []:
            self.below[int(parent[part[0]])] = part
        tops = np.flatnonzero(parent < 0)
        self.tops = tops[np.lexsort((tops, inner[tops]))]

    def _cells(self, reads: np.ndarray) -> Iterator[np.ndarray]:
        """Letters of reads in the tree's columns, ROWS reads at once; 0 at the CUT ends and beyond."""
        at = np.arange(self.width)
        for a in range(0, max(len(reads), 1), ROWS):
            x = reads[a : a + ROWS]
            pos, cells = self.pos[x], np.zeros((len(x), self.width), np.uint8)
            inner = laid_out([self.seqs[i] for i in x], pos)
            off = self.left - int(pos.max(initial=0))
            cells[:, off : off + inner.shape[1]] = inner
            first = self.left - pos
            cells[(at < (first + CUT)[:, None]) | (at >= (first + self.size[x] - CUT)[:, None])] = 0
            yield cells

    def _children(self, reads: np.ndarray | list[int]) -> np.ndarray:
        return np.concatenate([self.below[i] for i in reads]) if len(reads) else np.zeros(0, np.int64)

    def _start(self, seed: int) -> None:
        self.cover, self.c0, self.c1 = self.there[seed].copy(), self.b0[seed].copy(), self.b1[seed].copy()
        self.varied = np.zeros_like(self.cover)
        width = 64 * len(self.cover)
        self.offs, self.depth = np.zeros(width, np.int64), np.zeros(width, np.int64)
        self.members, self.new = [seed], {}

    def _unlike(self, q: np.ndarray) -> np.ndarray:
        return ((self.b0[q] ^ self.c0) | (self.b1[q] ^ self.c1) | self.n[q]) & self.there[q] & self.cover

    def _columns(self, words: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little").astype(bool)

    def _extend(self, i: int) -> None:
        fresh = self.there[i] & ~self.cover
        self.c0 |= self.b0[i] & fresh
        self.c1 |= self.b1[i] & fresh
        self.cover |= fresh

    def _take(self, q: np.ndarray) -> None:
        self.members += q.tolist()
        first = self.left - self.pos[q] + CUT
        last = np.maximum(first, self.left - self.pos[q] + self.size[q] - CUT)
        n = len(self.depth) + 2 * CUT + 1
        self.depth += np.cumsum(np.bincount(first, minlength=n) - np.bincount(last, minlength=n))[: len(self.depth)]

    def _agreeing(self, q: np.ndarray) -> np.ndarray:
        """Which reads of a queue are taken in turn if none may differ from what is there when it is looked at."""
        taken = np.zeros(len(q), bool)
        ok = np.flatnonzero(~(self.inner_n[q] | self.barred[q]) & ~self._unlike(q).any(1))
        while len(ok):
            longer = (self.there[q[ok]] & ~self.cover).any(1)
            x = int(longer.argmax()) if longer.any() else len(ok) - 1
            taken[ok[: x + 1]] = True
            self._take(q[ok[: x + 1]])
            self._extend(int(q[ok[x]]))
            ok = ok[x + 1 :]
            ok = ok[~self._unlike(q[ok]).any(1)]
        return taken

    def _cheaper(self, q: np.ndarray) -> np.ndarray:
        """Which reads could be taken next, with variants, for less than their LZ match."""
        unlike = self._unlike(q)
        new = unlike & ~self.varied
        h, n = np.bitwise_count(unlike).sum(1).astype(np.int64), np.bitwise_count(new).sum(1)
        ok = (n == 0) | (h <= MOST_HAMMING) & (n <= MOST_NEW)
        ok &= ~self.barred[q] & (np.abs(self.pos[q] - self.pos[self.members[-1]]) <= self.size[q] // 2)
        ok &= ~(self.n[q] & ~self.cover).any(1)
        x = np.flatnonzero(ok)
        if len(x):
            deep = self._columns(new[x]) @ self.depth
            ok[x] = 30 * (1 + h[x] - (deep > 0) + 2 * CUT) + 27 * deep <= self.price[q[x]]
        return ok

    def _with_variants(self, q: np.ndarray) -> np.ndarray:
        taken = np.zeros(len(q), bool)
        i, step = 0, 64
        while i < len(q):
            part = q[i : i + step]
            ok = self._cheaper(part)
            if not ok.any():
                i, step = i + len(part), min(4 * step, ROWS)
                continue
            j = int(ok.argmax())
            read = part[j : j + 1]
            unlike = self._unlike(read)[0]
            fresh = self._columns(unlike & ~self.varied)
            if fresh.any():
                self.new[int(read[0])] = np.flatnonzero(fresh)
            self.offs += self._columns(unlike)
            self.varied |= unlike
            self._extend(int(read[0]))
            self._take(read)
            taken[i + j] = True
            i, step = i + j + 1, 64
        return taken

    def _waves(self, q: np.ndarray, choose) -> np.ndarray:
        """The reads of a queue that ``choose`` leaves; children of those it takes join the end of the queue."""
        left = []
        while len(q):
            taken = choose(q)
            left.append(q[~taken])
            q = self._children(q[taken])
        return np.concatenate(left) if left else q

    def grow(self, least: int) -> Iterator[Contig]:
        queue = self.tops
        while len(queue):
            seed, queue = int(queue[0]), np.concatenate([queue[1:], self.below[int(queue[0])]])
            if self.some_n[seed] or self.barred[seed]:
                continue
            self._start(seed)
            queue = self._waves(queue, self._agreeing)
            queue = self._waves(queue, self._with_variants)
            if len(self.members) < least:
                continue
            removed = {i for i, columns in self.new.items() if (self.offs[columns] == 1).any()}
            members = [i for i in self.members if i not in removed]
            if len(members) < least:
                continue
            held = set(members)
            outer = [i for i in members if int(self.parent[i]) not in held and int(self.parent[i]) not in removed]
            main = min(outer, key=lambda i: self.cost[i])
            yield Contig(members, main, [int(c) for i in members for c in self.below[i] if int(c) not in held])

    def profile(self, members: list[int]) -> tuple[int, str, list[int]]:
        """First column, consensus and variant columns of members, by counts of the five letters in each column; 0 is the signature's first base."""
        counts = sum(np.stack([(c == ord(b)).sum(0) for b in VOTE_ORDER]) for c in self._cells(np.array(members, np.int64)))
        covered = np.flatnonzero(counts.any(0))
        if not len(covered):
            return 0, "", []
        lo, hi = int(covered[0]), int(covered[-1]) + 1
        counts = counts[:, lo:hi]
        letters = np.where(counts.any(0), np.frombuffer(VOTE_ORDER.encode(), np.uint8)[counts.argmax(0)], ord("N")).astype(np.uint8)
        return lo - self.left, letters.tobytes().decode(), (np.flatnonzero((counts > 0).sum(0) > 1) + lo - self.left).tolist()


def contigs(nodes: DataFrame, depth: DataFrame, binned: DataFrame, least: int = 10, barred: DataFrame | None = None) -> DataFrame:
    """signature, contig_id (its seed), root_id, main_id, start, consensus, variant_cols, members, rehung.

    Reads of a tree (its root is left out) wait in a queue, children behind
    their parents and those without children first. The first one without N
    founds a contig. It takes from the queue, in turn, reads that differ from
    nothing that is there; then reads with at most MOST_NEW new variants that
    are cheaper in the contig than as LZ matches. Children of what is taken
    join the queue. Members whose new variant no other read shares leave, and
    contigs of fewer than ``least`` members are discarded. Of the members whose
    parent is outside, the cheapest stays an LZ match of it (``main_id``;
    ``members`` holds the others too); children of members that are outside,
    ``rehung``, hang from it. ``start`` is the column of the consensus' first
    base, 0 that of the signature; CUT bases at the ends of reads do not count
    for it. Reads of ``barred`` (read_id) stay outside. A tree grows whole, in
    one task, whatever its size; only if TREE is set, a larger one is cut by
    rank, so that parents come first, into blocks that grow alone.
    """
    rows = nodes.where("node_type = 'LZ'").join(depth.select("read_id", "root_id"), "read_id").join(binned.select("read_id", "seq", "minim_pos"), "read_id")
    if barred is not None:
        rows = rows.join(barred.select("read_id", F.lit(True).alias("barred")), "read_id", "left")
    else:
        rows = rows.withColumn("barred", F.lit(None).cast("boolean"))
    keys = ["signature", "root_id", "block"]
    block = F.lit(0) if TREE is None else F.expr(f"cast((row_number() over (partition by signature, root_id order by rank) - 1) div {TREE} as int)")
    rows = rows.withColumn("block", block).select(*keys, "rank", "read_id", "parent_id", "cost", "shift", "seq", "minim_pos", "barred")
    names = ["signature", "contig_id", "root_id", "main_id", "start", "consensus", "variant_cols", "members", "rehung"]

    def build(f: pd.DataFrame) -> list[tuple]:
        ids = f["read_id"].to_numpy(np.int64)
        by = np.argsort(ids)
        up = f["parent_id"].to_numpy(np.int64)
        place = by[np.minimum(np.searchsorted(ids[by], up), len(ids) - 1)]
        tree = Tree(f["seq"].tolist(), f["minim_pos"].to_numpy(np.int64), np.where(ids[place] == up, place, -1), *(f[c].to_numpy(np.int64) for c in ("cost", "shift")), f["barred"].eq(True).to_numpy())
        named = lambda x: ids[np.array(x, np.int64)].tolist()
        return [(int(f["signature"].iat[0]), int(ids[c.members[0]]), int(f["root_id"].iat[0]), int(ids[c.main]), *tree.profile(c.members), named(c.members), named(c.rehung)) for c in tree.grow(least)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys):
            for _, part in f.groupby(keys, sort=False):
                if len(part) >= least and (made := build(part)):
                    yield pd.DataFrame(made, columns=names)

    schema = "signature int, contig_id long, root_id long, main_id long, start int, consensus string, variant_cols array<int>, members array<long>, rehung array<long>"
    return rows.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInPandas(run, schema)


def relinked(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """Nodes with tree_parent_id and contig_id: members but the main one hang from it, as do reads that hung from members."""
    inside = made.select(F.explode("members").alias("read_id"), "contig_id", "main_id")
    moved = made.select(F.explode("rehung").alias("read_id"), F.col("main_id").alias("from_main"))
    # a read may hang from one contig and be in another: there only its main one keeps the outer link
    rows = nodes.join(inside, "read_id", "left").join(moved, "read_id", "left")
    main = F.col("main_id").isNotNull() & (F.col("main_id") != F.col("read_id"))
    return rows.withColumn("tree_parent_id", F.when(main, F.col("main_id")).otherwise(F.coalesce("from_main", "parent_id"))).drop("main_id", "from_main")


def member_cells(made: DataFrame, binned: DataFrame) -> DataFrame:
    """contig_id, read_id, col, base, consensus, is_variant: each base of members but the CUT ones at their ends."""
    inside = made.select("contig_id", "start", "consensus", "variant_cols", F.explode("members").alias("read_id")).join(binned.select("read_id", "seq", "minim_pos"), "read_id")
    inside = inside.where(F.length("seq") > 2 * CUT).withColumn("at", F.explode(F.sequence(F.lit(CUT), F.length("seq") - CUT - 1)))
    col = F.col("at") - F.col("minim_pos")
    return inside.select(
        "contig_id", "read_id", col.alias("col"), F.substr("seq", F.col("at") + 1, F.lit(1)).alias("base"), F.substr("consensus", col - F.col("start") + 1, F.lit(1)).alias("consensus"), F.array_contains("variant_cols", col).alias("is_variant")
    )


def position_steps(made: DataFrame, binned: DataFrame) -> DataFrame:
    """contig_id, read_id, minim_pos, step: members but the main one by signature position, and the step from the one before (the first: its position)."""
    inside = made.select("contig_id", "main_id", F.explode("members").alias("read_id")).where("read_id <> main_id").join(binned.select("read_id", "minim_pos"), "read_id")
    before = F.expr("lag(minim_pos) over (partition by contig_id order by minim_pos, read_id)")
    return inside.select("contig_id", "read_id", "minim_pos", (F.col("minim_pos") - F.coalesce(before, F.lit(0))).alias("step"))


def histograms(made: DataFrame) -> DataFrame:
    """metric, key, cnt: contigs by number of members and by number of variant columns."""
    return made.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), x.cast("long").alias("key")) for m, x in (("members", F.size("members")), ("variants", F.size("variant_cols")))))).alias("c")).select("c.*").groupBy("metric", "key").agg(F.count("*").alias("cnt"))
