"""Re-binning: reads and whole match trees of fine signatures move to coarser ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import K, revcomp
from .forest import depths_by_bin
from .lineage import durable
from .matching import duplicates, lz_nodes, whole_groups
from .minimizers import smallest


def is_eligible(signature: Column, p: int, k: int = K) -> Column:
    """Bins that round p (2, 4, 8, ...) takes apart."""
    return (signature != 4**k) & (signature % p != 0) & (signature % (p // 2) == 0)


def allowed_targets(binned: DataFrame, least: int, k: int = K) -> np.ndarray:
    """4^k booleans: the bins with at least ``least`` reads. At most 4^k rows of their counts are collected."""
    out = np.zeros(4**k, bool)
    sizes = binned.where(F.col("signature") != 4**k).groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out[[r["signature"] for r in sizes.select("signature").collect()]] = True
    return out


def single_targets(binned: DataFrame, p: int, k: int = K, allowed: np.ndarray | None = None) -> DataFrame:
    """Reads of eligible bins with new_signature, new_pos, flips.

    The target is the smallest valid code that p divides, other than the
    present one and among the ``allowed`` ones; the read as stored wins ties;
    null: the read stays.
    """
    rows = binned.where(is_eligible(F.col("signature"), p, k)).withColumn("_m", smallest(F.col("seq"), k, 0, p, F.col("signature"), allowed))
    flips = F.col("_m.r_code") < F.col("_m.f_code")
    new = F.least("_m.f_code", "_m.r_code")
    pos = F.when(flips, F.col("_m.r_pos")).otherwise(F.col("_m.f_pos"))
    return rows.withColumns({"new_signature": F.when(new < 4**k, new), "new_pos": F.when(new < 4**k, pos), "flips": flips}).drop("_m")


def tree_choices(heads: DataFrame, p: int, window: int = 255, min_tree: int = 4, k: int = K, allowed: np.ndarray | None = None) -> DataFrame:
    """Of eligible reads: read_id, signature, parent_id, shift, tree_id, as_tree, edge_id, new_signature, new_pos, flips.

    Trees of more than ``min_tree`` reads move as one (as_tree): of the reads
    with the largest and the smallest position the one with the smaller target
    decides (the latter only if strictly smaller) and is the tree's edge_id.
    Reads of other trees move alone. Null new_signature: the read stays.
    """
    same = ["signature", "seq", "minim_pos"]
    heads = heads.where(is_eligible(F.col("signature"), p, k)).select("read_id", *same)
    firsts = durable(duplicates(heads))  # trees are of these, with their copies counted; copies then take what their first read has
    fine = single_targets(firsts, p, k, allowed).select("read_id", *same, "n_copies", "new_signature", "new_pos", "flips")
    nodes = durable(lz_nodes(firsts, window, k=k).select("read_id", "signature", "parent_id", "shift"))
    roots = depths_by_bin(nodes).select("read_id", F.col("root_id").alias("tree_id"))
    rows = durable(fine.join(nodes.drop("signature"), "read_id").join(roots, "read_id"))
    known = F.when(F.col("new_signature").isNotNull(), F.struct("new_signature", "new_pos", "flips", "read_id"))
    trees = rows.groupBy("tree_id").agg(
        F.sum("n_copies").alias("size"), F.max_by(known, F.struct("minim_pos", -F.col("read_id"))).alias("right"), F.min_by(known, F.struct("minim_pos", "read_id")).alias("left")
    )
    choice = F.when(F.col("left.new_signature") < F.coalesce(F.col("right.new_signature"), F.lit(4**k)), F.col("left")).otherwise(F.col("right"))
    trees = trees.select("tree_id", (F.col("size") > min_tree).alias("as_tree"), choice.alias("t"))
    rows = rows.join(trees, "tree_id")
    pick = {c: F.when(F.col("as_tree"), F.col(f"t.{c}")).otherwise(F.col(c)) for c in ("new_signature", "new_pos", "flips")}
    rows = rows.withColumns(pick).withColumn("edge_id", F.when(F.col("as_tree"), F.col("t.read_id"))).drop("t", "n_copies").withColumnRenamed("read_id", "first_id")
    own = F.col("read_id") == F.col("first_id")
    moved = {"parent_id": F.when(own, F.col("parent_id")).otherwise(F.col("first_id")), "shift": F.when(own, F.col("shift")).otherwise(F.lit(0))}
    return heads.join(rows, same).withColumns(moved).select("read_id", "signature", "parent_id", "shift", "tree_id", "as_tree", "edge_id", "new_signature", "new_pos", "flips")


def rebin_round(binned: DataFrame, p: int, window: int = 255, min_tree: int = 4, k: int = K) -> DataFrame:
    """read_id, signature, new_signature, tree_id, as_tree for all reads; duplicates go with their first read (``tree_choices``).

    Reads without a target, and bins that are not eligible, stay.
    """
    binned = durable(binned.select("read_id", "signature", "seq", "minim_pos"))  # signatures are found once
    moved = tree_choices(binned, p, window, min_tree, k)
    stay = binned.where(~is_eligible(F.col("signature"), p, k)).select("read_id", "signature", F.col("signature").alias("new_signature"), F.lit(None).cast("long").alias("tree_id"), F.lit(False).alias("as_tree"))
    return moved.select("read_id", "signature", F.coalesce("new_signature", "signature").alias("new_signature"), "tree_id", "as_tree").unionByName(stay)


def rerooted(rows: DataFrame) -> DataFrame:
    """From read_id, parent_id, shift, tree_id, edge_id: the same trees with edge_id as the root.

    The parents between edge_id and the old root become children. A tree's
    links (four numbers a read) are held by one task.
    """

    def turn(f: pd.DataFrame) -> pd.DataFrame:
        f = f.reset_index(drop=True)
        up = dict(zip(f["read_id"].tolist(), zip(f["parent_id"].astype(object).where(f["parent_id"].notna(), None).tolist(), f["shift"].astype(object).where(f["shift"].notna(), 0).tolist(), strict=True), strict=True))
        for edge in f["edge_id"].unique().tolist():
            child, link = edge, up[edge]
            up[edge] = (None, 0)
            while link[0] is not None:
                above = int(link[0])
                child, link, up[above] = above, up[above], (child, -int(link[1]))
        out = [up[i] for i in f["read_id"].tolist()]
        return pd.DataFrame({"read_id": f["read_id"], "parent_id": pd.array([x for x, _ in out], "Int64"), "shift": pd.array([int(x) for _, x in out], "Int32"), "edge_id": f["edge_id"]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(turn, whole_groups(frames, ["tree_id"]))

    rows = rows.select("tree_id", "read_id", "parent_id", "shift", "edge_id").repartition("tree_id").sortWithinPartitions("tree_id")
    return rows.mapInPandas(run, "read_id long, parent_id long, shift int, edge_id long")


def chain(binned: DataFrame, rounds: tuple[int, ...] = (2, 4, 8), window: int = 255, min_tree: int = 4, least_target: int = 0, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(heads, links) after all rounds over distinct reads (read_id, seq, minim_pos, signature).

    heads: read_id, seq, minim_pos, signature, turned of the reads that are in
    a bin of their own right; the signature stands at minim_pos, turned says
    whether seq is the reverse complement of the first one. links: read_id,
    parent_id, shift, anchor_id, turned of the reads that hang in a moved tree
    under the head anchor_id; they go, and turn, wherever it goes.
    """
    size = binned.select("read_id", F.length("seq").alias("size"))
    heads = binned.select("read_id", "seq", "minim_pos", "signature", F.lit(False).alias("turned"))
    heads, links = durable(heads) if rounds else heads, None
    for p in rounds:
        allowed = allowed_targets(heads, least_target, k) if least_target else None
        choice = durable(tree_choices(heads, p, window, min_tree, k, allowed).where("new_signature is not null"))
        trees = choice.where("as_tree")
        goes = choice.where("not as_tree or read_id = edge_id").select("read_id", "new_signature", "new_pos", "flips")
        hung = trees.where("read_id <> edge_id").select("read_id", F.col("edge_id").alias("to"), "flips")
        joined = heads.join(hung.select("read_id"), "read_id", "left_anti").join(goes, "read_id", "left")
        flips = F.coalesce(F.col("flips"), F.lit(False))
        kept = joined.select(
            "read_id",
            F.when(flips, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
            F.coalesce("new_pos", "minim_pos").alias("minim_pos"),
            F.coalesce("new_signature", "signature").alias("signature"),
            (F.col("turned") != flips).alias("turned"),
        )
        turned = lambda x, by: F.when(by, F.col("parent_size") - F.col("size") - F.col(x)).otherwise(F.col(x)).cast("int").alias(x)
        new = rerooted(trees).where("parent_id is not null").join(heads.select("read_id", "turned"), "read_id").join(hung.drop("to"), "read_id")
        new = new.join(size, "read_id").join(size.select(F.col("read_id").alias("parent_id"), F.col("size").alias("parent_size")), "parent_id")
        new = new.select("read_id", "parent_id", turned("shift", F.col("flips")), F.col("edge_id").alias("anchor_id"), (F.col("turned") != F.col("flips")).alias("turned"), "size", "parent_size")
        if links is not None:
            moves = hung.select(F.col("read_id").alias("anchor_id"), "to", "flips").unionByName(goes.select(F.col("read_id").alias("anchor_id"), F.col("read_id").alias("to"), "flips"))
            old = links.join(moves, "anchor_id", "left")
            new = new.unionByName(old.select("read_id", "parent_id", turned("shift", flips), F.coalesce("to", "anchor_id").alias("anchor_id"), (F.col("turned") != flips).alias("turned"), "size", "parent_size"))
        heads, links = durable(kept), durable(new)
    if links is None:
        links = binned.sparkSession.createDataFrame([], "read_id long, parent_id long, shift int, anchor_id long, turned boolean, size int, parent_size int")
    return heads, links.drop("size", "parent_size")
