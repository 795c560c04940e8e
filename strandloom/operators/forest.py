"""Match forests: depth and root by pointer doubling, tree sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import durable
from .matching import whole_groups


def depths(nodes: DataFrame) -> DataFrame:
    """read_id, root_id, depth; a node's known ancestor doubles its distance each round."""
    state = durable(nodes.select("read_id", F.coalesce("parent_id", "read_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("depth")))
    while True:
        above = state.select(F.col("read_id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        new = durable(state.join(above, "up").select("read_id", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return state.select("read_id", F.col("up").alias("root_id"), "depth")


def depths_by_bin(nodes: DataFrame) -> DataFrame:
    """read_id, root_id, depth, as ``depths``, for trees that lie within one signature each: in one shuffle.

    A bin's links (two numbers a read) are held by one task.
    """

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        ids = f["read_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        has = f["parent_id"].notna().to_numpy()
        up = np.arange(len(ids))
        up[has] = order[np.searchsorted(ids[order], f["parent_id"][has].to_numpy(np.int64))]
        depth = has.astype(np.int64)
        while True:
            more = depth[up]
            if not more.any():
                return pd.DataFrame({"read_id": ids, "root_id": ids[up], "depth": depth.astype(np.int32)})
            depth, up = depth + more, up[up]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(walk, whole_groups(frames, ["signature"]))

    rows = nodes.select("signature", "read_id", "parent_id").repartition("signature").sortWithinPartitions("signature")
    return rows.mapInPandas(run, "read_id long, root_id long, depth int")


def tree_sizes(nodes: DataFrame, deep_only: bool = False) -> DataFrame:
    """root_id, size, max_depth. deep_only counts 1 and the nodes at depth 2 or more, the rule of one known tool."""
    size = F.count("*") if not deep_only else F.lit(1) + F.sum((F.col("depth") >= 2).cast("long"))
    return depths(nodes).groupBy("root_id").agg(size.alias("size"), F.max("depth").alias("max_depth"))
