"""Nearest neighbours by a block matrix join with int8 product tiles.

Query blocks meet candidate blocks in cells. A vector x is s * q + e with q in
-127..127; the product of two quantised vectors differs from the true one by
at most |s q| |e'| + |e| |y|. In a cell, a query's k-th largest lower bound
rules out candidates whose upper bound is below it; what survives is computed
in double precision, and the best k of the cell go on to heaps, one a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable

QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 2048, 16384, 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norms of the scaled rows, of the errors and of the rows."""
    top = np.abs(x).max(axis=1)
    scale = top / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    return q, scale, norm(back), norm(x - back), norm(x)


def tile_top(query: np.ndarray, query_id: np.ndarray, cand: np.ndarray, cand_id: np.ndarray, cand_key: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query row: the candidate rows (at most k, best first, ties to the smaller key) and their products."""
    qq, qs, qb, qe, _ = quantised(query)
    cq, cs, _, ce, cn = quantised(cand)
    left = qq.astype(np.float32)  # products of int8 rows are whole numbers below 2^24, exact in float32 for up to 1040 dimensions
    step = 1040
    approx_of = lambda t: sum((left[:, a : a + step] @ cq[t, a : a + step].astype(np.float32).T).astype(np.float64) for a in range(0, left.shape[1], step))
    keep: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in query]
    low = np.full(len(query), -np.inf)
    for at in range(0, len(cand), TILE):
        t = slice(at, min(at + TILE, len(cand)))
        value = approx_of(t) * qs[:, None] * cs[None, t]
        bound = qb[:, None] * ce[None, t] + qe[:, None] * cn[None, t]
        bound += 1e-9 * (1 + np.abs(value))
        value[query_id[:, None] == cand_id[None, t]] = -np.inf
        if value.shape[1] > k:
            least = value - bound
            low = np.maximum(low, np.partition(least, value.shape[1] - k, axis=1)[:, value.shape[1] - k])
        rows, cols = np.nonzero((value + bound >= low[:, None]) & np.isfinite(value))
        exact = np.concatenate([(query[rows[i : i + 65536]] * cand[cols[i : i + 65536] + at]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        edge = np.searchsorted(rows, np.arange(len(query) + 1))
        for x in np.flatnonzero(np.diff(edge)):
            c, s = cols[edge[x] : edge[x + 1]] + at, exact[edge[x] : edge[x + 1]]
            if keep[x]:
                c, s = np.append(keep[x][0][0], c), np.append(keep[x][0][1], s)
            best = np.lexsort((cand_key[c], -s))[:k]
            keep[x] = [(c[best], s[best])]
            if len(best) == k:
                low[x] = max(low[x], s[best[-1]])
    for x, found in enumerate(keep):
        if found:
            yield x, *found[0]


def nearest(vectors: DataFrame, queries: DataFrame | None = None, every: int = 20, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query the k largest inner products, in double precision.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own. Ties go to the smaller id. Vectors that are null,
    empty, all zero, or hold null or non-finite numbers take no part, nor do
    rows without an id. All vectors must have one length; otherwise the most
    frequent length counts and rows of others take no part. A row that repeats
    is a candidate each time, and a query each time. Tables with fewer
    candidates give all of them. Other columns are not read.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("size", F.size("v")))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size, total = (sizes[0]["size"], sizes[0]["n"]) if sizes else (0, 0)
    rows = rows.where(F.col("size") == size)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    blocks = lambda n, most: max(1, -(-n // most))
    nq, nc = blocks(asked.count(), QUERY_BLOCK), blocks(total, CANDIDATE_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    flat = lambda: F.col("v")
    left = asked.select(block(nq).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("y"), "uid", "id", flat().alias("v"), F.lit(True).alias("asks"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("x"), block(nc).alias("y"), "uid", "id", flat().alias("v"), F.lit(False).alias("asks"))

    def cell(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["asks"].to_numpy()
        uid, ids = t["uid"].to_numpy(), t["id"].to_numpy()
        m = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: list[list] = [[], [], [], []]
        if len(q) and len(c):
            for x, found, score in tile_top(m[q], uid[q], m[c], uid[c], ids[c], k):
                n = len(found)
                for col, new in zip(out, (np.full(n, uid[q[x]]), np.full(n, ids[q[x]]), ids[c[found]], score), strict=True):
                    col.append(new)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate([*o, np.zeros(0, kind)]) for n, o, kind in zip(("uid", "query_id", "vec_id", "score"), out, kinds, strict=True)})

    found = left.unionByName(right).groupBy("x", "y").applyInArrow(cell, "uid long, query_id long, vec_id long, score double")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        names: dict[int, int] = {}
        for f in frames:
            for u, q, i, s in zip(f["uid"].tolist(), f["query_id"].tolist(), f["vec_id"].tolist(), f["score"].tolist(), strict=True):
                names[u] = q
                heap = heaps.setdefault(u, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
        part: list[tuple] = []
        for u, heap in heaps.items():
            part += [(names[u], r, -i, s) for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(part, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})

    return found.repartition("uid").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
