"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. One pass over the texts gives each document's shingle set as 64-bit hashes,
   its size, its digest, and band keys of a MinHash signature.
2. Documents with equal sets are one class; everything after works on classes,
   so copies, however many, cost one row each.
3. Candidates share a band key. A bucket's pivot is the member that shares
   most buckets with others; each class meets the best pivot of its buckets.
   Pairs go through batches of signature positions and are dropped as soon as
   the posterior probability of reaching the threshold is below ``miss``; the
   survivors are checked on full sets. Found links contract the buckets. What
   is left of a bucket, pairs of different components, is decided in cells of
   two blocks by the same tests, so that no candidate goes without a decision,
   while a group of many near copies mostly costs one comparison a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .scratch import durable

BANDS, ROWS = 20, 5
HASHES = BANDS * ROWS
_A = (kernel.splitmix(HASHES, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (kernel.splitmix(HASHES, 6) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text: its distinct k-word shingles as sorted hashes (see ``similar_classes``)."""
    w = kernel.words(column, lower=True)
    g = kernel.grams(w.hash, k)
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield kernel.grams(w.hash[a:b], b - a, seed=b - a + 1)
        else:
            yield np.zeros(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        np.minimum(out, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return kernel.grams(sig.astype(np.uint64), ROWS, seed=9)[::ROWS]


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def profile(docs: DataFrame, text: str, k: int, keep: list[str]) -> DataFrame:
    """Columns keep, n_shingles, digest, bands (null for an empty set)."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_shingles long", "digest binary", "bands array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, len(keep)):
            size, dig, bands = [], [], []
            for items in shingle_sets(batch.column(len(keep)), k):
                size.append(len(items))
                dig.append(digest(items) if len(items) else None)
                bands.append(band_keys(signature(items)).view(np.int64) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(size, pa.int64()), pa.array(dig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*keep, "n_shingles", "digest", "bands"],
            )

    return docs.select(*keep, text).mapInArrow(run, schema)


def details(docs: DataFrame, text: str, k: int) -> DataFrame:
    """From rows (node, text): node, sig, bands, items, of rows whose digest is the node; of rows that follow each other with one node the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in kernel.sliced(batches, 1, rows=500, size=2 << 20):
            node, sig, bands, items = [], [], [], []
            wanted = batch.column(0).to_pylist()
            new = [x != y for x, y in zip(wanted, [last, *wanted])]
            last = wanted[-1]
            batch = batch.filter(pa.array(new))
            for want, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(found) and digest(found) == want:
                    node.append(want)
                    mine = signature(found)
                    sig.append(mine.tobytes())
                    bands.append(band_keys(mine).view(np.int64))
                    items.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(items, pa.binary())], names=["node", "sig", "bands", "items"]
            )

    return docs.select("node", text).mapInArrow(run, "node binary, sig binary, bands array<long>, items binary")


def least_matches(threshold: float, miss: float, batch: int = 20) -> dict[int, int]:
    """For n compared positions the fewest matches m with P(J >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail is the lower tail of a binomial with n + 1 draws.
    """

    def tail(n: int, m: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(n, m) >= miss) for n in range(batch, HASHES + 1, batch)}


def survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch has ruled out."""
    at, hits, was = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in sorted(least.items()):
        hits = hits + (a[at, was:n] == b[at, was:n]).sum(axis=1)
        stay = hits >= m
        at, hits, was = at[stay], hits[stay], n
    return at


def _verify(pairs: DataFrame, detail: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of candidate pairs (a, b) those with 100 * |A and B| >= percent * |A or B|."""
    least = least_matches(percent / 100, miss)

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                yield f.iloc[survivors(x, y, least)][["a", "b"]]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 2, rows=1000, size=4 << 20):
            names, cols = batch.schema.names, batch.columns
            keep = []
            for x, y in zip(cols[2], cols[3], strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                small, large = (u, v) if len(u) <= len(v) else (v, u)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays(cols[:2], names=names[:2]).filter(pa.array(keep, pa.bool_()))

    def with_both(p: DataFrame, column: str, x: str, y: str) -> DataFrame:
        return p.join(detail.select(F.col("node").alias("a"), F.col(column).alias(x)), "a").join(detail.select(F.col("node").alias("b"), F.col(column).alias(y)), "b").select("a", "b", x, y)

    alive = with_both(pairs, "sig", "sa", "sb").mapInPandas(prune, "a binary, b binary")
    return with_both(alive, "items", "ia", "ib").mapInArrow(confirm, "a binary, b binary")


BLOCK = 1024


def _cell(f: pd.DataFrame, percent: int, least: dict[int, int]) -> list[tuple[int, int]]:
    """Row numbers of linked pairs of one cell that join components which nothing before has joined."""
    band = int(f["band"].iat[0])
    same = f["i"].iat[0] == f["j"].iat[0]
    sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, HASHES)
    bands = np.vstack(f["bands"])[:, :band]
    part = f["part"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in f["items"]]
    size = np.array([len(x) for x in sets])
    root = pd.factorize(f["label"])[0]
    items, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1  # an item of one row alone is in no intersection
    cols = [common[x[times[x] > 1]] for x in np.split(at, np.cumsum(size)[:-1])]
    wide = int((times > 1).sum())
    table = None
    if len(f) * wide <= 64 << 20:
        table = np.zeros((len(f), wide), np.uint8)
        for x, c in enumerate(cols):
            table[x, c] = 1
    out = []
    for x in range(len(f)):
        if not same and part[x] != f["i"].iat[0]:
            continue
        y = np.flatnonzero((root != root[x]) & ((np.arange(len(f)) > x) if same else (part != part[x])))
        y = y[~(bands[y] == bands[x]).any(axis=1)] if band else y  # an earlier bucket has the pair
        y = y[(100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        y = y[survivors(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], least)]
        if not len(y):
            continue
        if table is not None:
            both = table[np.ix_(y, cols[x])].sum(axis=1, dtype=np.int64)
        else:
            both = np.array([len(np.intersect1d(cols[x], cols[z], assume_unique=True)) for z in y])
        for z in y[100 * both >= percent * (size[y] + size[x] - both)].tolist():
            if root[z] != root[x]:
                root[root == root[z]] = root[x]
                out.append((x, z))
    return out


def _open(state: DataFrame) -> DataFrame:
    """Of rows (band, key, node, label) those in buckets of several labels, with the label ``top`` that most rows have (the largest of several), the bucket's rows m, and r, those with another label."""
    sizes = state.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "label")).alias("t"), F.sum("n").alias("m"), F.count("*").alias("labels")).where("labels > 1")
    return state.join(buckets.select("band", "key", F.col("t.label").alias("top"), "m", (F.col("m") - F.col("t.n")).alias("r")), ["band", "key"])


def _cells(members: DataFrame) -> DataFrame:
    """Rows (band, key, i, j, part, node, label): members of open buckets (``_open``), dealt to cells of two blocks.

    A bucket of up to BLOCK rows is one cell. In a larger one, rows of the
    label ``top`` have the block numbers -1, -2 and so on, the others 0, 1 and
    so on. Blocks of top rows never meet each other, so a bucket of m rows of
    which r have another label makes r * m / BLOCK rows and not m * m / BLOCK.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    is_top = (F.col("label") == F.col("top")) & (F.col("m") > BLOCK)
    spread = members.withColumns({"rest": F.when(F.col("m") > BLOCK, blocks(F.col("r"))).otherwise(1), "tops": blocks(F.col("m") - F.col("r"))})
    part = F.pmod(F.xxhash64("node"), F.when(is_top, F.col("tops")).otherwise(F.col("rest")).cast("long")).cast("int")
    spread = spread.withColumn("part", F.when(is_top, -1 - part).otherwise(part))
    meets = F.sequence(F.when(is_top, F.lit(0)).otherwise(F.when(F.col("m") > BLOCK, -F.col("tops")).otherwise(0)), F.col("rest") - 1)
    return spread.withColumn("other", F.explode(meets)).select("band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label")


def _leftovers(members: DataFrame, detail: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links between different labels within a bucket: all pairs are decided, block by block.

    A cell has two blocks of a bucket. It decides each pair in the first bucket
    that the two share, and returns fewer links than it has rows.
    """
    least = least_matches(percent / 100, miss)
    cells = _cells(members).join(detail, "node")

    def cell(f: pd.DataFrame) -> pd.DataFrame:
        nodes = f["node"].to_numpy()
        found = _cell(f, percent, least)
        return pd.DataFrame({"a": [nodes[x] for x, _ in found], "b": [nodes[y] for _, y in found]}, dtype=object)

    return cells.groupBy("band", "key", "i", "j").applyInPandas(cell, "a binary, b binary")


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Per row of docs: its id, n_shingles, component_id and kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case. A
    set holds the distinct runs of ``shingle`` words; a shorter text is one
    shingle. Null, empty and blank texts have an empty set, link with nothing
    and are their own component. Rows are linked when the Jaccard similarity
    of their sets is at least percent / 100, and component_id is the smallest
    id that can be reached over links. Rows that repeat an id are separate rows
    (kept each, if theirs is the smallest id). A null id never becomes a
    component_id: such a row takes the component of its links, else null, and
    is kept only when it has none. Other columns are not read.

    A class finds its text by a row key of id and text, so many rows of one id
    cost a row each; rows equal in both come once a task.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    row = F.unhex(F.concat(F.md5(F.col("text").cast("binary")), F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0"))).alias("row")
    rows = durable(profile(source.select("doc_id", row, "text"), "text", shingle, ["doc_id", "row"]))
    classes = durable(rows.where("digest is not null").groupBy(F.col("digest").alias("node"), "bands").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")))
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = durable(keys.join(shared, ["band", "key"]))
    degree = members.groupBy("node").agg(F.sum("m").alias("degree"))

    active = classes.join(degree.select("node"), "node", "left_semi").select("node", "row")
    detail = durable(details(source.select(row, "text").join(active, "row"), "text", shingle).dropDuplicates(["node"]))

    ranked = members.join(degree, "node")
    pivots = ranked.groupBy("band", "key").agg(F.max(F.struct("degree", "node")).alias("p"))
    chosen = ranked.join(pivots, ["band", "key"]).groupBy("node").agg(F.max("p").alias("p"))
    pairs = chosen.select(F.col("node").alias("a"), F.col("p.node").alias("b")).where("a <> b")
    edges = durable(_verify(pairs, detail, percent, miss))
    labels = components(edges)
    state = members.join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label"))
    found = durable(_leftovers(_open(state), detail, percent, miss))
    if found.limit(1).count():
        labels = components(edges.unionByName(found))

    lows = classes.select("node", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    linked = lows.join(labels.select("node"), "node", "left_semi").groupBy("label").agg(F.min("low").alias("component_low"))
    of_class = lows.join(linked, "label", "left").select(F.col("node").alias("digest"), F.coalesce("component_low", "low").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
