"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all passages of all documents sums, per partition, the terms'
   passage counts and A'(A W) for the passage-term matrix A and a random test
   matrix W. Every word of a passage is a term: words of the benchmark each,
   others by hash in CONTEXT classes, so that the matrix is of bounded size.
   The weighting by inverse document frequency is diagonal and is applied to
   the sums. From these the Nystroem form of the randomised SVD gives the
   leading right singular vectors of the TF-IDF matrix.
2. Windows of the texts and benchmark items are sums of the latent vectors of
   their distinct terms. A window whose cosine to an item reaches a bound is a
   candidate for it; there is no other way to become one.
3. Candidates are decided on the words: a longest-common-subsequence check
   and, where the benchmark names answers, an answer check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

PASSAGE, RANK, SPARE = 64, 96, 8
CONTEXT, CONTEXT_WEIGHT = 4096, 0.4
ITEMS = 16_384
COMMON = 0.1
UNIT, STEPS = 4, 5  # windows are STEPS times as long as their distance, which is UNIT words times a power of 2
SPAN, PART = 1 << 16, 1 << 15
DENSE = 1 << 26
#: Items of fewer words are found as exact phrases; bytes of items that are searched in one pass; tasks that sum for the singular vectors.
LEAST_WORDS, ITEM_BYTES, SUM_TASKS = 5, 32 << 20, 16_384


class Terms:
    """Term of each word: its place in the sorted vocabulary, or a class of the other words behind that."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.cells = np.uint64((1 << max(16, int(len(vocabulary)).bit_length() + 4)) - 1)
        cell = (vocabulary & self.cells).astype(np.int64)
        self.first = np.zeros(int(self.cells) + 1, np.int32)
        self.first[cell[::-1]] = np.arange(len(vocabulary))[::-1]
        self.shared = np.zeros(int(self.cells) + 1, bool)  # cells of several words of the vocabulary
        self.shared[cell[self.first[cell] != np.arange(len(vocabulary))]] = True

    def __call__(self, w: kernel.Words) -> np.ndarray:
        n = len(self.vocabulary)
        cell = (w.hash & self.cells).astype(np.int64)
        at = self.first[cell].astype(np.int64)
        out = np.where(self.vocabulary[at] == w.hash, at, n + (w.hash & np.uint64(CONTEXT - 1)).astype(np.int64))
        many = np.flatnonzero(self.shared[cell])
        if len(many):
            h = w.hash[many]
            at = np.minimum(np.searchsorted(self.vocabulary, h), n - 1)
            out[many] = np.where(self.vocabulary[at] == h, at, out[many])
        return out


def _test_matrix(terms: int) -> np.ndarray:
    return np.random.default_rng(4).standard_normal((terms, RANK + SPARE)).astype(np.float32)


def sums_by(rows: np.ndarray, table: np.ndarray, owner: np.ndarray, out: np.ndarray, sign: int = 1) -> None:
    """Add table[rows[i]], or take it off, to out[owner[i]]; owner ascends. The k-th rows of all owners go in one step; of owners with many rows PART at once."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(np.append(first, len(owner)))
    rank = np.arange(len(owner)) - np.repeat(first, size)
    short = np.flatnonzero(np.repeat(size <= PASSAGE, size))
    order = short[np.argsort(rank[short].astype(np.uint8), kind="stable")]
    for part in np.split(order, np.cumsum(np.bincount(rank[short]))[:-1]) if len(order) else ():
        out[owner[part]] += sign * table[rows[part]]
    for a, n in zip(first[size > PASSAGE].tolist(), size[size > PASSAGE].tolist()):
        for b in range(a, a + n, PART):
            out[owner[a]] += sign * table[rows[b : min(b + PART, a + n)]].sum(axis=0)


def latent_space(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per term its inverse document frequency over all passages, and its row of the singular vectors, each divided by its singular value."""
    n = len(vocabulary) + CONTEXT
    width = RANK + SPARE

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, terms = np.append(_test_matrix(n), np.zeros((1, width), np.float32), axis=0), Terms(vocabulary)
        count, df, z = 0, np.zeros(n), np.zeros((n, width))
        for batch in kernel.sliced(batches, 0, size=1 << 20):
            w = kernel.words(batch.column(0), "alnum")
            size = np.diff(w.first)
            per_doc = -(-size // PASSAGE)
            base = np.cumsum(per_doc) - per_doc
            count += int(per_doc.sum())
            if not len(w.hash):
                continue
            place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], size)
            pairs = np.sort((np.repeat(base, size) + place // PASSAGE) * n + terms(w))
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            passage, term = pairs // n, pairs % n
            df += np.bincount(term, minlength=n)
            many = np.bincount(passage, minlength=int(per_doc.sum()))
            grid = np.full((len(many), int(many.max())), n)  # distinct terms of each passage, PASSAGE at most
            grid[passage, np.arange(len(pairs)) - np.repeat(np.cumsum(many) - many, many)] = term
            y = test[grid[:, 0]]
            for k in range(1, grid.shape[1]):
                y += test[grid[:, k]]
            order = np.argsort(term, kind="stable")
            part = np.zeros((n, width), np.float32)
            sums_by(passage[order], y, term[order], part)
            z += part
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(float(count), df).tobytes()]), pa.array([z.astype(np.float32).tobytes()])], names=["df", "z"])

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, z = np.zeros(n + 1), np.zeros(n * width)
        for f in frames:
            for a, b in zip(f["df"], f["z"]):
                df += np.frombuffer(a)
                z += np.frombuffer(b, np.float32)
        if df[0]:
            yield pd.DataFrame({"df": [df.tobytes()], "z": [z.astype(np.float32).tobytes()]})

    tasks = texts.rdd.getNumPartitions()
    if tasks > SUM_TASKS:  # so that the sums are of bounded size for any input
        texts, tasks = texts.coalesce(SUM_TASKS), SUM_TASKS
    parts = texts.mapInArrow(sums, "df binary, z binary")
    groups = max(1, int(tasks**0.5))
    while groups:  # a tree of sums: no task takes in more than about the square root of all partitions
        parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(groups, "g").drop("g").mapInPandas(total, "df binary, z binary")
        groups = int(groups**0.5) if groups > 8 else 0
    df, z = np.zeros(n + 1), np.zeros(n * width)
    for r in parts.toLocalIterator():  # at most eight rows
        df += np.frombuffer(r["df"])
        z += np.frombuffer(r["z"], np.float32)
    if not df[0]:
        return np.ones(n), np.zeros((n, 1), np.float32)
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1e-3
    z = z.reshape(n, width)
    core = _test_matrix(n).T.astype(float) @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 0) * 1e-9
    if not good.any():
        return idf, np.zeros((n, 1), np.float32)
    factor = (idf[:, None] * z) @ (vector[:, good] / np.sqrt(value[good]))
    u, size, _ = np.linalg.svd(factor, full_matrices=False)
    k = min(RANK, int((size > size[0] * 1e-6).sum()))
    return idf, (u[:, :k] / size[:k]).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-12)


def blocks_of(first: np.ndarray, term: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows over each UNIT words of each document, with a row of zeros at the end, and where each document's blocks begin."""
    size = np.diff(first)
    many = -(-size // UNIT)
    base = np.append(0, np.cumsum(many))
    grid = np.full((int(base[-1]) + 1) * UNIT, len(table) - 1)  # the last row is zero
    grid[np.repeat(base[:-1] * UNIT - first[:-1], size) + np.arange(len(term))] = term
    grid = grid.reshape(-1, UNIT)
    out = table[grid[:, 0]]
    for k in range(1, UNIT):
        out += table[grid[:, k]]
    return out, base


def repeats_of(first: np.ndarray, term: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each two successive words of a document that are one live term, by the later place."""
    order = np.argsort(term.astype(np.int16) if len(live) < 1 << 15 else term, kind="stable")
    t = term[order]
    same = np.flatnonzero((t[1:] == t[:-1]) & live[t[1:]])
    was, now = order[same], order[same + 1]
    doc = np.searchsorted(first, np.stack([was, now]), "right")
    keep = np.flatnonzero(doc[0] == doc[1])
    keep = keep[np.argsort(now[keep])]
    return was[keep], now[keep]


def windows(first: np.ndarray, term: np.ndarray, table: np.ndarray, blocks: tuple[np.ndarray, np.ndarray], again: tuple[np.ndarray, np.ndarray], k: int, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of STEPS * k blocks, k blocks apart: document, place of the first word, and the sum of table rows over the window's distinct live terms.

    first: where each document's terms begin in ``term``, and the end. A
    shorter document is one window, a document without words none. ``wanted``
    tells from documents and places which windows are to be summed (all).
    """
    fine, begin = blocks
    many = np.diff(begin)
    slots = np.where(many > 0, np.maximum(-(-many // k), STEPS), 0)
    here = np.where(slots > 0, slots - STEPS + 1, 0)
    start = np.cumsum(here) - here  # of each document's windows
    doc = np.repeat(np.arange(len(slots)), here)
    index = np.arange(len(doc)) - np.repeat(start, here)
    alive = np.arange(len(doc)) if wanted is None else np.flatnonzero(wanted(doc, index * k * UNIT))
    number = np.full(len(doc), -1)
    number[alive] = np.arange(len(alive))
    all_docs, (doc, index) = slots, (doc[alive], index[alive])
    if 4 * len(alive) < len(number):  # few windows, each from its blocks
        out = np.zeros((len(alive), table.shape[1]), np.float32)
        at, stop = begin[doc] + index * k, begin[doc + 1]
        for t in range(STEPS * k):
            out += fine[np.where(at + t < stop, at + t, len(fine) - 1)]
    else:  # from sums of k blocks
        base = np.cumsum(all_docs) - all_docs
        within = np.arange(len(fine) - 1) - np.repeat(begin[:-1], many)
        slot = np.repeat(base, many) + within // k
        sums = np.zeros((int(all_docs.sum()), table.shape[1]), np.float32)
        for r in range(k):
            part = np.flatnonzero(within % k == r) if k > 1 else slice(0, len(within))
            if r:
                sums[slot[part]] += fine[part]
            else:
                sums[slot[part]] = fine[part]
        every = sums[: len(sums) - STEPS + 1].copy()
        for j in range(1, STEPS):
            every += sums[j : len(sums) - STEPS + 1 + j]
        out = every[base[doc] + index]
    # a term of two places counts once in the windows that hold both: the later place is taken off
    was, now = again
    near = np.flatnonzero(now - was < (STEPS + 1) * k * UNIT)
    was, now = was[near], now[near]
    of = np.searchsorted(first, now, "right") - 1
    low = np.maximum((now - first[of]) // (UNIT * k) - STEPS + 1, 0)
    high = np.minimum((was - first[of]) // (UNIT * k), all_docs[of] - STEPS)
    times = np.maximum(high - low + 1, 0)
    at = number[np.repeat(start[of] + low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
    row = np.repeat(term[now], times)[at >= 0]
    at = at[at >= 0]
    order = np.argsort(at, kind="stable")
    sums_by(row[order], table, at[order], out, -1)
    return doc, index * k * UNIT, out


def pieces(first: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in groups of about SPAN words, longer ones in pieces that overlap by ``reach`` words: document, place in it, length."""
    span = max(SPAN, 4 * reach)
    size = np.diff(first)
    many = np.maximum(1, -(-(size - reach) // (span - reach)))
    doc = np.repeat(np.arange(len(size)), many)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * (span - reach)
    length = np.minimum(size[doc] - start, span)
    a, filled = 0, np.cumsum(length)
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(filled, (filled[a - 1] if a else 0) + span, "right")))
        yield doc[a:b], start[a:b], length[a:b]
        a = b


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item of n words; masks: its places by word, as bits."""
    full = (1 << n) - 1
    v = full
    for x in words:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", cosine: float = 0.3, share: float = 0.6, answer: float = 0.6, phrase_words: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, common_words, item_words, cosine, at): benchmark items found in documents.

    Words are runs of ASCII letters, digits and non-ASCII characters, in lower
    case. A window of the text, 1.25 to 2.5 times as long as the item, is a
    candidate if its latent cosine to the item is at least ``cosine``. It is a
    hit if a subsequence of ``share`` of the item's words is in it and, where
    the benchmark has a column ``answer`` and the item's holds words,
    ``answer`` of the distinct words of that. ``at`` is the first word of the
    window with the longest such subsequence (the first of several). A document
    has one row for each item found; documents that repeat have rows each.
    Items that repeat in all columns count once; equal ids with different
    texts or answers are different items. Null and empty texts hold nothing.
    Items of fewer than LEAST_WORDS words, but ``phrase_words`` at least, have
    too few terms for a cosine: they are found where their words stand next to
    each other in order, whatever the answer (``cosine`` is null). Items of fewer words, null or
    empty ones are not looked for. All items are searched in one pass; beyond
    ITEMS of them, or ITEM_BYTES of text, there is a pass for each part of
    about that size, so that what is sent to the tasks is bounded (an item of
    more bytes is a pass of its own size). Other columns are not read.
    """
    has_answer = "answer" in benchmark.columns
    items = benchmark.select("item_id", F.col("text"), (F.col("answer") if has_answer else F.lit(None)).cast("string").alias("answer")).where("text is not null").dropDuplicates()
    many = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0))).alias("size")).first()
    passes = max(1, -(-many["n"] // ITEMS), -(-(many["size"] or 0) // ITEM_BYTES))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for b in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(passes)) == b)
        found = _search(rows, part, cosine, share, answer, phrase_words)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("doc_id", doc_id)


def _phrases(docs: DataFrame, phrases: list[tuple[int, np.ndarray]]) -> DataFrame:
    """Rows as of ``_search`` for items (number, word hashes) of few words: where they first stand in a document as they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    by_size: dict[int, dict[int, list[int]]] = {}
    for k, h in phrases:
        by_size.setdefault(len(h), {}).setdefault(int(kernel.grams(h, len(h))[0]), []).append(k)
    sought = {m: (np.sort(np.array(list(keys), np.uint64)), keys) for m, keys in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 1):
            w = kernel.words(batch.column(1), "alnum")
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for m, (sorted_, keys) in sought.items():
                g = kernel.grams(w.hash, m)
                at = np.flatnonzero(sorted_[np.minimum(np.searchsorted(sorted_, g), len(sorted_) - 1)] == g)
                doc = np.searchsorted(w.first, at, "right") - 1
                whole = at + m <= w.first[doc + 1]
                for d, a, x in zip(doc[whole].tolist(), (at - w.first[doc])[whole].tolist(), g[at[whole]].tolist(), strict=True):
                    for k in keys[x]:
                        best.setdefault((d, k), (m, a))
            rows = sorted(best.items())
            numbers = lambda x, t: pa.array(list(x), t)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(numbers((d for (d, _), _ in rows), pa.int64())), numbers((k for (_, k), _ in rows), pa.int32()), numbers((m for _, (m, _) in rows), pa.int32()),
                    numbers((m for _, (m, _) in rows), pa.int32()), pa.nulls(len(rows), pa.float64()), numbers((a for _, (_, a) in rows), pa.int64()),
                ],
                names=["doc_id", "item", "common_words", "item_words", "cosine", "at"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, item int, common_words int, item_words int, cosine double, at long")


def _search(docs: DataFrame, part: DataFrame, cosine: float, share: float, answer: float, phrase_words: int) -> DataFrame:
    spark = docs.sparkSession
    items = part.collect()
    cut = lambda texts: (lambda w: [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(texts))])(kernel.words(pa.array(texts, pa.string()), "alnum"))
    words = cut([r["text"] for r in items])
    use = [i for i, x in enumerate(words) if len(x) >= LEAST_WORDS]
    few = [i for i, x in enumerate(words) if max(1, phrase_words) <= len(x) < LEAST_WORDS]
    names = spark.createDataFrame([(k, items[i]["item_id"]) for k, i in enumerate(use + few)], f"item int, item_id {part.schema['item_id'].dataType.simpleString()}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = lambda found: found.join(F.broadcast(names), "item").select("doc_id", "item_id", "common_words", "item_words", "cosine", "at")
    phrases = named(_phrases(docs, [(len(use) + k, words[i]) for k, i in enumerate(few)])) if few else None
    if not use and phrases is not None:
        return phrases
    if not use:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {part.schema['item_id'].dataType.simpleString()}, common_words int, item_words int, cosine double, at long")
    answers = cut([r["answer"] or "" for r in items])
    words, answers = [words[i] for i in use], [set(answers[i].tolist()) for i in use]
    vocabulary = np.unique(np.concatenate(words))
    idf, vectors = latent_space(docs.select("text"), vocabulary)
    n = len(vocabulary)
    place = [np.unique(np.searchsorted(vocabulary, w)) for w in words]
    table = np.append(idf[:, None] * vectors, np.zeros((1, vectors.shape[1])), axis=0).astype(np.float32)
    table[n:] *= CONTEXT_WEIGHT
    common = np.append(idf < -np.log(COMMON), True)
    for p in place:
        if (~common[p]).sum() < LEAST_WORDS:  # an item of common terms alone keeps them
            common[p] = False
    table[common] = 0
    latent = unit(np.array([table[p].sum(axis=0) for p in place]))
    length = np.array([len(w) for w in words])
    level = np.maximum(np.ceil(np.log2(length)), np.log2(UNIT * (STEPS - 1))).astype(int)
    classes = [(int((1 << u) // (UNIT * (STEPS - 1))), np.flatnonzero(level == u)) for u in np.unique(level)]
    shared = spark.sparkContext.broadcast((vocabulary, table, latent, place, words, answers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table, latent, place, words, answers = shared.value
        n = len(vocabulary)
        live = (table != 0).any(axis=1)
        holds = np.concatenate([i * n + p for i, p in enumerate(place)])  # (item, term) pairs, ascending
        member = None
        if n * len(place) <= DENSE:
            member = np.zeros(n * len(place), bool)
            member[holds] = True
        masks: dict[int, dict[int, int]] = {}
        distinct = [set(x.tolist()) for x in words]
        terms = Terms(vocabulary)
        needs = []  # of each class of items: their terms, and the words that a hit has at least
        for _, members in classes:
            known = np.zeros(len(table), bool)
            known[np.concatenate([place[i] for i in members])] = True
            needs.append((known, share * length[members].min()))

        def held(pair: np.ndarray) -> np.ndarray:
            return member[pair] if member is not None else holds[np.minimum(np.searchsorted(holds, pair), len(holds) - 1)] == pair

        def decide(best: dict, doc: np.ndarray, at: np.ndarray, begin: np.ndarray, stop: np.ndarray, item: np.ndarray, cos: np.ndarray, term: np.ndarray, h: np.ndarray) -> None:
            """Keep of the candidates (places in term and h from begin to stop) those that are hits."""
            size = stop - begin
            flat = term[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]
            known = np.flatnonzero(flat < n)
            known = known[held(np.repeat(item * n, size)[known] + flat[known])]
            inside = np.bincount(np.repeat(np.arange(len(size)), size)[known], minlength=len(size))
            enough = np.flatnonzero(inside >= share * length[item])  # no common subsequence is longer than the words that are the item's
            for x in enough.tolist():
                i, key = int(item[x]), (int(doc[x]), int(item[x]))
                there = h[int(begin[x]) : int(stop[x])].tolist()
                most = min(int(inside[x]), len(distinct[i].intersection(there)) + len(words[i]) - len(distinct[i]))
                if most < share * len(words[i]) or most <= best.get(key, (0,))[0]:
                    continue
                if i not in masks:
                    masks[i] = {}
                    for j, y in enumerate(words[i].tolist()):
                        masks[i][y] = masks[i].get(y, 0) | 1 << j
                common = common_subsequence(masks[i], len(words[i]), there)
                if common >= share * len(words[i]) and common > best.get(key, (0,))[0] and len(answers[i].intersection(there)) >= answer * len(answers[i]):
                    best[key] = (common, float(cos[x]), int(at[x]))

        for batch in kernel.sliced(batches, 1, size=1 << 20):
            w = kernel.words(batch.column(1), "alnum")
            every = terms(w)
            best: dict[tuple[int, int], tuple[int, float, int]] = {}
            for docs_, starts, sizes in pieces(w.first, STEPS * UNIT * max(k for k, _ in classes)):
                first = np.append(0, np.cumsum(sizes))
                if not first[-1]:
                    continue
                flat = np.arange(first[-1]) + np.repeat(w.first[docs_] + starts - first[:-1], sizes)
                term, h = every[flat], w.hash[flat]
                blocks, again = blocks_of(first, term, table), repeats_of(first, term, live)
                for (k, members), (known, least) in zip(classes, needs, strict=True):
                    seen = np.append(0, np.cumsum(known[term], dtype=np.int32))

                    def enough(piece: np.ndarray, at: np.ndarray) -> np.ndarray:
                        """Windows with as many words of the class's items as a hit of its shortest one has: there is none elsewhere."""
                        a = first[piece] + at  # noqa: B023
                        return seen[np.minimum(a + STEPS * UNIT * k, first[piece + 1])] - seen[a] >= least  # noqa: B023

                    piece, at, sums = windows(first, term, table, blocks, again, k, enough)
                    begin = first[piece] + at
                    stop = np.minimum(begin + STEPS * UNIT * k, first[piece + 1])
                    few = max(1, (1 << 22) // len(members))
                    for a in range(0, len(piece), few):
                        cos = (unit(sums[a : a + few]) @ latent[members].T).ravel()
                        hits = np.flatnonzero(cos >= cosine)
                        for b in range(0, len(hits), PART):
                            x, y = np.divmod(hits[b : b + PART], len(members))
                            x += a
                            decide(best, docs_[piece[x]], starts[piece[x]] + at[x], begin[x], stop[x], members[y], cos[hits[b : b + PART]], term, h)
            rows = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([d for (d, _), _ in rows], pa.int64())),
                    pa.array([i for (_, i), _ in rows], pa.int32()),
                    pa.array([c for _, (c, _, _) in rows], pa.int32()),
                    pa.array([int(length[i]) for (_, i), _ in rows], pa.int32()),
                    pa.array([c for _, (_, c, _) in rows], pa.float64()),
                    pa.array([a for _, (_, _, a) in rows], pa.int64()),
                ],
                names=["doc_id", "item", "common_words", "item_words", "cosine", "at"],
            )

    found = docs.mapInArrow(run, f"doc_id {kind}, item int, common_words int, item_words int, cosine double, at long")
    return named(found) if phrases is None else named(found).unionByName(phrases)
