"""Removal of passages that recur anywhere in the corpus, by repeated-phrase automata.

1. Anchors. Each window of ``window`` words selects the smallest hash among
   its runs of ``phrase`` words (leftmost on ties). Equal windows select equal
   anchors, and neighbouring windows mostly share one, so there are far fewer
   anchors than windows. Anchors are counted over the whole corpus.
2. Anchors seen at least twice are marked in a bitmap of fixed size; a false
   mark costs work, never a wrong result.
3. Stretches of text whose windows select a marked anchor go to the shard of
   that anchor, where equal passages meet. Hashes of the shard's windows
   choose the passages that seem to recur; one place of each is kept.
4. Automata. A shard compiles these passages into Aho-Corasick automata of
   bounded size and streams all its stretches through them. What the automata
   find at two places or more, and nothing else, is removed from every place
   that the stretch has in a text.

A document is sent to the shards of its own anchors only: a shard's automata
hold all passages that a stretch can contain, and streaming every document
through every shard would grow with the square of the corpus. Texts are named
by their MD5, so a text that many rows repeat is handled once for each batch.
Anchors seen very often go to shards by whole window instead of by anchor, so
that no anchor's stretches meet in one task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import stored

MARK_BITS, HOT_BITS, HOT_COUNT = 28, 20, 20_000
PLACE = np.uint64((1 << 30) - 1)
SHARD_BYTES, PATTERNS, POOL_BYTES = 1 << 19, 1 << 13, 16 << 20


def selected(w: kernel.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with a common anchor: anchor hash, first and last window start."""
    g = kernel.grams(w.hash, phrase)
    reach = window - phrase + 1
    n = len(w.hash) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none
    v = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    v = np.minimum(v[:n], v[reach - span : reach - span + n])
    inside = np.zeros(n, bool)
    size = np.diff(w.first)
    for a, m in zip(w.first[:-1][size >= window], size[size >= window], strict=True):
        inside[a : a + m - window + 1] = True
    start = np.flatnonzero(inside)
    at = (v[start] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1 if len(at) else new
    return g[at[new]], start[new], start[last]


def _anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 0):
            a, n = np.unique(selected(kernel.words(batch.column(0)), window, phrase)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def _bitmaps(anchors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Marks of recurring and of very frequent anchors, by the low bits of their hashes; both of fixed size."""
    # Spark numbers the bits of a bitmap from 1
    cells = anchors.select(
        F.explode(
            F.when(F.col("n") >= HOT_COUNT, F.array(*(F.struct(F.lit(b).alias("bits"), (F.col("anchor").bitwiseAND((1 << b) - 1) + 1).alias("cell")) for b in (MARK_BITS, HOT_BITS)))).otherwise(
                F.array(F.struct(F.lit(MARK_BITS).alias("bits"), (F.col("anchor").bitwiseAND((1 << MARK_BITS) - 1) + 1).alias("cell")))
            )
        ).alias("c")
    ).select("c.*")
    maps = cells.groupBy("bits", F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("map"))
    out = {b: np.zeros((1 << b) // 8, np.uint8) for b in (MARK_BITS, HOT_BITS)}
    for r in maps.toLocalIterator():  # at most 2^28 / 2^15 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        out[r["bits"]][at : at + 4096] = np.frombuffer(r["map"], np.uint8)
    return out[MARK_BITS], out[HOT_BITS]


def _marked(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    cell = anchors & np.uint64(8 * len(bits) - 1)
    return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _stretches(docs: DataFrame, marks, window: int, phrase: int) -> DataFrame:
    """Stretches with a marked anchor: rows (seg, text_key, start) for their places, and rows (seg, route, words, n) for their words.

    A task sends the words of equal stretches once for each POOL_BYTES of different ones, with their number n.
    """
    names = ["seg", "text_key", "start", "route", "words", "n"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def batch_of(*cols: list) -> pa.RecordBatch:
        size = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(c, k) if c is not None else pa.nulls(size, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, hot = marks.value
        pool: dict[bytes, list] = {}
        held = 0
        for batch in kernel.sliced(batches, 0):
            data, o = kernel.buffers(batch.column(0))
            digests = [hashlib.md5(data[o[i] : o[i + 1]]).digest() for i in range(len(o) - 1)]
            copies = Counter(digests)
            w = kernel.words(batch.column(0))
            anchor, first, last = selected(w, window, phrase)
            stay = _marked(mark, anchor)
            anchor, first, last = anchor[stay], first[stay], last[stay]
            often = _marked(hot, anchor)
            doc = np.searchsorted(w.first, first, "right") - 1
            segs: list[bytes] = []
            texts: list[bytes] = []
            starts: list[int] = []
            seen: dict[bytes, int] = {}
            for a, s, e, d, h in zip(anchor.view(np.int64).tolist(), first.tolist(), last.tolist(), doc.tolist(), often.tolist(), strict=True):
                key = digests[d]
                if seen.setdefault(key, d) != d:
                    continue
                for x, y in [(i, i) for i in range(s, e + 1)] if h else [(s, e)]:
                    text = b" ".join(w.text(x, y + window).split())
                    seg = hashlib.blake2b(text, digest_size=16).digest()
                    if (there := pool.get(seg)) is not None:
                        there[2] += copies[key]
                    else:
                        pool[seg] = [int.from_bytes(seg[:8], "little", signed=True) if h else a, text, copies[key]]
                        held += len(text) + 200
                    segs.append(seg)
                    texts.append(key)
                    starts.append(x - int(w.first[d]))
            yield batch_of(segs, texts, starts, None, None, None)
            if held > POOL_BYTES:
                yield batch_of(list(pool), None, None, *map(list, zip(*pool.values())))
                pool, held = {}, 0
        if pool:
            yield batch_of(list(pool), None, None, *map(list, zip(*pool.values())))

    return docs.mapInArrow(run, "seg binary, text_key binary, start long, route long, words binary, n long")


def candidates(w: kernel.Words, n: np.ndarray, window: int) -> np.ndarray:
    """First places of the passages of ``window`` words that may recur in texts that count n times each: those whose hash does."""
    g = kernel.grams(w.hash, window)
    if not len(g):
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(n)), np.diff(w.first))
    at = np.flatnonzero(text[: len(g)] == text[window - 1 :])
    if not len(at):
        return at
    order = np.argsort(g[at], kind="stable")
    lead = np.flatnonzero(np.append(True, np.diff(g[at][order]) != 0))
    return at[order[lead]][np.add.reduceat(n[text[at[order]]], lead) > 1]


def located(group: dict[bytes, tuple[bytes, int]], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of stretches by name, as words and the number of their places: name, first word and end of each piece that consists of recurring passages.

    The passages are compiled into automata of PATTERNS each, and all the
    stretches are streamed through each. A passage recurs if an automaton finds
    it at two places; hashes only choose what is compiled.
    """
    names, n = list(group), np.array([k for _, k in group.values()], np.int64)
    w = kernel.words(pa.array([text for text, _ in group.values()], pa.large_binary()))
    symbol, start = kernel.symbols(w).tolist(), candidates(w, n, window).tolist()
    hits: list[np.ndarray] = []
    texts = [tuple(symbol[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)] if start else []
    for a in range(0, len(start), PATTERNS):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, x in enumerate(start[a : a + PATTERNS]):
            machine.add_word(tuple(symbol[x : x + window]), i)
        machine.make_automaton()
        seen = array("q")
        for i, text in enumerate(texts):
            for end, k in machine.iter(text):
                seen.extend((i, end, k))
        found = np.frombuffer(seen, np.int64).reshape(-1, 3) if seen else np.zeros((0, 3), np.int64)
        times = np.bincount(found[:, 2], n[found[:, 0]])
        hits.append(found[times[found[:, 2]] > 1, :2])
    if not hits or not sum(map(len, hits)):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, end = np.concatenate(hits).T
    order = np.lexsort((end, of))
    of, end = of[order], end[order] + 1
    new = np.append(True, (np.diff(of) != 0) | (np.diff(end) > window))
    lead = np.flatnonzero(new)
    return [names[i] for i in of[lead].tolist()], end[lead] - window, end[np.append(lead[1:], len(end)) - 1]


def _located(stretches: DataFrame, window: int) -> DataFrame:
    """Rows (seg, lo, hi): the words of each distinct stretch at which automata find recurring passages. A shard is some whole routes."""

    def batch_of(names: list[bytes], lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["seg", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[bytes, tuple[bytes, int]] = {}
        last, size = None, 0
        for batch in batches:
            for route, seg, words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if route != last and size > SHARD_BYTES:
                    yield batch_of(*located(group, window))
                    group, size = {}, 0
                last = route
                if seg not in group:
                    size += len(words)
                group[seg] = (words, n + group.get(seg, (b"", 0))[1])
        if group:
            yield batch_of(*located(group, window))

    words = stretches.where("words is not null").select("route", "seg", "words", "n")
    return words.repartition("route").sortWithinPartitions("route").mapInArrow(run, "seg binary, lo long, hi long")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, phrase: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, text, n_words, n_removed, spans, kept, and the columns ``keep``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A window is
    ``window`` consecutive words of one text; every word is removed that lies
    in a window whose words also start at any other place, in the same or
    another row, overlapping or not. Windows are judged on the input. ``spans``
    holds the removed word ranges [lo, hi) in order, ``kept`` the other words
    joined by one space. Rows are kept as they are otherwise: rows that repeat
    (texts or ids) count as different places, null, empty and short texts have
    no windows. Other columns are not read unless ``keep`` names them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    marks = spark.sparkContext.broadcast(_bitmaps(_anchors(texts, window, phrase)))
    stretches = stored(_stretches(texts, marks, window, phrase), "stretches")
    located = _located(stretches, window)
    spans = (
        stretches.where("start is not null")
        .select("seg", "text_key", "start")
        .join(located, "seg")
        .select("text_key", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("span"))
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    types = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 1):
            w = kernel.words(batch.column(1))
            size, removed, kept, merged = np.diff(w.first), [], [], []
            lists = batch.column(2)
            for i in range(batch.num_rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                cover: list[list[int]] = []
                for span in lists[i].as_py() or ():
                    if cover and span["lo"] <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], span["hi"])
                    else:
                        cover.append([span["lo"], span["hi"]])
                parts, at = [], a
                for lo, hi in [*cover, (b - a, b - a)]:
                    if a + lo > at:
                        parts += w.text(at, a + lo).split()
                    at = a + hi
                kept.append(b" ".join(parts))
                removed.append(sum(hi - lo for lo, hi in cover))
                merged.append([{"lo": lo, "hi": hi} for lo, hi in cover])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[3:]],
                names=["doc_id", "text", "n_words", "n_removed", "spans", "kept", *keep],
            )

    out = rows.join(spans, "text_key", "left").select("doc_id", "text", "spans", *keep).mapInArrow(run, f"doc_id {types}, text string, n_words long, n_removed long, spans array<struct<lo:long,hi:long>>, kept string{carried}")
    return out.withColumnsRenamed({"doc_id": doc_id, "text": text})
