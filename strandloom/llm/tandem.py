"""Periodic runs of words, by the tandem repeats of a suffix tree.

1. Cut. A run of the lengths asked for repeats its period ``LEAST_EXPONENT``
   times, so each of its words occurs as often within it. Words that occur
   less often in their stretch of text lie in no run and cut it; stretches are
   counted again until none changes. What is left of a batch of texts is one
   string of symbols, with a symbol of its own between stretches.
2. Blocks. The string's Lempel-Ziv blocks are as long as anything that starts
   earlier. The leftmost occurrence of every square (a word sequence twice in
   a row) has its centre in a block and touches that block's first or the
   next one's first symbol with one of its halves; so common extensions of
   the two places around these symbols, for every period up to two blocks'
   lengths, give squares that cover all others from the left.
3. Walks. Each square found is marked in the suffix tree. A suffix link and
   one symbol lead from a square to the square that begins one word later, if
   it occurs anywhere; walks go on until one leads to no square or to a marked
   one. Then the vocabulary, every distinct square, is marked.
4. Runs. The leaves below each mark are its occurrences. Occurrences of one
   period that start next to each other merge into a run.

Squares whose half is itself a repetition are left out, so a run's period is
its smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
EVERY = 10


class Text:
    """Ranks of all substrings of 2^j symbols, the suffix order from them, and common extensions of two places.

    No two suffixes of the string may be equal up to its end: it ends with a
    symbol of its own.
    """

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank.astype(np.int32)]
        while n and rank.max() + 1 < n:
            step = 1 << (len(self.ranks) - 1)
            key = rank * (n + 1)
            key[:-step] += rank[step:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(rank.astype(np.int32))
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes from a and from b (other places) have in common."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[j]
            inside = np.maximum(a, b) < self.n
            same = inside & (r[np.minimum(a, self.n - 1)] == r[np.minimum(b, self.n - 1)])
            step = same.astype(np.int64) << j
            a += step
            b += step
            total += step
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the prefixes up to a and up to b (places not included) have in common."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            r, width = self.ranks[j], 1 << j
            inside = np.minimum(a, b) >= width
            same = inside & (r[np.maximum(a - width, 0)] == r[np.maximum(b - width, 0)])
            step = same.astype(np.int64) << j
            a -= step
            b -= step
            total += step
        return total


def blocks(order: np.ndarray, lcp: np.ndarray) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end: each is the longest sequence that starts earlier as well, or one new symbol."""
    n = len(order)
    longest = [0] * n
    stack: list[tuple[int, int]] = []
    for place, common in zip([*order.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while stack and (place < stack[-1][0] or common <= stack[-1][1]):
            top, length = stack.pop()
            if place < top:
                longest[top] = max(length, common)
                common = min(length, common)
            else:
                longest[top] = length
        stack.append((place, common))
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += max(1, longest[i])
    return [*starts, n]


def primitive(text: Text, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no shorter period divides that of the square at start."""
    out = np.ones(len(start), bool)
    if not len(start):
        return out
    least = np.zeros(int(period.max()) + 1, np.int64)  # smallest prime factors
    for p in range(2, len(least)):
        if p * p >= len(least):
            break
        if not least[p]:
            multiples = least[p * p :: p]
            multiples[multiples == 0] = p
    least = np.where(least == 0, np.arange(len(least)), least)
    rest = period.copy()
    while True:
        todo = np.flatnonzero((rest > 1) & out)
        if not len(todo):
            return out
        p = least[rest[todo]]
        part = period[todo] // p
        out[todo[text.forward(start[todo], start[todo] + part) >= 2 * period[todo] - part]] = False
        rest[todo] //= p


def covering(text: Text, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares with primitive halves that cover the vocabulary from the left."""
    edge = np.array(blocks(text.order, lcp), np.int64)
    first, size = edge[:-1], np.diff(edge)
    reach = np.minimum(size + np.append(size[1:], 0), text.n - 1 - first)
    pairs = []
    for base, count, sign in ((first, reach, 1), (edge[1:-1], size[:-1], -1)):
        count = np.maximum(count, 0)
        at = np.repeat(base, count)
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
        pairs.append((at if sign > 0 else at - k, k))
    a, k = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
    left = text.backward(a, a + k)
    hit = left + text.forward(a, a + k) >= k
    start, k = (a - left)[hit], k[hit]
    _, once = np.unique(start * (text.n + 1) + k, return_index=True)
    start, k = start[once], k[once]
    good = primitive(text, start, k)
    return start[good], k[good]


class SuffixTree:
    """Nodes of the suffix tree: internal ones by number, then leaves by rank. A node spans the ranks lo to hi and spells ``depth`` symbols."""

    def __init__(self, s: np.ndarray, text: Text, lcp: np.ndarray):
        n = text.n
        self.s, self.order, self.rank = s, text.order, text.rank
        depth, lo, hi, parent = [0], [0], [n - 1], [-1]
        above = [0] * n
        stack, values = [0], lcp.tolist()
        for r in range(1, n + 1):
            common = values[r] if r < n else 0
            node, left = -r, r - 1  # -r stands for the leaf of rank r - 1
            while depth[stack[-1]] > common:
                top = stack.pop()
                if node < 0:
                    above[-node - 1] = top
                else:
                    parent[node] = top
                node, left, hi[top] = top, lo[top], r - 1
            if depth[stack[-1]] < common:
                stack.append(len(depth))
                depth.append(common)
                lo.append(left)
                hi.append(r - 1)
                parent.append(-1)
            if node < 0:
                above[-node - 1] = stack[-1]
            else:
                parent[node] = stack[-1]
        self.inner = len(depth)
        ranks = np.arange(n)
        self.depth = np.concatenate([np.array(depth, np.int64), n - self.order])
        self.lo, self.hi = np.concatenate([np.array(lo, np.int64), ranks]), np.concatenate([np.array(hi, np.int64), ranks])
        self.parent = np.concatenate([np.array(parent, np.int64), np.array(above, np.int64)])
        below = np.arange(1, len(self.depth))
        symbol = s[self.order[self.lo[below]] + self.depth[self.parent[below]]]
        self.wide = int(s.max(initial=0)) + 1
        key = self.parent[below] * self.wide + symbol
        by = np.argsort(key)
        self.keys, self.children = key[by], below[by]
        self.links: dict[int, int] = {0: 0}

    def child(self, node: int, symbol: int) -> int:
        key = node * self.wide + symbol
        i = int(np.searchsorted(self.keys, key))
        return int(self.children[i]) if i < len(self.keys) and self.keys[i] == key else -1

    def loci(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The nodes at or next below the ends of the substrings."""
        node = self.inner + self.rank[start]
        while True:
            up = self.parent[node]
            move = (up >= 0) & (self.depth[up] >= length)
            if not move.any():
                return node
            node = np.where(move, up, node)

    def link(self, node: int) -> int:
        """The suffix link of an internal node: the node that spells its sequence without the first symbol."""
        if node not in self.links:
            place = self.inner + int(self.rank[self.order[self.lo[node]] + 1])
            want = self.depth[node] - 1
            while self.depth[place] > want:
                place = int(self.parent[place])
            self.links[node] = place
        return self.links[node]

    def rotated(self, node: int, length: int) -> int:
        """From the locus of a square of ``length`` symbols to that of the square that begins one symbol later; -1 if it does not occur."""
        start = int(self.order[self.lo[node]])
        place = self.link(int(self.parent[node])) if self.parent[node] > 0 else 0
        while self.depth[place] < length - 1:  # skip and count
            place = self.child(place, int(self.s[start + 1 + self.depth[place]]))
        if self.depth[place] == length - 1:
            return self.child(place, int(self.s[start]))
        return place if self.s[self.order[self.lo[place]] + length - 1] == self.s[start] else -1


def runs(s: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the maximal runs of a string of non-negative symbols, by start and period.

    Runs have ``least_length`` symbols and ``least_exponent`` (2 at least) periods or more.
    """
    s = np.append(np.asarray(s, np.int64), np.int64(max(s, default=0) + 1))
    text = Text(s)
    lcp = np.zeros(text.n, np.int64)
    lcp[1:] = text.forward(text.order[:-1], text.order[1:])
    start, period = covering(text, lcp)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    tree = SuffixTree(s, text, lcp)
    marked: set[tuple[int, int]] = set()
    for node, k in zip(tree.loci(start, 2 * period).tolist(), period.tolist(), strict=True):
        while node >= 0 and (node, k) not in marked:
            marked.add((node, k))
            node = tree.rotated(node, 2 * k)
    node, period = (np.array(x, np.int64) for x in zip(*marked, strict=True))
    count = tree.hi[node] - tree.lo[node] + 1
    at = np.arange(int(count.sum())) + np.repeat(tree.lo[node] - np.cumsum(count) + count, count)
    k, a = np.repeat(period, count), text.order[at]
    by = np.lexsort((a, k))
    k, a = k[by], a[by]
    new = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(a, prepend=-2) != 1))
    start, period = a[new], k[new]
    length = np.diff(np.append(new, len(a))) + 2 * period - 1
    long_ = length >= np.maximum(least_length, least_exponent * period)
    start, length, period = start[long_], length[long_], period[long_]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def stretches(symbol: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of places that may hold runs: every symbol in one occurs LEAST_EXPONENT times in it."""
    at = np.arange(len(symbol))
    part = doc
    while len(at):
        _, inverse, counts = np.unique(part * (int(symbol.max()) + 1) + symbol[at], return_inverse=True, return_counts=True)
        alive = counts[inverse] >= LEAST_EXPONENT
        left, group = at[alive], part[alive]
        new = np.flatnonzero((np.diff(left, prepend=-2) != 1) | (np.diff(group, prepend=-1) != 0))
        size = np.diff(np.append(new, len(left)))
        whole = size >= LEAST_LENGTH
        keep = np.repeat(whole, size)
        if alive.all() and whole.all():
            return list(zip(left[new].tolist(), (left[new] + size).tolist(), strict=True))
        at, part = left[keep], np.repeat(np.arange(len(new)), size)[keep]
    return []


def altered(n: int, h: int) -> np.ndarray | None:
    """Places of the words that a text of n words consists of after its change by the hash h; None if it stays."""
    if h % EVERY or not n:
        return None
    g = h // EVERY
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; on ties of smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, numbered from 0; a
    null text has none. Texts are changed first by the CRC-32 of their id
    (``altered``; a null id changes none). A run is a stretch of smallest
    period q and max(LEAST_LENGTH, LEAST_EXPONENT * q) words or more that no
    neighbouring word extends; start to exponent_milli are those of the run
    of greatest length / period (ties: smallest start, then period), null
    without runs. ``runs`` holds (start, length, period) by start and period,
    runs_sha256 the digest of their lines, collapsed_sha256 that of the words
    that no run contains after its first q ones, joined by a space. Rows that
    repeat are handled each; other columns are not read. A task holds a batch
    of a few MB of text, and a text at least.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    hashed = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(1))
    rows = docs.select(F.col(doc_id).alias("doc_id"), hashed.cast("long").alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 2):
            w = kernel.words(batch.column(2))
            size = np.diff(w.first)
            symbol = kernel.symbols(w)
            moved = {i: x for i, h in enumerate(batch.column(1).to_pylist()) if h % EVERY == 0 and (x := altered(int(size[i]), h)) is not None}
            for i, x in moved.items():
                symbol[w.first[i] : w.first[i + 1]] = symbol[w.first[i] + x]
            doc = np.repeat(np.arange(len(size)), size)
            ranges = stretches(symbol, doc)
            found: dict[int, list[tuple[int, int, int]]] = {}
            if ranges:
                top = int(symbol.max()) + 1
                string = np.concatenate([np.append(symbol[a:b], top + j) for j, (a, b) in enumerate(ranges)])
                lead = np.cumsum([0] + [b - a + 1 for a, b in ranges])
                starts, lengths, periods = runs(string)
                j = np.searchsorted(lead, starts, "right") - 1
                place = starts - lead[j] + np.array([a for a, _ in ranges], np.int64)[j]
                of = doc[place]
                for d, a, n, q in zip(of.tolist(), (place - w.first[of]).tolist(), lengths.tolist(), periods.tolist(), strict=True):
                    found.setdefault(d, []).append((a, n, q))
            cols: list[list] = [[] for _ in range(8)]
            data, o = kernel.buffers(batch.column(2))
            for d in range(len(size)):
                here = found.get(d, [])
                words = data[o[d] : o[d + 1]].tobytes().split()
                if d in moved:
                    words = [words[i] for i in moved[d].tolist()]
                if here:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for a, n, q in here:
                        drop[a + q] += 1
                        drop[a + n] -= 1
                    words = [x for x, gone in zip(words, np.cumsum(drop).tolist()) if not gone]
                best = _best(here)
                lines = "".join(f"{a},{n},{q}\n" for a, n, q in here)
                values = (len(here), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
                for col, value in zip(cols, (*values, [{"start": a, "length": n, "period": q} for a, n, q in here]), strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [run_type]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, {fields}").withColumnRenamed("doc_id", doc_id)


def oracle(crc_tables: str, crc: str) -> str:
    """DuckDB SQL of ``periodic_runs`` over documents with different ids, without ``runs``: equal words at every distance, in islands."""
    return f"""
with {crc_tables},
cut as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, coalesce({crc.format(x="cast(doc_id as varchar)")}, 1) as h from documents, crc_table),
sized as (select doc_id, w, h, len(w)::bigint as n, h // {EVERY} as g from cut),
placed as (select doc_id, w, n, h, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from sized),
changed as (select doc_id, n, case when h % {EVERY} = 0 and n > 0 then list_transform(range(0, n), lambda i: w[case when i < a then i + 1 else a + (i - a) % p + 1 end]) else w end as w from placed),
words as (select doc_id, n, unnest(w) as x, unnest(range(0, n)) as i from changed),
equal as (select a.doc_id, a.i, b.i - a.i as q from words a join words b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and b.i - a.i <= a.n // {LEAST_EXPONENT}),
islands as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from equal) group by doc_id, q, island
    having count(*) + q >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * q)),
runs as (select * from islands a where not exists (from islands b where b.doc_id = a.doc_id and b.q < a.q and b.start <= a.start and b.start + b.length >= a.start + a.length)),
ranked as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines from runs group by 1),
best as (select *, row_number() over (partition by doc_id order by length::double / q desc, start, q) as place from runs),
gone as (select distinct doc_id, unnest(range(start + q, start + length)) as i from runs),
kept as (select doc_id, string_agg(x, ' ' order by i) as t from words anti join gone using (doc_id, i) group by 1)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.q as period, 1000 * b.length // b.q as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from documents d left join ranked using (doc_id) left join (from best where place = 1) b using (doc_id) left join kept using (doc_id)
"""
