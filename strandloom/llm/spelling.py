"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

A word one insertion, deletion or replacement away from another holds that
one's first half at its start or its second half at its end. Shards of
automata hold the two halves of every word. Every word is scanned by the
shards that can hold a half of a near word: those of its own first and last
code points. A half that is found at the right end of the word and belongs to
a word of compatible length makes a candidate, whose distance is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import durable

LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: Code points that name a shard; held words of an automaton; words scanned and candidates verified at once.
ROUTE, HELD, SCANNED, PAIRS, WIDTH = 4, 8192, 1 << 16, 1 << 19, 48
#: Most rows of a table of large shards that is sent to all tasks.
SMALL = 50_000
SLICE, LONG_RUN = 4 << 20, 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in lower-case A-Z, for parts of the texts: bytes, start, end, text number."""
    data, o = kernel.buffers(column)
    if not len(data):
        return
    wide = data == 0xC3  # lead byte of U+00C0 to U+00FF
    member = _LETTER[data] | wide
    member[1:] |= wide[:-1]
    edge = ~member
    edge[o[:-1][o[:-1] < len(data)]] = True
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE)
        if b < len(data):
            b = b + int(np.argmax(edge[b:])) if edge[b:].any() else len(data)
        inside = member[a:b]
        first = o[np.searchsorted(o, a) : np.searchsorted(o, b)] - a
        before, after = np.zeros(b - a, bool), np.zeros(b - a, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[first] = False
        after[first[first > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield _LOWER[data[a:b]], start, end, np.searchsorted(o, start + a, "right") - 1
        a = b


def crc32(prefix: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, carried on from ``prefix``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    c, at, left = ~prefix[order].astype(np.uint32), start[order], size[order]
    for j in range(int(min(left[0], LONG_RUN)) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + j]) & 255] ^ (c[:n] >> 8)
    for i in range(int(np.searchsorted(-left, -LONG_RUN))):
        c[i] = ~np.uint32(zlib.crc32(data[at[i] + LONG_RUN : at[i] + left[i]].tobytes(), int(~c[i])))
    out = np.empty_like(c)
    out[order] = ~c
    return out


def _counted(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over rows (id, text): the words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.sliced(batches, 1):
            ids = [i if i is not None else "null" for i in batch.column(0).to_pylist()]
            salt = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            for data, start, end, doc in runs(batch.column(1)):
                h = crc32(salt[doc], data, start, end)
                hit = h % EVERY == 0
                changed: Counter = Counter()
                for s, e, x in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist(), strict=True):
                    word = data[s:e].tobytes().decode()
                    k = x % len(word)
                    changed[word[:k] + word[k + 1 :]] += 1
                start, size = start[~hit], (end - start)[~hit]
                offsets = np.append(0, np.cumsum(size))
                flat = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
                plain = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat))
                counts = pc.value_counts(plain)
                words = pa.concat_arrays([counts.field(0).cast(pa.string()), pa.array(list(changed), pa.string())])
                n = pa.concat_arrays([counts.field(1).cast(pa.int64()), pa.array(list(changed.values()), pa.int64())])
                full = pc.greater_equal(pc.utf8_length(words), LEAST_LENGTH)
                yield pa.RecordBatch.from_arrays([words.filter(full), n.filter(full)], names=["word", "n"])

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _routed(words: DataFrame) -> DataFrame:
    """Rows (tail, key, part, scan, word, n): where halves are held (scan false) and where words are scanned (true).

    A half goes to the shard of its outer code points, ROUTE at most; a word
    is scanned in the shards of all halves that a near word can have there. A
    shard of over HELD words is cut into parts, and its scans go to each.
    """
    size = "length(word)"
    near = f"filter(sequence({size} - 1, {size} + 1), x -> x >= {LEAST_LENGTH})"
    rows = []
    for tail, half in ((False, "{x} div 2"), (True, "({x} + 1) div 2")):
        depth = lambda x, half=half: f"int(least({ROUTE}, {half.format(x=x)}))"
        key = "right(word, depth)" if tail else "left(word, depth)"
        held = words.selectExpr("word", "n", "false as scan", f"{depth(size)} as depth")
        scan = words.selectExpr("word", "n", "true as scan", f"explode(array_distinct(transform({near}, x -> {depth('x')}))) as depth")
        rows.append(held.unionByName(scan).selectExpr(f"{str(tail).lower()} as tail", f"{key} as key", "scan", "word", "n"))
    both = rows[0].unionByName(rows[1])
    large = durable(both.where("not scan").groupBy("tail", "key").agg(F.ceil(F.count("*") / HELD).cast("int").alias("parts")).where("parts > 1"))
    both = both.join(F.broadcast(large) if large.count() <= SMALL else large, ["tail", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("scan"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    return both.select("tail", "key", F.explode(part).alias("part"), "scan", "word", "n")


class Shard:
    """Held words with automata of their halves, one for first and one for second halves."""

    def __init__(self, held: list[tuple[bool, str, int]]):
        held = sorted(held, key=lambda r: r[1])  # places are in code-point order
        self.words, self.n = [w for _, w, _ in held], np.array([n for _, _, n in held], np.int64)
        post: tuple[dict, dict] = ({}, {})
        for i, (tail, w, _) in enumerate(held):
            half = len(w) // 2
            post[tail].setdefault(w[half:] if tail else w[:half], {}).setdefault(len(w), []).append(i)
        self.machines = []
        lists: list[list[int]] = []
        for tail in (False, True):
            machine = ahocorasick.Automaton()
            for half, by_size in post[tail].items():
                lists += by_size.values()
                machine.add_word(half, (len(half), [(size, len(lists) - len(by_size) + j) for j, size in enumerate(by_size)]))
            machine.make_automaton()
            self.machines.append(machine if len(machine) else None)
        self.count = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.flat = np.array([i for x in lists for i in x], np.int64)
        self.code = Codes(self.words)

    def scan(self, scans: list[tuple[bool, int, str]]) -> Iterator[tuple[list, list, list, list]]:
        """Of scanned words (tail, code points that led here, word): those with near words here, how many, and the count and spelling of the most frequent one."""
        code = Codes([w for _, _, w in scans])
        who, lists, total = [], [], 0
        near = np.zeros(len(scans), np.int64)
        best = np.full(len(scans), -1, np.int64)
        tails = np.array([t for t, _, _ in scans])

        def verify() -> None:
            k = np.array(lists, np.int64)
            size = self.count[k]
            at = np.cumsum(size) - size
            v = self.flat[np.arange(int(size.sum())) + np.repeat(self.first[k] - at, size)]
            w = np.repeat(np.array(who, np.int64), size)
            for a in range(0, len(v), PAIRS):
                x, y = w[a : a + PAIRS], v[a : a + PAIRS]
                some = np.bitwise_count(code.letters[x] ^ self.code.letters[y]) <= 2
                x, y = x[some], y[some]
                one, prefix = one_edit(code, x, self.code, y)
                # a pair that shares the first half is found there
                one &= ~tails[x] | (prefix < self.code.size[y] // 2)
                x, y = x[one], y[one]
                np.add.at(near, x, 1)
                order = np.lexsort((y, -self.n[y], x))
                x, y = x[order], y[order]
                lead = np.flatnonzero(np.diff(x, prepend=-1))
                x, y = x[lead], y[lead]
                old = best[x]
                better = (old < 0) | (self.n[y] > self.n[old]) | (self.n[y] == self.n[old]) & (y < old)
                best[x[better]] = y[better]

        for i, (tail, depth, word) in enumerate(scans):
            machine, size = self.machines[tail], len(word)
            if machine is None:
                continue
            for end, (half, by_size) in machine.iter(word):
                if (end + 1 == size if tail else end + 1 == half) and min(ROUTE, half) == depth:
                    for other, k in by_size:
                        if -1 <= other - size <= 1:
                            who.append(i)
                            lists.append(k)
                            total += int(self.count[k])
            if total > PAIRS:
                verify()
                who, lists, total = [], [], 0
        if who:
            verify()
        hit = np.flatnonzero(near)
        yield [scans[i][2] for i in hit], near[hit].tolist(), self.n[best[hit]].tolist(), [self.words[j] for j in best[hit]]


class Codes:
    """Words as rows of WIDTH code points at most, padded with 0, and the set of their letters as bits."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        width = min(WIDTH, int(self.size.max(initial=0))) + 1
        self.rows = np.frombuffer(b"".join(w.encode("latin-1")[: width - 1].ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        self.letters = np.zeros(len(words), np.uint64)
        for j in range(width - 1):
            c = self.rows[:, j]
            self.letters |= np.where(c > 0, np.uint64(1) << (c & 63).astype(np.uint64), np.uint64(0))
        for i in np.flatnonzero(self.size > WIDTH).tolist():
            self.letters[i] = sum(1 << x for x in {ord(c) & 63 for c in words[i]})


def one_edit(a: Codes, x: np.ndarray, b: Codes, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the words x of a and y of b differ by exactly one insertion, deletion or replacement, and the length of their common start."""
    width = max(a.rows.shape[1], b.rows.shape[1])
    p = np.zeros((2, len(x), width), np.uint8)
    p[0, :, : a.rows.shape[1]], p[1, :, : b.rows.shape[1]] = a.rows[x], b.rows[y]
    m, n = a.size[x], b.size[y]
    swap = m < n
    longer, shorter = np.where(swap[:, None], p[1], p[0]), np.where(swap[:, None], p[0], p[1])
    same = longer == shorter
    start = np.where(same.all(1), width, same.argmin(1))
    shifted = longer[:, 1:] == shorter[:, :-1]
    rest = np.where(shifted.all(1), 0, width - 1 - shifted[:, ::-1].argmin(1))
    out = np.where(m == n, (~same).sum(1) == 1, (np.abs(m - n) == 1) & (start >= rest))
    prefix = np.minimum(start, np.minimum(m, n))
    for i in np.flatnonzero((m > WIDTH) | (n > WIDTH)).tolist():
        u, v = a.words[x[i]], b.words[y[i]]
        k = next((j for j, (c, d) in enumerate(zip(u, v)) if c != d), min(len(u), len(v)))
        out[i] = u != v and abs(len(u) - len(v)) <= 1 and (u[k + (len(u) >= len(v)) :] == v[k + (len(v) >= len(u)) :])
        prefix[i] = k
    return out, prefix


def _found(words: DataFrame) -> DataFrame:
    """Rows (word, near, best_n, best): the near words that a shard holds, and the most frequent of them."""
    names = ["word", "near", "best_n", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, str, int]] = []
        scans: list[tuple[bool, int, str]] = []
        group, kept, shard = None, 0, None

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            shard = shard or Shard(held)
            for columns in shard.scan(scans):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

        for batch in batches:
            for tail, key, part, scan, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tail, key, part) != group:
                    if len(held) >= HELD or (tail, key) == (group or ())[:2]:  # parts of one key are automata of their own
                        yield from answers()
                        held, scans, shard = [], [], None
                    group, kept = (tail, key, part), len(held)
                if not scan:
                    held.append((tail, word, n))
                    shard = None
                elif len(held) > kept:  # else nothing is held under this key
                    scans.append((tail, len(key), word))
                    if len(scans) >= SCANNED:
                        yield from answers()
                        scans = []
        if held and scans:
            yield from answers()

    routed = _routed(words).repartition("tail", "key", "part").sortWithinPartitions("tail", "key", "part", "scan")
    return routed.mapInArrow(run, "word string, near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form): the last word that forms lead to, by pointer doubling."""
    links = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word.

    Runs are maximal stretches of A-Z, a-z and U+00C0 to U+00FF of the whole
    texts; only A-Z is lower-cased. With h = crc32("<id>:<run>"), a run whose h
    is divisible by EVERY loses its code point h mod its length. Words are the
    distinct results of LEAST_LENGTH code points and LEAST_COUNT occurrences
    (n) at least. Words one insertion, deletion or replacement apart are near;
    ``form`` is the near word of largest n (the smallest in code-point order on
    ties) if that is at least twice the word's n, ``root`` the last word that
    forms lead to. Null and empty texts have no runs; a null id counts as the
    text "null"; rows that repeat count each. Other columns are not read; an
    empty table gives no rows.
    """
    words = durable(_counted(docs.select(F.col(doc_id).cast("string"), F.col(text))))
    near = _found(words).groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("form"))).alias("best"))
    taken = -F.col("best.neg") >= 2 * F.col("n")
    table = durable(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.neg")).alias("form_n")
        )
    )
    roots = _roots(table.where("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(crc_tables: str, crc: str) -> str:
    """DuckDB SQL of ``variants`` over documents; ``crc_tables`` and ``crc`` as in ``sql.py``."""
    return f"""
with recursive {crc_tables},
runs as (select doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as x from documents)),
counted as (select coalesce(cast(doc_id as varchar), 'null') || ':' || run as keyed, run, count(*) as n from runs group by all),
hashed as (select run, n, {crc.format(x="keyed")} as h from counted, crc_table),
changed as (select case when h % {EVERY} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from changed where length(word) >= {LEAST_LENGTH} group by 1 having sum(n) >= {LEAST_COUNT}),
cuts as (select word, n, length(word) as size, unnest(range(1, length(word) + 1)) as pos from words),
gaps as (select word, n, size, pos, substr(word, 1, pos::int - 1) || substr(word, pos::int + 1) as rest from cuts),
near as (select distinct a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
    union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
    union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, min({{'neg': -other_n, 'form': other}}) as b from near group by 1),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.neg >= 2 * w.n then b.form end as form, case when -b.neg >= 2 * w.n then -b.neg end as form_n
    from words w left join best using (word)),
chain as (select word, word as root from formed union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null),
last as (select c.word, c.root from chain c join formed f on f.word = c.root where f.form is null)
select f.word, f.form, l.root, f.n, f.n_near, f.form_n from formed f join last l using (word)
"""
