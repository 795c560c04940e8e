"""Operators with exact definitions, against brute force on rows with nulls, empty and long texts, ties and repeats."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import kernel, nearest, neardup, packing, repeats, shards, tokencount, warc
from strandloom.llm.queries import vocabulary_path

SPACE = r"[^\x20\x09-\x0D]+"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé,.") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        t = rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.choice([1, 2, 10, 80, 200])))
        if i % 7 == 0:
            t = t + " " + passage
        if i % 5 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 9 == 0 and t:
            parts = t.split(" ")
            parts[rng.randrange(len(parts))] = "zz"
            t = " ".join(parts)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n "), (None, "a b c d"), (3, rows[3][1]), (n + 4, " ".join(rng.choice(words) for _ in range(30000)))]
    return rows


def frame(spark, rows):
    # extra columns with clashing names must not matter
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "size": F.lit("x"), "label": F.lit(2), "spans": F.lit(0)}).repartition(3)


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [t for _, t in corpus(1)]
    w = kernel.words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        got = [w.text(j, j + 1) for j in range(int(w.first[i]), int(w.first[i + 1]))]
        assert got == [x.encode() for x in re.findall(SPACE, t or "")]


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(SPACE, t or "")]
        out.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = corpus(2) + [(77, t) for _, t in corpus(12)[:40]]
    sets = sets_of(rows, k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    ids = lambda x: [rows[y][0] for y in range(len(rows)) if root(y) == root(x) and rows[y][0] is not None]
    low = [min(ids(x), default=None) for x in range(len(rows))]
    want = sorted(str((rows[x][0], len(sets[x]), low[x], rows[x][0] == low[x])) for x in range(len(rows)))
    got = neardup.similar_classes(frame(spark, rows), shingle=k, percent=percent).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert neardup.similar_classes(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_of_one_id_cost_a_row_each(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    rows = [(7, " ".join([*base[:-2], f"w{i}", f"v{i}"])) for i in range(5000)] + [(9, " ".join(base))]
    seen = []
    profile = neardup.details
    monkeypatch.setattr(neardup, "details", lambda docs, *a: (seen.append(docs.count()), profile(docs, *a))[1])
    got = neardup.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(7, 7), (9, 7)} and len(got) == 5001
    assert seen == [5001]


def test_near_duplicate_cells_grow_with_their_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    rows = [(0, 1, bytes([x % 256, x // 256]), b"t" if x < 1000 else bytes([x % 256, 9])) for x in range(1007)]
    members = neardup._open(spark.createDataFrame(rows, "band int, key long, node binary, label binary"))
    cells = neardup._cells(members).collect()
    assert len(cells) == 1000 + 7 * 101  # each top row once; the seven others with each of 100 blocks, and with themselves
    together = collections.defaultdict(list)
    for r in cells:
        together[r["i"], r["j"]].append((bytes(r["node"]), bytes(r["label"])))
    met = {frozenset((a[0], b[0])) for rows_ in together.values() for a in rows_ for b in rows_ if a[1] != b[1]}
    assert len(met) == 7 * 1000 + 7 * 6 // 2


def test_near_duplicate_cells_decide_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(150, rng.integers(0, 25), replace=False)] = rng.integers(0, 1 << 62)
        sets.append(np.unique(s))
    import pandas as pd

    sig = [neardup.signature(s) for s in sets]
    f = pd.DataFrame({"band": 0, "key": 0, "i": 0, "j": 0, "part": 0, "node": range(60), "label": range(60), "sig": [s.tobytes() for s in sig], "bands": [neardup.band_keys(s).view(np.int64) for s in sig], "items": [s.tobytes() for s in sets]})
    links = neardup._cell(f, 85, neardup.least_matches(0.85, 1e-6))
    assert len(links) < 60

    def classes(pairs):
        p = list(range(60))
        for a, b in pairs:
            ra, rb = p[a], p[b]
            p = [rb if x == ra else x for x in p]
        return [p.index(x) for x in p]

    linked = lambda a, b: (lambda n: 100 * n >= 85 * (len(a) + len(b) - n))(len(np.intersect1d(a, b)))
    assert classes(links) == classes([(a, b) for a in range(60) for b in range(a) if linked(sets[a], sets[b])])


def test_repeats(spark, monkeypatch):
    rows = corpus(3)
    counts = collections.Counter()
    cut = [re.findall(SPACE, t or "") for _, t in rows]
    for w in cut:
        counts.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, cut):
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if counts[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        want.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    for hot in (20_000, 2):
        monkeypatch.setattr(repeats, "HOT_COUNT", hot)
        got = repeats.without_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert repeats.without_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeats_are_what_the_automata_find(monkeypatch):
    rng = random.Random(9)
    for patterns in (1 << 15, 3):
        monkeypatch.setattr(repeats, "PATTERNS", patterns)
        for _ in range(60):
            words = [rng.choice("ab") for _ in range(rng.randrange(1, 60))]
            texts = [" ".join(words[a : a + rng.randrange(1, 25)]) for a in (rng.randrange(len(words)) for _ in range(rng.randrange(1, 8)))]
            group = {f"{i}".encode(): (t.encode(), rng.choice([1, 1, 2])) for i, t in enumerate(texts)}
            count = collections.Counter()
            for t, n in group.values():
                w = t.split()
                for j in range(len(w) - 4):
                    count[tuple(w[j : j + 5])] += n
            want = set()
            for name, (t, _) in group.items():
                w = t.split()
                want |= {(name, j + d) for j in range(len(w) - 4) if count[tuple(w[j : j + 5])] > 1 for d in range(5)}
            read = lambda found: {(name, j) for name, lo, hi in zip(*found, strict=True) for j in range(lo, hi)}
            assert read(repeats.located(group, 5)) == want
            with monkeypatch.context() as m:
                # all windows are compiled: the automata alone decide what recurs
                m.setattr(repeats, "candidates", lambda w, n, k: np.array([x for a, b in zip(w.first, w.first[1:]) for x in range(a, b - k + 1)], np.int64))
                assert read(repeats.located(group, 5)) == want
                m.setattr(repeats, "candidates", lambda w, n, k: np.zeros(0, np.int64))
                assert not read(repeats.located(group, 5))


NAME = "<|endoftext|>"


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(4) + [(2000 + i, t) for i, t in enumerate([f"a {NAME} b", NAME, NAME * 3, f" {NAME}\n{NAME} x y ", f"it's{NAME}we'll", f"<|{NAME}|>"])]
    t = Tokenizer.from_file(vocabulary_path())
    out = packing.packed(frame(spark, rows), vocabulary_path(), size=128).toPandas()
    ids = {}
    for i, x in rows:
        ids.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [0])
    assert out["length"].sum() == sum(len(x) for v in ids.values() for x in v)
    for i, part in out.groupby(out["doc_id"].fillna(-1)):
        whole = ids[None if i == -1 else int(i)]
        if len(whole) == 1:
            assert [y for x in part.sort_values("start")["ids"] for y in x] == whole[0]
    for r in out.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["length"].sum() <= 128 and part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
    assert packing.packed(frame(spark, rows).limit(0), vocabulary_path()).count() == 0


def test_packing_cuts_at_ends(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(" ".join(word() for _ in range(rng.randint(3, 12))) + "." for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts += [" ".join(word() for _ in range(3000)), "version 1.2.3 of x.y.z " * 30]
    enc = packing.encoder(vocabulary_path())
    coded = [np.frombuffer(x + b"\0\0\0\0", "<u4") for x in enc(texts)]
    ids, doc_end = np.concatenate(coded), np.cumsum([len(x) for x in coded])
    at, penalty = packing.places(ids, enc, doc_end, 256, 16, 4, 8)
    stop = at[packing.cuts(at, penalty, 256)]
    kind = penalty[np.searchsorted(at, stop)]
    ends = set(doc_end.tolist()) | {i + 1 for i in range(len(ids) - 1) if enc.bpe.decode([int(ids[i])])[-1:] == "." and enc.bpe.decode([int(ids[i + 1])])[:1] == " "}
    for e, k in zip(stop.tolist(), kind.tolist()):
        assert (e in ends) == (k < 8)
        if k == 8:
            assert not any(x in ends for x in range(e - 256 + 1, e + 1))
    assert set(kind.tolist()) == {0, 4, 8}


def test_packing_cuts_are_the_best():
    rng = random.Random(5)
    for _ in range(30):
        at = [0]
        while len(at) < 40:
            at.append(at[-1] + rng.randint(1, 9))
        pen = [0, *(rng.choice([0, 2, 5]) for _ in at[1:])]
        best = [0] + [10**9] * 39
        for j in range(1, 40):
            best[j] = min(best[i] + pen[j] + 20 - at[j] + at[i] for i in range(j) if at[j] - at[i] <= 20)
        ends = packing.cuts(np.array(at), np.array(pen), 20)
        price, i = 0, 0
        for j in ends:
            assert at[j] - at[i] <= 20
            price, i = price + pen[j] + 20 - at[j] + at[i], j
        assert price == best[39] and i == 39


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    enc = packing.Encoder(vocabulary_path())
    texts = ["", "a", " a", "a ", "a  b", "a \n b", "\n\na b\tc", "it's we'll", "é ü  x y z", "1 22 x3", "<|endoftext|> a", "日本 語", "a　 b", "\r\n x"]
    texts += [x for _, x in corpus(6) if x]
    for x, got in zip(texts, enc(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_shards(spark):
    rows = corpus(7) + [(5, f"text {i}") for i in range(300)] + [(None, f"none {i % 40}") for i in range(300)]
    a = shards.sharded(frame(spark, rows), [1.0] * 16).collect()
    assert len(a) == len(rows)
    for s in {r["shard"] for r in a}:
        assert sorted(r["slot"] for r in a if r["shard"] == s) == list(range(sum(r["shard"] == s for r in a)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in a)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in a) == want
    assert len({(r["doc_id"], r["shard"]) for r in a}) == len({i for i, _ in rows})
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    share = {r["shard"]: r["count"] for r in shards.sharded(big, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(share[1] / 20000 - 0.75) < 0.02
    assert shards.sharded(big.limit(0), [1.0] * 16).count() == 0


def test_warc(spark, monkeypatch):
    body, long_ = "<p>" + "é" * 80, "".join(chr(97 + i * i % 26) for i in range(300_000))
    rows = [(5, "http://a", body), (2, "http://b", body), (9, None, None), (7, "x", "tiny"), (8, "x", "tiny"), (None, "n", body), (2, "again", body), (2, "again", body)]
    rows += [(20, "l", long_), (21, "l", long_), (None, "m", "z" * 200), (None, "m", "z" * 200), *[(30 + i, f"u{i}", "hot" * 50) for i in range(60)]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "low": F.lit("x"), "n": F.lit(2), "match": F.lit(0)})
    full = (len(body.encode()), hashlib.sha256(body.encode()).hexdigest())
    for hot in (10_000, 20):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc, "HOT_ROWS", hot)
            m.setattr(warc, "HOT_SHARE", 50)
            got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect())
        assert sum(got.values()) == len(rows)
        # of the three rows with the smallest id, one with the smallest url is the response
        assert got[2, "response", None] == 1 and got[2, "revisit", 2] == 2 and got[5, "revisit", 2] == 1 and got[None, "revisit", 2] == 1
        assert got[9, "response", None] == got[7, "response", None] == got[8, "response", None] == 1
        assert got[20, "response", None] == got[21, "revisit", 20] == 1 and got[None, "response", None] == 2
        assert got[30, "response", None] == 1 and all(got[30 + i, "revisit", 30] == 1 for i in range(1, 60))
    sizes = {(r["page_id"], r["record_type"]): (r["payload_bytes"], r["payload_digest"]) for r in warc.archived(df).collect()}
    assert sizes[2, "response"] == sizes[5, "revisit"] == full and sizes[9, "response"] == (0, hashlib.sha256(b"").hexdigest())
    files = warc.write_warc(df)
    read = warc.read_warc(files)
    assert read.rdd.getNumPartitions() == files.count() > 1
    texts = {(r["page"], r["url"]): bytes(r["payload"]).decode() for r in read.where("type = 'response'").collect()}
    assert texts["2", "again"] == body and texts["20", "l"] == long_ and texts["9", None] == ""
    assert warc.archived(df.limit(0)).count() == 0
    with monkeypatch.context() as m:  # payloads that repeat are too many to be sent to all tasks
        m.setattr(warc, "ROLES", 0)
        moved = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect())
    assert moved == got


def test_warc_names_of_any_text(spark, monkeypatch):
    ids = ["null", None, "a\r\nContent-Length: 5", "<x>", "%0A", "", "é 日", "a" * 300]
    rows = [(i, f"http://x/{n}\r\n y", "p" * 200 if n % 2 else f"{n}" * 150) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    for roles in (100_000, 0):
        monkeypatch.setattr(warc, "ROLES", roles)
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect()}
        low = min(i for i, _, p in rows if p == "p" * 200 and i is not None)
        assert got == {i: (len(p), hashlib.sha256(p.encode()).hexdigest(), *(("revisit", low) if p == "p" * 200 and i != low else ("response", None))) for i, _, p in rows}


def test_warc_reads_a_file_a_task(spark, tmp_path):
    df = spark.range(0, 500, 1, 37).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("html"))
    files = warc.write_warc(df, f"file://{tmp_path}/warc")
    read = warc.read_warc(files)
    held = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert files.count() == 37 and sorted(r["count"] for r in held) == sorted(r["records"] for r in files.collect()) and len(held) == 37


def test_warc_reader_verifies():
    import io

    payload = bytes(range(256)) * 1000
    digest = hashlib.sha256(payload).hexdigest()
    good = warc.record_of("1", "u", payload, len(payload), digest, None)
    assert [r["payload"] for r in warc.records(io.BytesIO(good + good))] == [payload] * 2
    assert [r["bytes"] for r in warc.records(io.BytesIO(good + warc.record_of("2", "", b"", len(payload), digest, "1")), payload=False)] == [len(payload)] * 2
    raw = gzip.decompress(good)
    bad = [good[:-9], warc.record_of("1", "u", payload, len(payload), "0" * 64, None)]
    bad += [gzip.compress(x) for x in (raw[:-4], raw[:-9] + b"\r\n\r\n", raw[:-4] + b"x\r\n\r\n", raw.replace(b"\x05\x06", b"\x05\x07", 1), raw.replace(b"WARC/1.1", b"WARC/9.9"), b"")]
    for data in bad:
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(data)))


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[100:260] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (420, [1.0])]
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, every=20, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    d = v.astype(np.float64)
    assert sorted(got) == list(range(0, 400, 20))
    for q in got:
        s = (d * d[q]).sum(axis=1)
        want = sorted((-round(s[i], 12), i) for i in range(400) if i != q)[:20]
        assert got[q] == [(i, round(-x, 9)) for x, i in want]
    assert nearest.nearest(df.limit(0)).count() == 0
    twice = nearest.nearest(df.where("vec_id < 21").unionByName(df.where("vec_id = 20")), every=20, k=20).orderBy("query_id", "rank", "score").collect()
    assert {r["query_id"] for r in twice} == {0, 20}


def test_token_counts(spark):
    scores = tokencount.pieces(vocabulary_path("piece_bpe_32k.model"))

    def brute(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            c = [(best[e - 1][0] + tokencount.UNKNOWN, -best[e - 1][1] - len(w[e - 1].encode()))]
            c += [(best[s][0] + scores[w[s:e]], -best[s][1] - 1) for s in range(max(0, e - 20), e) if w[s:e] in scores]
            m = max(c)
            best.append((m[0], -m[1]))
        return best[-1][1]

    rows = corpus(8)[:60] + [(1000, "日本 x" + "y" * 600), (1001, None)]
    got = tokencount.token_counts(frame(spark, rows), vocabulary_path("piece_bpe_32k.model")).collect()
    want = sorted((str(i), len((t or "").split()), sum(brute("▁" + w) for w in (t or "").split())) for i, t in rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert tokencount.token_counts(frame(spark, rows).limit(0), vocabulary_path("piece_bpe_32k.model")).count() == 0
    small = tokencount.Trie(scores, limit=5)
    assert [small.count("▁" + w) for w in ("hello", "help", "hello")] == [brute("▁hello"), brute("▁help"), brute("▁hello")]


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    name = "<|endoftext|>"
    rows = [(0, f"a {name} b"), (1, name), (2, name * 3), (3, f" {name}\n{name} x y "), (4, "a <|endoftext| > b"), (5, f"it's{name}we'll  {name}  z"), (6, f"<|{name}|>"), (7, "a b"), (8, None)]
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
    assert want[0] == [64, 220, 50256, 275, 0]
    got = {i: [] for i, _ in rows}
    for r in packing.packed(frame(spark, rows), vocabulary_path()).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] += r["ids"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    assert got == want


def test_near_duplicates_without_ids(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(20)]
    for i in range(8):  # id, no id, id: the ends are linked by the row without an id alone; then two rows without ids
        w = [word() for _ in range(200)]
        a, b, c = w[:], w[:], w[:]
        a[:14] = [word() for _ in range(14)]
        c[-14:] = [word() for _ in range(14)]
        rows += [(100 + i if i < 4 else None, " ".join(a)), (None, " ".join(b)), (200 + i if i < 4 else None, " ".join(c))]
    rows += [(None, rows[21][1]), (None, None), (None, "")]
    sets = sets_of(rows, 3)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[b] if x == label[a] else x for x in label]
    ids = lambda x: [rows[y][0] for y in range(len(rows)) if label[y] == label[x] and rows[y][0] is not None]
    low = [min(ids(x), default=None) for x in range(len(rows))]
    assert low[20:23] == [100, 100, 100]
    want = sorted(str((rows[x][0], len(sets[x]), low[x], rows[x][0] == low[x])) for x in range(len(rows)))
    got = neardup.similar_classes(frame(spark, rows), shingle=3, percent=85).collect()
    assert sorted(str(tuple(r)) for r in got) == want
