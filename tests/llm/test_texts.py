"""Languages, spelling variants and periodic runs, against brute force, SQL and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import language, spelling, sql, tandem

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id long, text string"):
    # extra columns with clashing names must not matter
    clash = {c: F.lit(1) for c in ("word", "n", "h", "key", "runs", "start", "score", "bits")}
    return spark.createDataFrame(rows, schema).withColumns(clash).repartition(3)


def same(spark_rows, sql_text, rows, columns):
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.execute("create table documents as select doc_id::bigint as doc_id, text from given")
    want = con.execute(f"select {', '.join(columns)} from ({sql_text})").fetchall()
    text = lambda r: tuple("null" if v is None else str(v) for v in r)
    assert sorted(map(text, spark_rows)) == sorted(map(text, want))
    return len(want)


# --- languages


def grams(text):
    t = "".join(c.lower() if c.isalpha() or ord(c) > 127 else " " for c in text or "")
    b = re.sub(" +", " ", f" {t} ").encode()
    return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}


def cells(text):
    return {((int.from_bytes(g, "little") * 2654435761) % (1 << 32)) >> 16 for g in grams(text)}


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_presence_is_that_of_all_grams(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    texts = ["Hello, World", None, "", "  ", "x", "ÄÖ é-a 123 b", "a" * 50, "Ab. cd\n\nef", "日本 語", " lead", "trail ", "--"]
    got = language.presence(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        assert set(np.flatnonzero(row).tolist()) == (cells(t) if t else set()), t


def test_kernel_and_regression_equal_dense_ones():
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(12))
    texts, langs = [text("abcde") for _ in range(20)] + [text("cdefg") for _ in range(20)], ["x"] * 20 + ["y"] * 20
    x = language.presence(pa.array(texts))
    model = language.Model(["x", "y"], x[::4])
    k = model.kernel(x)
    sets = [cells(t) for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets[::4]] for a in sets])
    assert np.allclose(k[:, :-1], want, atol=1e-5)
    y = np.where(np.array(langs)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    model.fit(k.T @ k, k.T @ y, len(k))
    value, vector = np.linalg.eigh(want[::4])
    phi = np.hstack([want @ vector / np.sqrt(value), np.ones((40, 1))])
    penalty = language.RIDGE * 40 * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    dense = phi @ np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    assert np.allclose(k @ model.weights, dense, atol=1e-2)


def test_languages_of_held_out_rows_and_of_odd_ones(spark):
    rng = random.Random(2)
    alphabet = {"aa": "abcdeé", "bb": "cdefgü", "cc": "éüxyz"}
    rows = []
    for i in range(300):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(3, 8))) for _ in range(rng.choice([8, 30, 5000] if i < 3 else [8, 30]))), lang))
    rows += rows[:5] + [(901, None, "aa"), (902, "", "bb"), (903, "123 ... ?!", "cc"), (None, rows[0][1], "aa"), (904, rows[1][1], None), (905, "日本語", None)]
    got = language.languages(frame(spark, rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    want = {(i, t): lang for i, t, lang in rows}
    kept = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in kept)
    truth = {i: lang for i, _, lang in rows[:300]}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in kept if r["held_out"]]) > 0.97
    odd = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 300}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (901, 902, 903))
    assert odd[None]["lang_pred"] == want[None, rows[0][1]] and odd[905]["lang_pred"] in alphabet
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, f"{'abc' if i % 2 else 'xyz'} word {i % 7}", "odd" if i % 2 else "even") for i in range(80)]
    lied = [(i, t, "lie" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(map(str, language.languages(frame(spark, x, "doc_id long, text string, lang string")).collect())) for x in (rows, lied))
    assert a == b


def test_languages_without_labels(spark):
    got = language.languages(frame(spark, [(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language.languages(frame(spark, [], "doc_id long, text string, lang string")).count() == 0


# --- spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long_, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def spelled(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out, form = [], {}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(map(str, out))


def vocabulary(seed=0):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé÷ÿ") for _ in range(rng.choice([4, 5, 5, 6, 7, 9, 12]))) for _ in range(25)] + ["x" * 60 + "yz" * 20]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 9, 40])
        for _ in range(6):
            v = w
            for _ in range(rng.choice([1, 1, 2])):
                k = rng.randrange(len(v) + 1)
                v = rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice("abcdéF") + v[k:], v[:k] + rng.choice("abcdé") + v[k + 1 :]])
            words += [v] * rng.choice([1, 2, 3, 4, 10])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "日", ", 5", "\n"]).join(words[i::40])) for i in range(40)]
    return rows + [rows[3], (None, rows[4][1]), (77, None), (78, ""), (79, "12 34 !"), (80, " ".join(words) * 3)]


@pytest.mark.parametrize("held", [8192, 5])
def test_spelling_variants(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)  # of the plan; tasks keep theirs
    rows = vocabulary()
    got = spelling.variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(str(tuple(r)) for r in got) == spelled(rows)
    if held > 100:
        assert same(map(tuple, got), spelling.oracle(sql.CRC_TABLES, sql.CRC), rows, got[0].__fields__) > 30


def test_spelling_of_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "abcde")])).count() == 0


@pytest.mark.parametrize("pairs,width", [(1 << 19, 48), (7, 6)])
def test_a_shard_finds_all_near_words(monkeypatch, pairs, width):
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "WIDTH", width)
    n = Counter(w for _, t in vocabulary(3) for w in re.findall("[a-zÀ-ÿ]{5,}", t or ""))
    shard = spelling.Shard([(tail, w, c) for w, c in n.items() for tail in (False, True)])
    scans = [(tail, depth, w) for w in n for tail in (False, True) for depth in (2, 3, 4)]
    got: Counter = Counter()
    best = {}
    for words, near, top, form in shard.scan(scans):
        for w, k, c, f in zip(words, near, top, form, strict=True):
            got[w] += k
            best[w] = min(best.get(w, (0, "")), (-c, f))
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    assert got == {w: len(v) for w, v in near.items() if v}
    assert best == {w: min((-n[x], x) for x in v) for w, v in near.items() if v}


def test_runs_are_cut_at_any_part(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    texts = ["abc défg", "", "HIJ", None, "kk-ÀÿЖz"]
    found = []
    for data, start, end, doc in spelling.runs(pa.array(texts)):
        found += [(int(d), data[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc, strict=True)]
    assert found == [(0, "abc"), (0, "défg"), (2, "hij"), (4, "kk"), (4, "Àÿ"), (4, "z")]


def test_halves_held_apart_find_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    words = spark.createDataFrame([(w, 3) for w in ("aaaaaa", "aaaaab", "aaaaba", "aaabaa", "aabaaa", "abaaaa", "baaaaa", "aaaaa", "aaaaaaa", "aaaac")], "word string, n long")
    routed = spelling._routed(words)
    assert routed.where("not scan").count() == 20 and routed.where("part > 0").count() > 0
    near = {r["word"]: r["n"] for r in spelling._found(words).groupBy("word").agg(F.sum("near").alias("n")).collect()}
    names = [r["word"] for r in words.collect()]
    assert near == {w: k for w in names if (k := sum(distance_one(w, v) for v in names))}


def test_crc_is_that_of_zlib():
    texts = ["", "a", "abc" * 60, "é", "zz" * 33]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t.encode()) for t in texts])
    start = np.append(0, end[:-1])
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in range(5)], np.uint32)
    assert spelling.crc32(prefix, data, start, end).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]


# --- periodic runs


def brute_runs(s, least_length, least_exponent):
    out, n = [], len(s)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, least_exponent * q) and not any(all(s[x] == s[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


repetitive = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=6).map(lambda parts: [x for word, k in parts for x in word * k])


@settings(max_examples=300, deadline=None)
@given(repetitive, st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_of_a_string(s, least):
    got = list(zip(*(x.tolist() for x in tandem.runs(np.array(s, np.int64), *least)), strict=True))
    assert got == brute_runs(s, *least)


def test_every_distinct_square_is_marked_by_walks():
    """The covering squares alone are not the vocabulary: walks add those that begin later."""
    s = np.array([0, 1, 0, 1, 2, 1, 0, 1, 0, 3, 0, 1, 0, 1, 0, 4])
    text = tandem.Text(s)
    lcp = np.zeros(text.n, np.int64)
    lcp[1:] = text.forward(text.order[:-1], text.order[1:])
    start, period = tandem.covering(text, lcp)
    tree = tandem.SuffixTree(s, text, lcp)
    node = tree.loci(np.array([0]), np.array([4]))[0]
    later = tree.rotated(int(node), 4)
    assert s[text.order[tree.lo[later]] :][:4].tolist() == [1, 0, 1, 0]
    assert tree.rotated(later, 4) == node
    assert {tuple(s[a : a + 2 * k]) for a, k in zip(start, period, strict=True)} <= {(0, 1, 0, 1), (1, 0, 1, 0)}


def digest(rows):
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
        found = brute_runs([ids[x] for x in w], 6, 4)
        gone = {j for a, length, q in found for j in range(a + q, a + length)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def periodic_rows():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            phrase = [rng.choice(["a", "b", "çé", "the", "w%d" % rng.randrange(40)]) for _ in range(rng.randrange(1, 8))]
            parts += phrase * rng.choice([1, 1, 2, 4, 7])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [rows[0], (3, rows[5][1]), (None, "x " * 9), (201, None), (202, ""), (203, " \n"), (204, "y " * 3000), (205, "p q r " * 400 + "z")]
    return rows


def test_periodic_runs(spark):
    rows = periodic_rows()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = tandem.periodic_runs(frame(spark, rows)).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == digest(rows)
    unique = list({i: (i, t) for i, t in rows if i is not None}.values())
    again = tandem.periodic_runs(frame(spark, unique)).select(*columns).collect()
    assert same(map(tuple, again), tandem.oracle(sql.CRC_TABLES, sql.CRC), unique, columns) == len(unique)
    assert tandem.periodic_runs(frame(spark, [])).count() == 0
