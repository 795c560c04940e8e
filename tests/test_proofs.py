"""Operators without SQL, against brute force written from their definitions, and round trips of the archive."""

import collections
import fractions
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import contigs, forest, lineage, matching, minimizers, pairs, qualities, quantize, rebin
from strandloom.plans import archive
from strandloom.plans.fixture import derived_reads
from strandloom.sources.fastq import read_fastq

CODE = {b: i for i, b in enumerate("ACGT")}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders whose derived reads come from two genomes, so that bins are deep."""
    path = str(tmp_path_factory.mktemp("orders"))
    spark.range(900).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 5 % 2).alias("o_custkey")).repartition(2).write.parquet(f"{path}/orders.parquet")
    return path


@pytest.fixture(scope="module")
def reads(spark, folder):
    return lineage.durable(derived_reads(spark, folder, True).drop("mate_head"))


@pytest.fixture(scope="module")
def binned(reads):
    return lineage.durable(minimizers.minimizer_se(reads.select("read_id", "head", "seq", "qua")))


def text(code):
    return "".join("ACGT"[code >> 2 * (7 - j) & 3] for j in range(8))


def valid(x):
    return "N" not in x and not x.startswith(("AAA", "AAC")) and "AA" not in x[1:]


def number(x):
    return sum(CODE[b] << 2 * (7 - j) for j, b in enumerate(x))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def target(seq, now, p):
    """The smallest valid code that p divides other than ``now``, its place, and whether the turned read has it."""
    found = []
    for flip, s in ((False, seq), (True, turned(seq))):
        for i in range(len(s) - 8):
            x = s[i : i + 8]
            if valid(x) and number(x) % p == 0 and number(x) != now and seq.count("N") < len(seq) // 3:
                found.append((number(x), flip, i))
    return min(found) if found else None


def cost_of(a, pa, b, pb):
    shift = pb - pa
    x, y = a[max(-shift, 0) :], b[max(shift, 0) :]
    return abs(shift) + 2 * sum(u != v for u, v in zip(x, y)), shift


def test_rebin_round(binned):
    rows = {r["read_id"]: r for r in binned.collect()}
    want = {}
    bins = collections.defaultdict(list)
    for r in rows.values():
        if r["signature"] != 65536 and r["signature"] % 2:
            bins[r["signature"]].append(r)
        else:
            want[r["read_id"]] = (r["signature"], None, False)
    for sig, inside in bins.items():
        first = {}
        for r in sorted(inside, key=lambda r: r["read_id"]):
            first.setdefault((r["seq"], r["minim_pos"]), r["read_id"])
        order = sorted(first.values(), key=lambda i: (rows[i]["seq"][rows[i]["minim_pos"] :], rows[i]["seq"][: rows[i]["minim_pos"] + 1][::-1], i))
        root = {}
        for n, i in enumerate(order):
            best = None
            for j in order[max(0, n - 15) : n][::-1]:
                c, s = cost_of(rows[i]["seq"], rows[i]["minim_pos"], rows[j]["seq"], rows[j]["minim_pos"])
                if abs(s) <= 127 and (best is None or c < best[0]):
                    best = (c, j)
            root[i] = root[best[1]] if best and best[0] <= len(rows[i]["seq"]) // 2 else i
        trees = collections.defaultdict(list)
        for r in inside:
            trees[root[first[r["seq"], r["minim_pos"]]]].append(r)
        for tree, members in trees.items():
            own = {r["read_id"]: target(r["seq"], sig, 2) for r in members}
            if len(members) > 4:
                right = own[max(members, key=lambda r: (r["minim_pos"], -r["read_id"]))["read_id"]]
                left = own[min(members, key=lambda r: (r["minim_pos"], r["read_id"]))["read_id"]]
                pick = left if left and left[0] < (right[0] if right else 65536) else right
                own = dict.fromkeys(own, pick)
            for i, t in own.items():
                want[i] = (t[0] if t else sig, tree, len(members) > 4)
    got = {r["read_id"]: (r["new_signature"], r["tree_id"], r["as_tree"]) for r in rebin.rebin_round(binned, 2, window=16).collect()}
    assert got == want and sum(x[2] for x in got.values()) > 100


def test_rebin_chain_keeps_alignments(binned):
    firsts = lineage.durable(matching.duplicates(binned.where("signature <> 65536")).drop("n_copies"))
    base = {r["read_id"]: r for r in firsts.collect()}
    heads, links = rebin.chain(firsts, window=32)
    heads, links = {r["read_id"]: r for r in heads.collect()}, {r["read_id"]: r for r in links.collect()}
    assert set(heads) | set(links) == set(base) and not set(heads) & set(links) and len(links) > 100
    seq = {i: (turned(base[i]["seq"]) if r["turned"] else base[i]["seq"]) for i, r in (heads | links).items()}
    for i, r in heads.items():
        assert r["seq"] == seq[i] and r["seq"][r["minim_pos"] : r["minim_pos"] + 8] == text(r["signature"])
    assert any(r["turned"] for r in heads.values()) and any(heads[i]["signature"] != base[i]["signature"] for i in heads)
    for i, r in links.items():
        at, steps = i, 0
        while at in links:
            at, steps = links[at]["parent_id"], steps + 1
            assert steps <= len(links)
        assert at == r["anchor_id"]
        cost, _ = cost_of(seq[i], 0, seq[r["parent_id"]], r["shift"])
        assert cost <= len(seq[i]) // 2


@pytest.mark.parametrize("window,history", [(8, 65_536), (8, 7), (32, 5)])
def test_prefix_search_sees_all_reads_before(binned, window, history):
    nodes = lineage.durable(matching.lz_nodes(binned, window, threshold=3))
    rows = {r["read_id"]: r for r in nodes.join(binned.select("read_id", "seq", "minim_pos"), "read_id").collect()}
    got = {r["read_id"]: (r["node_type"], r["parent_id"], r["shift"], r["cost"]) for r in matching.by_prefix(nodes, binned, window, history=history).collect()}
    changed = 0
    for i, r in rows.items():
        want = (r["node_type"], r["parent_id"], r["shift"], r["cost"])
        if r["node_type"] == "HARD" and r["minim_pos"] >= 8:
            pair = lambda x: (x["signature"], x["seq"][x["minim_pos"] - 2 : x["minim_pos"]])
            prefix = lambda x: x["seq"][: x["minim_pos"] - 2][::-1] + "~"
            before = sorted((prefix(x), x["rank"], x["read_id"]) for x in rows.values() if x["minim_pos"] >= 8 and pair(x) == pair(r) and x["rank"] < r["rank"])
            lower, upper = [x for x in before if x[0] < prefix(r)][::-1], [x for x in before if x[0] >= prefix(r)]
            side, best = window // 2 + 1, (len(r["seq"]) // 2,)
            for _, _, j in lower[:side] + upper[:side]:
                cost, shift = cost_of(r["seq"], r["minim_pos"], rows[j]["seq"], rows[j]["minim_pos"])
                if abs(shift) <= 127 and cost < best[0]:
                    best = (cost, j, shift)
            if len(best) > 1:
                want, changed = ("LZ", best[1], best[2], best[0]), changed + 1
        assert got[i] == want
    assert changed > 20 and len(got) == len(rows)


def test_depths_by_bin(binned):
    nodes = lineage.durable(matching.lz_nodes(binned, 32))
    rows = lambda df: sorted((r["read_id"], r["root_id"], r["depth"]) for r in df.collect())
    assert rows(forest.depths_by_bin(nodes)) == rows(forest.depths(nodes))


def grown(seqs, pos, parent, cost, shift, least, barred):
    """The rules of contigs, a read at a time: (members, main, rehung)."""
    kids = {i: [c for c in range(len(seqs)) if parent[c] == i] for i in range(-1, len(seqs))}
    below = lambda i: [c for c in kids[i] if not kids[c]] + [c for c in kids[i] if kids[c]]
    cells = [{j - p: s[j] for j in range(2, len(s) - 2)} for s, p in zip(seqs, pos, strict=True)]
    waiting, out = below(-1), []
    while waiting:
        seed, *rest = waiting
        waiting = rest + below(seed)
        if "N" in seqs[seed] or barred[seed]:
            continue
        consensus, off, depth, members, new_of = dict(cells[seed]), collections.Counter(), collections.Counter(), [seed], {}

        def joins(i, alike):
            unlike = [c for c, x in cells[i].items() if consensus.get(c, x) != x]
            new = [c for c in unlike if not off[c]]
            if barred[i] or any(x == "N" for c, x in cells[i].items() if c not in consensus) or alike and new:
                return False
            if not alike:
                if new and (len(new) > 1 or len(unlike) > 8) or abs(pos[members[-1]] - pos[i]) > len(seqs[i]) // 2:
                    return False
                deep = sum(depth[c] for c in new)
                lz = 3 + cost[i] + (1 + fractions.Fraction(2 * cost[i], 3) if abs(shift[i]) != cost[i] else 0)
                if 5 + len(unlike) - (deep > 0) + fractions.Fraction(9, 10) * deep > lz:
                    return False
            for c, x in cells[i].items():
                consensus.setdefault(c, x)
                depth[c] += 1
            off.update(unlike)
            members.append(i)
            new_of[i] = new
            return True

        for alike in (True, False):
            queue, waiting = waiting, []
            while queue:
                i, *queue = queue
                if joins(i, alike):
                    queue += below(i)
                else:
                    waiting.append(i)
        if len(members) < least:
            continue
        gone = {i for i, new in new_of.items() if any(off[c] == 1 for c in new)}
        members = [i for i in members if i not in gone]
        if len(members) >= least:
            outer = [i for i in members if parent[i] not in members and parent[i] not in gone]
            out.append((members, min(outer, key=lambda i: cost[i]), [c for i in members for c in below(i) if c not in members]))
    return out


def test_contigs_of_any_tree():
    rng = random.Random(11)
    found = 0
    for _ in range(400):
        n, size = rng.randrange(1, 50), rng.randrange(6, 30)
        locus = "".join(rng.choice("ACGT") for _ in range(3 * size))
        pos, seqs = [rng.randrange(max(1, size - 4)) for _ in range(n)], []
        for p in pos:
            s = list(locus[size - p :][: size if rng.random() < 0.8 else rng.randrange(p + 1, size + 3)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
                s[rng.randrange(len(s))] = rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT")
                if rng.random() < 0.6:
                    s[min(len(s) - 1, p + 3)] = "A"
            seqs.append("".join(s))
        parent = [rng.randrange(-1, i) if rng.random() < 0.9 else -1 for i in range(n)]
        cost, barred = [rng.randrange(20) for _ in range(n)], [rng.random() < 0.03 for _ in range(n)]
        shift, least = [rng.choice([c, -c, 0]) for c in cost], rng.randrange(1, 6)
        tree = contigs.Tree(seqs, *(np.array(x) for x in (pos, parent, cost, shift, barred)))
        got = list(tree.grow(least))
        assert [(c.members, c.main, c.rehung) for c in got] == grown(seqs, pos, parent, cost, shift, least, barred)
        for c in got:
            columns = collections.defaultdict(collections.Counter)
            for i in c.members:
                for j in range(2, len(seqs[i]) - 2):
                    columns[j - pos[i]][seqs[i][j]] += 1
            start, consensus, varied = tree.profile(c.members)
            assert {start + j: x for j, x in enumerate(consensus) if start + j in columns} == {c: max("AGCTN", key=lambda b: (k[b], -"AGCTN".index(b))) for c, k in columns.items()}
            assert varied == [c for c, k in sorted(columns.items()) if len(k) > 1]
        found += len(got)
    assert found > 500


def test_contigs_of_one_large_tree_in_a_minute():
    rng = np.random.default_rng(0)
    letters = np.array(list("ACGT"))
    locus, pos = letters[rng.integers(0, 4, 300)], rng.integers(0, 90, 20_000)
    seqs = []
    for p in pos:
        s = locus[150 - p : 250 - p].copy()
        s[rng.integers(0, 100, 3)] = letters[rng.integers(0, 4, 3)]
        seqs.append("".join(s))
    parent = np.arange(20_000) - rng.integers(1, 50, 20_000)
    began = time.perf_counter()
    list(contigs.Tree(seqs, pos, np.maximum(parent, -1), rng.integers(2, 14, 20_000), rng.integers(-2, 3, 20_000)).grow(10))
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("most", [16_384, 12])
def test_contigs(binned, monkeypatch, most):
    monkeypatch.setattr(contigs, "TREE", most)
    nodes = lineage.durable(matching.lz_nodes(binned, 64))
    depth = forest.depths_by_bin(nodes)
    rows = {r["read_id"]: r for r in nodes.join(depth, "read_id").join(binned.select("read_id", "seq", "minim_pos"), "read_id").collect()}
    made = contigs.contigs(nodes, depth, binned, least=4)
    out = made.collect()
    trees = collections.defaultdict(list)
    for r in sorted(rows.values(), key=lambda r: r["rank"]):
        if r["node_type"] == "LZ":
            trees[r["root_id"]].append(r)
    want = []
    for reads in trees.values():
        for a in range(0, len(reads), most):
            part = reads[a : a + most]
            place = {r["read_id"]: i for i, r in enumerate(part)}
            columns = [[r[c] for r in part] for c in ("seq", "minim_pos", "cost", "shift")]
            for members, main, rehung in grown(columns[0], columns[1], [place.get(r["parent_id"], -1) for r in part], columns[2], columns[3], 4, [False] * len(part)):
                want.append(tuple([part[i]["read_id"] for i in x] for x in (members, [main], rehung)))
    assert sorted((c["members"], [c["main_id"]], c["rehung"]) for c in out) == sorted(want) and len(want) > 3
    moved = {r["read_id"]: r for r in contigs.relinked(nodes, made).collect()}
    assert len(moved) == len(rows)
    for c in out:
        assert moved[c["main_id"]]["tree_parent_id"] == rows[c["main_id"]]["parent_id"] or any(c["main_id"] in x["rehung"] for x in out)
        assert all(moved[i]["tree_parent_id"] == c["main_id"] and moved[i]["contig_id"] == c["contig_id"] for i in c["members"] if i != c["main_id"])
    for i in moved:  # still a forest
        steps = 0
        while moved[i]["tree_parent_id"] is not None:
            i, steps = moved[i]["tree_parent_id"], steps + 1
            assert steps <= len(moved)
    steps = contigs.position_steps(made, binned).collect()
    assert len(steps) == sum(len(c["members"]) - 1 for c in out)
    sums = collections.Counter()
    for r in steps:
        sums[r["contig_id"]] += r["step"]
    assert all(sums[c["contig_id"]] == max(rows[i]["minim_pos"] for i in c["members"] if i != c["main_id"]) for c in out if len(c["members"]) > 1)
    sizes = {(r["metric"], r["key"]): r["cnt"] for r in contigs.histograms(made).collect()}
    assert sizes == {**{("members", k): n for k, n in collections.Counter(len(c["members"]) for c in out).items()}, **{("variants", k): n for k, n in collections.Counter(len(c["variant_cols"]) for c in out).items()}}


@pytest.mark.parametrize("window", [3, 8])
def test_pairs_repeat_within_the_window(reads, window):
    letters = lambda seed, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substr(F.lit("CG"), F.pmod(F.xxhash64(seed, i), F.lit(2)).cast("int") + 1, F.lit(1))), "")
    # first mates of a few starts before one end, second mates of many kinds: equal first mates do not stand together
    rows = reads.withColumns({"seq": F.concat(letters(F.least(F.col("read_id") % 23, F.lit(12)), 20), F.lit("AAGACACACG"), letters(F.col("read_id") % 2, 20)), "mate_seq": letters(F.col("read_id") % 90, 60)})
    both = lineage.durable(minimizers.minimizer_pe(rows))
    bins = collections.defaultdict(list)
    for r in both.collect():
        if r["signature"] != 65536:
            bins[r["signature"]].append(r)
    first, nodes = {}, {}
    for inside in bins.values():
        buffer = collections.deque(maxlen=window - 1)
        for r in sorted(inside, key=lambda r: ((r["seq"] + r["mate_seq"])[r["minim_pos"] :], r["seq"][: r["minim_pos"] + 1][::-1], r["read_id"])):
            best = (len(r["seq"]) // 2 + 1, None, None)
            for other in reversed(buffer):
                cost, shift = cost_of(r["seq"], r["minim_pos"], other["seq"], other["minim_pos"])
                if abs(shift) <= 127 and cost < best[0]:
                    best = (cost, other, shift)
            same = best[0] == 0 and len(best[1]["seq"]) == len(r["seq"])
            first[r["read_id"]] = best[1]["read_id"] if same else r["read_id"]
            if not same:
                nodes[r["read_id"]] = (best[1]["read_id"], best[2], best[0]) if best[1] else (None, None, None)
                buffer.append(r)
    assert {r["read_id"]: r["first_id"] for r in matching.pair_duplicates(both, window).collect()} == first
    got = {r["read_id"]: (r["parent_id"], r["shift"], r["cost"]) for r in matching.lz_nodes(both, window, paired=True).collect()}
    assert got == nodes and len(nodes) < len(first)
    apart = collections.Counter((r["signature"], r["seq"], r["minim_pos"]) for rows_ in bins.values() for r in rows_ if r["read_id"] in nodes)
    assert max(apart.values()) > 1  # equal first mates that are too far apart for the window


def test_pair_matches(reads):
    both = lineage.durable(minimizers.minimizer_pe(reads))
    got = {r["read_id"]: (r["flag"], r["parent_id"], r["shift"], r["cost"]) for r in pairs.pair_matches(both, window=40).collect()}
    bins = collections.defaultdict(list)
    for r in both.collect():
        if r["signature"] != 65536:
            bins[r["signature"]].append(r)
    want = {}
    for inside in bins.values():
        order = sorted(inside, key=lambda r: ((r["seq"] + r["mate_seq"])[r["minim_pos"] :], r["seq"][: r["minim_pos"] + 1][::-1], r["read_id"]))
        offers = []
        for n, r in enumerate(order):
            m = r["mate_seq"]
            mine = sorted({m[i : i + 8] for i in range(max(len(m) - 8, 1)) if valid(m[i : i + 8])})[:4]
            best = (int(len(m) / 1.5) + 1, None, None, 0)
            for s in mine:
                for j in range(n - 1, max(-1, n - 41), -1):
                    if s in offers[j]:
                        other = order[j]["mate_seq"]
                        cost, shift = cost_of(m, m.index(s), other, other.index(s))
                        if abs(shift) <= 127 and cost < best[0]:
                            best = (cost, order[j]["read_id"], shift, (cost - abs(shift)) // 2)
            cost, other, shift, wrong = best
            flag = "Difficult" if other is None else "Identical" if cost == 0 else "ShiftOnly" if wrong == 0 else "FullExpensive" if wrong > 4 else "FullEncode"
            want[r["read_id"]] = (flag, other, shift, cost if other is not None else None)
            offers.append(mine)
    assert got == want and len({x[0] for x in got.values()}) > 2


def test_quantized_output_obeys_the_codebook(reads, tmp_path):
    rows = reads.select("read_id", "qua").limit(200)
    matrix = tmp_path / "d.csv"
    matrix.write_text("# squares\n" + "\n".join(",".join(str(float((i - j) ** 2)) for j in range(72)) for i in range(72)))
    book = quantize.train(rows)
    assert quantize.train(rows, kind=str(matrix)) == book != quantize.train(rows, kind="l1")
    out = {r["read_id"]: r["qua"] for r in quantize.apply_codebook(rows, book).collect()}
    changed = 0
    for r in rows.collect():
        prev = -1
        for c, (a, b) in enumerate(zip(r["qua"], out[r["read_id"]], strict=True)):
            share, low, high = book[c, prev]
            a, prev = ord(a) - 33, ord(b) - 33
            assert prev == low[a] and share > 0 or prev == high[a] and share < 1
            changed += a != prev
    assert changed > 1000


def test_quantizers_for_an_entropy(spark):
    rng = np.random.default_rng(3)
    walk = np.clip(30 + np.cumsum(rng.integers(-3, 4, (3000, 12)), axis=1), 2, 40)
    rows = spark.createDataFrame([(i, "".join(chr(33 + q) for q in r)) for i, r in enumerate(walk.tolist())], "read_id long, qua string")
    full = 0.0
    for bits in (8.0, 16.0):
        book, target, told = quantize.train_for_bits(rows, bits)
        assert told <= bits and target > 0
        out = [r["qua"] for r in quantize.apply_codebook(rows, book).collect()]
        measured = 0.0
        for c in range(12):
            pairs_ = collections.Counter((q[c - 1] if c else "", q[c]) for q in out)
            before = collections.Counter(q[c - 1] if c else "" for q in out)
            measured -= sum(n / len(out) * np.log2(n / before[p]) for (p, _), n in pairs_.items())
        assert abs(measured - told) < 0.08 * told + 0.2 and told > 0.8 * bits
        assert measured > full
        full = measured
    counts, length = quantize._counted(rows, 33)
    assert quantize.train_for_bits(rows, 1e9)[1] == 0 and quantize.entropy(counts, length, 1e9) == 0


@pytest.mark.parametrize("paired,name,block", [(False, "lossless", 1 << 16), (False, "lossy", 9), (True, "lossy", 1 << 16), (True, "lossless", 9)])
def test_stored_archive(spark, reads, tmp_path, monkeypatch, paired, name, block):
    monkeypatch.setattr(archive, "BLOCK", block)  # bins of over 9 rows are put together from parts
    rows = reads if paired else reads.drop("mate_seq", "mate_qua")
    rows = rows.withColumn("n", F.when(F.col("read_id") % 3 == 0, F.pmod(F.xxhash64("read_id"), F.lit(101)).cast("int")).otherwise(100))  # unequal lengths
    rows = rows.withColumns({c: F.substr(c, F.lit(1), F.col("n")) for c in rows.columns if c.endswith(("seq", "qua"))}).drop("n")
    p = archive.thorough(archive.PROFILES[name], 32)
    p = archive.replace(p, least_contig=5)
    tables = archive.pack(rows, p)
    path = str(tmp_path / "a")
    archive.store(tables, path, p)
    assert archive.profile_of(spark, path) == p
    loaded = archive.load(spark, path)
    back = sorted(tuple(r) for r in archive.unpack(loaded).select(*sorted(rows.columns)).collect())
    assert back == sorted(tuple(r) for r in archive.lossy(rows, p).select(*sorted(rows.columns)).collect())
    kinds = {r["kind"] for r in loaded["nodes"].select("kind").distinct().collect()}
    assert kinds == {"HARD", "LZ", "TREE", "CONTIG"} if not paired else kinds >= {"HARD", "LZ", "TREE"}
    stats = spark.read.parquet(f"{path}/stats").agg(F.sum("n_reads"), F.sum("n_nodes")).first()
    assert stats[0] + loaded["raw"].count() == rows.count() and stats[1] == loaded["nodes"].count()
    sizes = {r["stream"]: r["symbols"] for r in archive.stream_sizes(loaded).collect()}
    assert sizes["qualities"] == loaded["members"].agg(F.sum(F.length("qua"))).first()[0] and sizes["child mismatches"] > 0
    if not paired and block > 9:
        part = archive.load(spark, path, (0, 8192))
        assert "PartitionFilters: [isnotnull(bucket" in part["nodes"]._jdf.queryExecution().toString()
        some = {tuple(r) for r in archive.unpack(part).select(*sorted(rows.columns)).collect()}
        assert some < set(back) and len(some) == part["members"].count() > 0


def test_adaptive_bits(reads):
    counts = qualities.cond_counts(reads.limit(50))
    rows = {r["prev"]: (r["n"], r["bits"]) for r in qualities.adaptive_bits(counts, ["prev"], "cur", 64).collect()}
    streams = collections.defaultdict(list)
    for r in counts.collect():
        streams[r["prev"]] += [r["cur"]] * r["cnt"]
    for prev, symbols in streams.items():
        seen, bits = collections.Counter(), 0.0
        for n, s in enumerate(symbols):  # coded one after the other; their order does not matter
            bits -= np.log2((seen[s] + 0.5) / (n + 32))
            seen[s] += 1
        assert rows[prev][0] == len(symbols) and abs(rows[prev][1] - bits) < 1e-6 * bits + 1e-6


def test_mate_files_out_of_step(spark, tmp_path):
    record = lambda n, mate, base: f"@run.{n} x/{mate}\n{base * 8}\n+\n{'I' * 8}\n"
    one, two = [1, 2, 3, 5, 6, 7, 9, 10, 11], [2, 3, 4, 5, 7, 8, 9]
    (tmp_path / "a.fq").write_text("".join(record(n, 1, "A") for n in one))
    (tmp_path / "b.fq").write_text("".join(record(n, 2, "C") for n in two))
    df = read_fastq(spark, [str(tmp_path / "a.fq")], [str(tmp_path / "b.fq")])
    got = {int(r["head"].split(".")[1].split()[0]): (r["seq"], r["mate_seq"], r["bad"]) for r in df.collect()}
    assert set(got) == set(one) | set(two)
    for n, row in got.items():
        assert row == ("A" * 8 if n in one else None, "C" * 8 if n in two else None, None if n in one and n in two else "no mate 2" if n in one else "no mate 1")
    split = lambda name: read_fastq(spark, [str(tmp_path / name)], split_bytes=70)
    joined = {r["number"]: (r["seq"], r["mate_seq"], r["bad"]) for r in pairs.by_number(split("a.fq"), split("b.fq")).collect()}
    assert joined == got
    with pytest.raises(Exception):
        read_fastq(spark, [str(tmp_path / "a.fq")], [str(tmp_path / "b.fq")], mode="FAILFAST").collect()


def test_allowed_targets(binned):
    allowed = rebin.allowed_targets(binned, 9)
    sizes = {r["signature"]: r["count"] for r in binned.groupBy("signature").count().collect()}
    assert set(np.flatnonzero(allowed).tolist()) == {s for s, n in sizes.items() if n >= 9 and s != 65536}
    found = rebin.single_targets(binned, 2, allowed=allowed).where("new_signature is not null").collect()
    assert found and all(sizes[r["new_signature"]] >= 9 for r in found)


def test_profile_is_kept_as_json():
    p = archive.thorough(archive.PROFILES["max"])
    assert json.loads(json.dumps(archive.asdict(p)))["rounds"] == [2, 4, 8]


def test_contig_position_steps_of_a_tree_that_no_block_holds(spark):
    n = 16_384 + 16
    rows = spark.range(1, n + 1).selectExpr("7 as signature", "id as read_id", "cast(id as int) + 1 as rank", "'LZ' as node_type", "id - 1 as parent_id", "0 as shift", "0 as cost", "cast(id % 20 as int) as minim_pos")
    rows = rows.withColumn("seq", F.substr(F.lit("CCGTTACG" * 5 + "ACGTCGTC" + "GGATCTTA" * 5), 41 - F.col("minim_pos"), F.lit(40)))
    depth = rows.select("read_id", F.lit(0).alias("root_id"))
    made = lineage.durable(contigs.contigs(rows.drop("seq", "minim_pos"), depth, rows))
    assert [(r["contig_id"], r["main_id"], r["start"], len(r["consensus"]), r["variant_cols"], len(r["members"])) for r in made.collect()] == [(1, 1, -17, 55, [], n)]
    steps = contigs.position_steps(made, rows).collect()
    assert len(steps) == n - 1 and sum(r["step"] for r in steps) == 19
