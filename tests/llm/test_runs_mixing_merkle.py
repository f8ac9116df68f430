"""Periodic runs, source mixing and the Merkle manifest against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import merkle, mixing, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, key string, runs string, size long, part int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- runs ------------------------------------------------------------------------------------------------------------


def brute_runs(codes, least=12):
    out = {}
    for q in range(1, len(codes) // 2 + 1):
        i = 0
        while i + q < len(codes):
            j = i
            while j + q < len(codes) and codes[j] == codes[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 30), st.integers(1, 9), st.integers(0, 40))
def test_runs_match_all_periods(codes, at, period, more):
    stretch = (codes[at : at + period] or [1]) * more
    codes = codes[:at] + stretch[:more] + codes[at:]
    assert runs.find_runs(np.array(codes, np.int64)) == brute_runs(codes)


def test_runs_do_not_rest_on_hashes(monkeypatch):
    rng, same = random.Random(4), runs.Prefixes.same
    monkeypatch.setattr(runs.Prefixes, "same", lambda self, i, d, n: same(self, i, d, n) | (rng.random() < 0.4))
    for _ in range(300):
        codes = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(12, 50))]
        assert runs.find_runs(np.array(codes)) == brute_runs(codes)


def test_long_runs_and_chunks(monkeypatch):
    codes = np.random.default_rng(3).integers(0, 50, 3000)
    codes[500:2900] = codes[500 + np.arange(2400) % 7]
    want = brute_runs(codes.tolist())
    assert (500, 2400, 7) in want and runs.find_runs(codes) == want
    monkeypatch.setattr(runs, "CHUNK", 97)
    monkeypatch.setattr(runs, "COVER", 100)
    assert runs.find_runs(codes) == want
    assert runs.find_runs(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]


def digest(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), hashlib.sha256(kept).hexdigest())


def test_run_query_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "a " * 11, "a " * 12, "a b " * 6, "x y " * 20, "\x85 z\t" * 9]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    rows = [(i, t, None, "s", 1, 2, "k", "r", 3, 4) for i, t in enumerate(texts)] + [(None, "a " * 30, *[None] * 8)]
    rows += [rows[9]] * 2
    out = runs.run_digests(spark.createDataFrame(rows, SCHEMA).repartition(3), plant=runs.planted)
    got = [tuple(r)[:1] + tuple(r)[2:9] for r in out.collect()]
    assert collections.Counter(got) == collections.Counter(digest(r[0], r[1]) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 10
    assert runs.run_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_texts(spark):
    df = spark.createDataFrame([(1, "top  x y x y x y x y x y x y end"), (2, "one  two"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 12, 2)] and got[1].collapsed == "top x y end"
    assert got[2].runs == [] and got[2].collapsed is None and got[3].runs == []


# --- mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, then what is over a cap handed on by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            out[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                open_.discard(s)
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(12)
    sources = [None, "", "a", "B", "é", "\U00020000", "z", "tiny"]
    rows = []
    for i in range(4000):
        s = rng.choice([*sources[:-1], "a", "a", "a"]) if i % 400 else "tiny"
        n = min(int(rng.paretovariate(0.8) * 4), 3000)
        rows.append((i if i % 500 else None, rng.choice([None, "", " "]) if i % 37 == 0 else "\t" + "w \n" * n, "l", s, 0, 1, "k", "r", 5, 6))
    rows += [rows[5]] * 300
    return rows


def test_mix_targets_and_words(spark, mixed):
    out = [r for r in mixing.mix_sources(spark.createDataFrame(mixed, SCHEMA).repartition(5)).collect()]
    size = lambda t: len((t or "").split())
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in out) == collections.Counter((x[0], x[3], size(x[1])) for x in mixed)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        base = want[r.source] // max(sizes[r.source], 1)
        assert base <= r.copies <= base + 1 or math.isclose(want[r.source], 3 * sizes[r.source])
    for s, words in want.items():
        assert abs(taken[s] - words) <= max(0.01 * words, 30), (s, taken[s], words)
    assert math.isclose(sum(want.values()), sum(sizes.values()), rel_tol=1e-9)


def test_mix_repeats_and_is_unbiased(spark, mixed):
    df = spark.createDataFrame(mixed, SCHEMA)
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    first, again = (sorted(map(key, mixing.mix_sources(df.repartition(n)).collect())) for n in (2, 9))
    assert first == again
    # documents of every length are taken at about their source's rate
    out = mixing.mix_sources(df).collect()
    for low, high in ((1, 10), (10, 50), (50, 5000)):
        some = [r for r in out if low <= r["size"] < high and r.source == "a"]
        rate = some[0].target / some[0].source_size
        assert abs(sum(r.copies for r in some) / len(some) - rate) < 0.12


def test_mixed_documents(spark, mixed):
    df = spark.createDataFrame(mixed, SCHEMA)
    want = mixing.mix_sources(df).agg(F.sum("copies")).first()[0]
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and got.count() == want


def test_mix_small(spark):
    def mix(rows):
        return mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()

    assert mix([]) == []
    assert [(r.target, r.taken) for r in mix([(1, None, None)])] == [(0.0, 0)]
    assert [(r.target, r.taken) for r in mix([(1, "a b c", "x")])] == [(3.0, 3)]
    got = {r.doc_id: r for r in mix([(1, "a " * 100, "x"), (2, "a", "y"), (3, "", "z")])}
    assert got[1].target == 98.0 and got[2].target == 3.0 and got[2].taken == 3 and got[3].target == 0.0


# --- manifest --------------------------------------------------------------------------------------------------------


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves):
    """The top, and for each leaf its siblings to the left and right, upwards."""
    paths, own, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        above, below = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in own[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            above.append(sha(*run))
            below.append(sum(own[a : a + 16], []))
        nodes, own = above, below
    return nodes[0], paths


def brute_manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = collections.defaultdict(list)
    for doc, source, lang, n, text in rows:
        leaf = sha(*map(encoded, (doc, source, lang, n, text)))
        changed = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        by_source[source].append((doc is not None, doc or 0, leaf, sha(*map(encoded, (doc, source, lang, n, text.translate(lower)))) if changed else leaf, doc))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by_source[s])]) for s in names}
    root, upper = brute_tree([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, upper, strict=True):
        for (_, _, leaf, start, doc), path in zip(sorted(by_source[s]), trees[s][1], strict=True):
            path = path + over
            for a, b in path:
                start = sha(*a, start, *b)
            out.append((doc, leaf, trees[s][0], root, sha(*(x for a, b in path for x in a + b)), start, start == root))
    return collections.Counter(out)


def manifest(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lowered(F.col("text")))
    return collections.Counter(map(tuple, merkle.manifest(df, tampered=tampered).drop("source").collect()))


@pytest.mark.parametrize("many", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, many):
    rows = [(i, "s", None, 3, f"Text {i}") for i in range(many)]
    assert manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)) == brute_manifest(rows)


def test_manifest_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(9000)]), rng.choice(["a", "a", "a", "b", None, "", "é", f"z{rng.randrange(30)}"]), None, rng.choice([None, 5]), rng.choice([None, "", "Abc", "xÉZ"])) for _ in range(6000)]
    rows += rows[:40] + [(i, "a", "l", 1, "T") for i in range(9000, 12000)]
    wide = spark.createDataFrame([(d, t, l, s, n, 1, "k", "r", 2, 3) for d, s, l, n, t in rows], SCHEMA).repartition(5)
    assert manifest(wide) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "folded_root" in out.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.lists(st.integers(0, 5000), max_size=6))
def test_mountains_record_each_node_once(n, cuts):
    """Whatever pieces the leaves come in, the records are the nodes of the tree that the pieces hold whole, and the peaks all others."""
    leaves = [str(i) for i in range(n)]
    records = []
    cuts = sorted({0, n, *(c for c in cuts if c < n)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        m = merkle.Mountains(b"k", n)
        for i in range(a, b):
            m.add(i, leaves[i])
        records += m.close()
    seen = [(r[2], r[3]) for r in records]
    assert len(seen) == len(set(seen))
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    assert all(levels[r[2]][r[3]] == r[4] for r in records)
    # merging the peaks level by level gives the top
    known = {(r[2], r[3]): r[4] for r in records}
    peaks = {(r[2], r[3]) for r in records if r[5]}
    for level in range(len(levels) - 1):
        for k in {i // 16 for lv, i in peaks if lv == level}:
            run = [known[level, i] for i in range(16 * k, min(16 * k + 16, len(levels[level])))]
            known[level + 1, k] = sha(*run)
            peaks.add((level + 1, k))
    assert n == 1 or known[len(levels) - 1, 0] == levels[-1][0]
