"""Operators on small fixtures against brute-force versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import decontam, dedup, licenses, lines, packing, pii, quality, quoting, sharding, warc
from inkstone.llm._bytes import blocks
from inkstone.llm._graph import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, size long, component long, ids string, hits string"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def make_texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = prose(120)
    near = []
    for k in range(30):
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        near.append(" ".join(w))
    texts = [None, "", " \n\t", "one", "ONE", "two words", "é 　 ü ñ", base, base, base.upper(), *near, prose(3000), "same line here again\n" * 40 + prose(30)]
    texts += [prose(rng.randint(5, 80)) + "\n" + prose(30) for _ in range(40)]
    texts += ["a shared line of some words\n" + prose(50) for _ in range(20)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, 2, 3, "x", "y") for i, t in enumerate(make_texts())]
    rows.append(rows[20])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


# --- graph -----------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def base_rules(t):
    w = spaced(t)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\té#|　\x85", max_size=40)), min_size=1, max_size=8))
def test_base_rules(texts):
    got = []
    for b in blocks(pa.array(texts, pa.string())):
        got += list(zip(*[x.tolist() for x in quality._base(b)], strict=True))
    assert got == [base_rules(t) for t in texts]


def test_quality(docs, none):
    texts = make_texts()
    for i, rows in by_id(quality.quality_rules(docs)).items():
        n, chars, symbols, dup, rep = base_rules(texts[i])
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
            assert not (r.kept and r.base_failed)
    kept = {i for i, rows in by_id(quality.quality_rules(docs)).items() if rows[0].kept}
    assert {r.doc_id for r in quality.keep_accepted(docs).collect()} == kept
    assert quality.quality_rules(none).count() == 0


def test_bands():
    limits, packer = quality.Limits(), __import__("zstandard").ZstdCompressor(level=3)
    rng = random.Random(2)
    noise = bytes(rng.randrange(256) for _ in range(9000))
    assert quality._measure(b"abcdefgh " * 2000, limits, packer)[3] == "repetitive"
    assert quality._measure(noise, limits, packer)[3] == "incompressible"
    prose = " ".join(rng.choice(WORDS) for _ in range(3000)).encode()
    assert quality._measure(prose, limits, packer)[3] is None
    assert quality._measure(prose[:4096] + b"a" * 12288, limits, packer)[3] is not None


def test_bands_reject_repeats_base64_and_random_letters():
    limits, packer = quality.Limits(), __import__("zstandard").ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    rng = random.Random(3)
    prose = re.sub(r"\s+", " ", " ".join(t for _, t in licenses.TEMPLATES if len(t) > 300)).encode()
    verdict = lambda raw: quality._measure(raw, limits, packer)[3]
    assert verdict(b"spam " * 10) == verdict((b"the same words again " * 9)[:150]) == "repetitive" and verdict(b"It rains today, but tomorrow we walk to the old mill by the river.") is None
    for n in (500, 900, 1800, 3000):
        assert verdict(prose[:n]) is None
    for n in (900, 3000, 9000, 40000):
        assert verdict((prose[:120] * n)[:n]) == "repetitive"
        assert verdict(__import__("base64").b64encode(rng.randbytes(n))[:n]) == "incompressible"
    for n in (1500, 3000, 9000, 40000):
        assert verdict("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()) == "incompressible"
        assert verdict("".join(chr(0x4E00 + rng.randrange(2500)) for _ in range(n // 3)).encode()) is None
    words = " ".join(rng.choice(WORDS) for _ in range(900)).encode()[:4096]
    assert verdict(words + __import__("base64").b64encode(rng.randbytes(6144))) is not None


# --- near duplicates -------------------------------------------------------------------------------------------------


def components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, none, n):
    sets = {}
    for i, t in enumerate(make_texts()):
        w = spaced((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    want = components(sets)
    got = by_id(dedup.near_duplicates(docs, words_per=n))
    assert {i: r[0].component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, rows in got.items() for r in rows)
    assert sum(map(len, got.values())) == docs.count()
    if n == 2:
        assert dedup.near_duplicates(none).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------


def contamination(t, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((t or "").translate(LOWER))
    hit, found = set(), set()
    for i, text in items:
        v = word.findall((text or "").translate(LOWER))
        m = min(n, len(v))
        windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v and i is not None else set()
        for k in range(len(w) - m + 1) if m else ():
            if tuple(w[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_contamination(spark, docs, none):
    texts = make_texts()
    items = [(1, " ".join(texts[7].split()[10:40])), (2, "w1 w2"), (3, None), (4, ""), (10, texts[40][:200] if texts[40] else ""), (11, "Shared-Line of some words!"), (12, "w1 w2"), (None, "w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for i, rows in by_id(decontam.find_contamination(docs, bench)).items():
        n, hit, found = contamination(texts[i], items)
        for r in rows:
            assert (r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) == (n, hit, found), i
    clean = {i for i, t in enumerate(texts) if not contamination(t, items)[1]}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == clean
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_item_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(60)], "item_id long, text string")
    whole = {(r.doc_id, tuple(r["items"]), str(r.hits)) for r in decontam.find_contamination(docs, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_TEXT", 150)
    assert {(r.doc_id, tuple(r["items"]), str(r.hits)) for r in decontam.find_contamination(docs, items).collect()} == whole
    assert {r.doc_id for r in decontam.drop_contaminated(docs, items).collect()} == {i for i, found, _ in whole if not found}


# --- forest ----------------------------------------------------------------------------------------------------------


def test_forest_pairs_share_their_prefixes(spark):
    rng = np.random.default_rng(6)
    assert dedup.common_prefixes(np.array([0, 0, 0, 1]), np.array([[1, 2, 3], [1, 2, 4], [5, 2, 4], [5, 2, 4]])).tolist() == [2, 0, 0]
    values = rng.integers(0, 2, (300, dedup.TREES * dedup.DEPTH)).astype(">u4")
    reps = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(values)], "doc_id long, sig binary").repartition(5)
    rows = dedup._forest(reps).collect()
    pairs = [r for r in rows if r.kind == 0]

    def shared(u, v):
        same = (values[u] == values[v]).reshape(dedup.TREES, dedup.DEPTH)
        return np.cumprod(same, axis=1).sum(axis=1)

    assert len(pairs) > 10_000 and all(r.u < r.v and r.prefix >= dedup.MIN_DEPTH and r.prefix in shared(r.u, r.v) for r in pairs)
    # whoever shares MIN_DEPTH values with more than the neighbourhood is a member of that bucket
    members = {(r.key, r.u) for r in rows if r.kind == 1}
    for t in range(dedup.TREES):
        heads = [v[t * dedup.DEPTH : t * dedup.DEPTH + dedup.MIN_DEPTH].tobytes() for v in values]
        for i, h in enumerate(heads):
            assert heads.count(h) <= dedup.NEIGHBOURS + 1 or (bytes([t]) + h, i) in {(bytes(k), u) for k, u in members}


# --- packing ---------------------------------------------------------------------------------------------------------


def test_parts_encode_like_whole_texts():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.default_vocabulary()), packing.PartEncoder(packing.default_vocabulary())
    texts = [*make_texts(), " a", "a ", "a  b", "x<|endoftext|> y", "don't 's\n a\tb", "中 文 a 　 b c d   e", "a  b", "　 x"]
    got = []
    for b in blocks(pa.array(texts, pa.string())):
        ids, first = e.encode(b)
        got += [ids[first[d] : first[d + 1]].tolist() for d in range(b.rows)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=2, max_size=40))
def test_plan_uses_each_piece_once(counts):
    counts = np.array([0, *counts])
    top = len(counts) - 1
    used = np.zeros(len(counts), int)
    for times, lengths in packing.plan(counts, top):
        assert times > 0 and sum(lengths) <= top
        for x in lengths:
            used[x] += times
    assert (used == counts).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=12), st.integers(1, 24))
def test_exact_finds_any_combination(counts, gap):
    stock = packing.Sums(np.array([0, *counts, *[0] * 30]))
    lengths = [i for i, n in enumerate([0, *counts]) for _ in range(n)]
    there = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(lengths, k))
    got = stock.exact(gap)
    assert (got is not None) == there and (got is None or sum(got) == gap and all(stock.counts[x] >= got.count(x) for x in got))


def test_exact_finds_any_combination_as_stock_runs_out():
    rng = random.Random(2)
    for _ in range(150):
        stock = packing.Sums(np.array([0, *(rng.choice((0, 0, 1, 2)) for _ in range(14)), *[0] * 14]))
        for _ in range(4):
            lengths = [i for i, n in enumerate(stock.counts) for _ in range(n)]
            if not lengths:
                break
            sums = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(lengths, k)}
            assert {gap for gap in range(1, 29) if stock.exact(gap)} == {x for x in sums if x < 29}
            stock.take(rng.choice(lengths), 1)


def test_exact_tries_a_members_other_pairs():
    assert packing.Sums(np.array([0, 0, 1, 2, 1, 0, 0, 0, 0, 0, 0])).exact(10) == (4, 3, 3)


def test_pack(docs, none):
    got = by_id(packing.pack(docs, packing.default_vocabulary(), capacity=256, extra=["lang"]))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    spans = collections.defaultdict(list)
    for i, text in enumerate(make_texts()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted(got[i], key=lambda r: r.piece)[:: 2 if i == 20 else 1]
        assert [x for r in rows for x in r.ids] == ids and [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist()
        assert all(r.length == 256 for r in rows[1:]) and all(r.lang == "en" for r in rows)
    for rows in got.values():
        for r in rows:
            spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    free = []  # first fit decreasing
    for x in sorted((x for s in spans.values() for _, x in s), reverse=True):
        k = next((k for k, f in enumerate(free) if f >= x), len(free))
        free[k : k + 1] = [(free[k] if k < len(free) else 256) - x]
    assert len(spans) <= len(free)
    assert packing.pack(none, packing.default_vocabulary()).count() == 0


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_warc_roundtrip(spark, tmp_path):
    big = "é" * 60_000 + "WARC/1.1\r\n\r\n"
    rows = [(1, "http://a b", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (9, "u", "x" * 200), (9, "u", "x" * 200), (None, "u", "n" * 300), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    assert read.where("not intact").count() == 0
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(read).collect())
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i > first[h]
        want.append((i or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=lambda x: x[:4])
    payloads = {r.page_id: bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert payloads[7].decode() == big and payloads[3] == b""


def test_warc_damage(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert warc.dechunk(block) == b"abc" and warc.dechunk(block[:-12]) is None and warc.dechunk(b"nothing") is None and warc.dechunk(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    record = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:x:{}>\r\n{}Content-Length: {}\r\n\r\n{}\r\n\r\n"
    text = record.format("response", 1, "WARC-Segment-Number: 1\r\n", 5, "HTTP/") + record.format("continuation", "1-3", "WARC-Segment-Number: 3\r\nWARC-Segment-Origin-ID: <urn:x:1>\r\nWARC-Segment-Total-Length: 9\r\n", 4, "lost")
    (tmp_path / "a.warc").write_bytes(text.encode())
    assert [(r.intact, r.payload) for r in warc.read_warc(spark, str(tmp_path / "a.warc")).collect()] == [(False, None)]


# --- sharding --------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 5), min_size=1, max_size=10), st.integers(1, 8))
def test_minimax(sizes, shards):
    runs = sorted(sizes.items(), reverse=True)
    items = [s for s, n in runs for _ in range(n)]

    def fits(c):
        used, free = 1, c
        for x in items:
            if x > free:
                used, free = used + 1, c
            free -= x
        return used <= shards

    least = next(c for c in range(max(items), sum(items) + 1) if fits(c))
    load = collections.Counter()
    for size, a, b, shard in sharding.minimax_cuts(runs, shards):
        load[shard] += size * (b - a)
    assert max(load.values()) == least and sum(load.values()) == sum(items) and max(load) < shards


def test_shards(docs, none):
    texts = make_texts()
    rows = sharding.shard_documents(docs, shards=7).collect()
    homes, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        homes[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count() and all(len(x) == 1 for x in homes.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard_documents(none).count() == 0


# --- quotations ------------------------------------------------------------------------------------------------------


def test_quotations(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line"), (1, 1, "bot", "> Hello  THERE\n> second line\nI see."), (1, 2, "user", "unrelated"), (1, 3, "user", ">> Hello there\n>> second line\n> I see.\nGood"), (1, 4, "x", "> unrelated\nok"), (1, 4, "x", "> unrelated\nok"), (2, 0, "user", None), (2, 1, "u", "> nothing has this"), (None, 1, "u", "a"), (3, None, "u", "b"), (4, 2, "u", "> later"), (4, 5, "u", "later"), (4, 2000, "u", "> later\nyes"), (4, 2001, "u", "later"), (4, 2002, "u", "> later")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = quoting.link_quotations(df)
    got = sorted(((r.conv_id, r.position, r.turn, r.text, r.max_level, r.reply_to, r.root) for r in linked.collect()), key=str)
    want = [(1, 0, 0, "Hello there\nsecond line", 0, None, 0), (1, 1, 1, "I see.", 1, 0, 0), (1, 2, 3, "Good", 2, 1, 0), (1, 3, 2, "unrelated", 0, None, 2), (1, 4, 4, "ok", 1, 2, 2), (1, 5, 4, "ok", 1, 2, 2), (2, 0, 0, "", 0, None, 0), (2, 1, 1, "", 1, None, 1), (None, None, 1, "a", 0, None, 1), (3, None, None, "b", 0, None, None)]
    want += [(4, 0, 2, "", 1, None, 2), (4, 1, 5, "later", 0, None, 5), (4, 2, 2000, "yes", 1, 5, 5), (4, 3, 2001, "later", 0, None, 2001), (4, 4, 2002, "", 1, 2001, 2001)]
    assert got == sorted(want, key=str)
    assert {(r.conv_id, len(r.messages)) for r in quoting.build_conversations(linked).collect()} == {(1, 6), (2, 2), (4, 5)}
    assert quoting.link_quotations(df.limit(0)).count() == 0


def test_quoted_excerpts(spark):
    first = "one alpha\ntwo beta\nthree gamma\nfour delta\nfive\nsix"
    rows = [
        (1, 0, "a", first), (1, 1, "b", "three gamma\nunrelated words"),
        (1, 2, "c", "> two beta\n> three gamma\n> four delta\nyes"),  # lines 2 to 4 of 6; one of them stands alone later
        (1, 3, "d", "para one\nits end\n\npara two\n\npara three"), (1, 4, "e", "> para one\n> its end\n>\n> para two\nno"), (1, 5, "f", "> para one\n> its end\nagain"),
        (1, 6, "g", "> para two\n> with another ending\nwell"), (1, 7, "h", "> nobody said this\n> nor this\nhm"),
    ]
    got = {r.turn: (r.reply_to, r.root, r.n_quotes, r.n_linked) for r in quoting.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0, 0), 1: (None, 1, 0, 0), 2: (0, 0, 1, 1), 3: (None, 3, 0, 0), 4: (3, 3, 1, 1), 5: (3, 3, 1, 1), 6: (3, 3, 1, 1), 7: (None, 7, 1, 0)}


def brute_threads(rows):
    """(conversation, turn) -> (text, n_quotes, n_linked, reply_to, root), and each conversation's turns in order, for distinct places."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").lower()
    units = lambda t: [(2, norm(t))] + [(1, norm(x)) for x in re.split(r"\n(?:[ \t]*\n)+", t)] + [(0, norm(x)) for x in t.split("\n")]
    parsed, raw = {}, {(conv, turn): text for conv, turn, text in rows}
    for conv, turn, text in rows:
        passages = []
        for line in text.split("\n"):
            lead = re.match(r"[ \t>]*", line)[0]
            level, body = lead.count(">"), line
            if level:
                body = line[lead.rindex(">") + 1 :]
                body = body[1:] if body[:1] in (" ", "\t") else body
            if passages and passages[-1][0] == level:
                passages[-1][1] += "\n" + body
            else:
                passages.append([level, body])
        parsed[conv, turn] = [(n, t) for n, t in passages if norm(t)]
    own = {place: {u for n, t in passages if n == 0 for _, u in units(t) if u} for place, passages in parsed.items()}
    out, order = {}, {}
    for (conv, turn), passages in sorted(parsed.items()):
        found = {}
        for level, text in passages:
            if level:
                by_unit = {}
                for kind, u in units(text):
                    if u:
                        by_unit[u] = max(kind, by_unit.get(u, 0))
                shares = collections.Counter()
                for u, kind in by_unit.items():
                    if before := [t for c, t in parsed if c == conv and t < turn and u in own[c, t]]:
                        shares[kind, max(before)] += len(u)
                if shares:
                    found[level, norm(text)] = max((kind, n, source) for (kind, source), n in shares.items())
        answer = max(((-level, kind, source) for (level, _), (kind, _, source) in found.items()), default=(0, 0, None))[2]
        root = turn if answer is None else out[conv, answer][4]
        # a message without marks stays as it is
        clean = "\n".join(t for n, t in passages if n == 0).strip(" \t\r\n") if re.search(r"^[ \t]*>", raw[conv, turn], re.M) else raw[conv, turn]
        out[conv, turn] = (clean, sum(n > 0 for n, _ in passages), len(found), answer, root)
        order.setdefault(conv, []).append((root, turn))
    return out, {c: [t for _, t in sorted(x)] for c, x in order.items()}


def test_quotations_against_brute_force(spark):
    rng = random.Random(21)
    said = [f"{a} {b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three", "four")]
    rows = []
    for conv in range(4):
        texts = []
        for turn in range(60):
            lines_ = []
            for _ in range(rng.randint(0, 2)):
                if texts:
                    old = rng.choice(texts).split("\n")
                    a = rng.randrange(len(old))
                    lines_ += [rng.choice(("> ", ">", " > ")) + x for x in old[a : a + rng.randint(1, 4)]]
                lines_ += [rng.choice(said)] * rng.randint(0, 1)
            lines_ += [rng.choice([*said, "", f"own {turn}"]) for _ in range(rng.randint(1, 4))]
            texts.append("\n".join(lines_))
            rows.append((conv, turn * rng.choice((1, 1, 1000)) if not turn else rows[-1][1] + rng.choice((1, 900)), texts[-1]))
    want, order = brute_threads(rows)
    linked = quoting.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4), extra=()).collect()
    assert {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.reply_to, r.root) for r in linked} == want
    assert {c: [r.turn for r in sorted(linked, key=lambda r: r.position) if r.conv_id == c] for c in order} == order
    assert sum(x[3] is not None for x in want.values()) > 60


def test_quotations_in_long_conversations_and_long_messages(spark):
    marks = ">" * 100_000
    rows = [(1, t, f"a message of its own {t}") for t in range(3000)] + [(1, t, "> a message of its own 0\nthis answers the first") for t in range(3000, 4000)]
    rows += [(2, 0, marks + " deep"), (2, 1, "\n".join("> " * (i % 2) + f"line {i}" for i in range(20_000))), (2, 2, "> line 19998\nyes")]
    got = {(r.conv_id, r.turn): r for r in quoting.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3), extra=()).collect()}
    place = {t: (t if t == 0 else t + 1000 if t < 3000 else t - 2999) for t in range(4000)}
    assert {t: got[1, t].position for t in range(4000)} == place and {got[1, t].root for t in range(3000, 4000)} == {0}
    assert got[2, 0].max_level == 100_000 and got[2, 1].n_quotes == 10_000 and got[2, 2].reply_to == 1


# --- lines -----------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    """Levenshtein distance, a row at a time."""
    y = np.array([ord(c) for c in b], np.int64)
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, c in enumerate(a, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != ord(c)))])
        row = np.minimum.accumulate(best - place) + place
    return int(row[-1])


def brute_lines(texts):
    """The texts (by id) without duplicate lines, all pairs of lines compared by edit similarity alone."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    first = {}
    for i in sorted(texts):
        for k, x in enumerate(texts[i].split("\n") if texts[i] is not None else []):
            if norm(x):
                first.setdefault(norm(x), (i, k))
    parent = {u: u for u in first}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(first, 2):
        n = max(len(a), len(b))
        if 100 * min(len(a), len(b)) >= 80 * n and find(a) != find(b) and edit_distance(a, b) <= n * 20 // 100:
            x, y = sorted((find(a), find(b)), key=first.get)
            parent[y] = x
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not norm(x) or first[find(norm(x))] == (i, k)) for i, t in texts.items()}


def test_line_dedup(docs, none):
    texts = dict(enumerate(make_texts()))
    want, got = brute_lines(texts), by_id(lines.dedup_lines(docs))
    assert {i: {r.text for r in rows} for i, rows in got.items()} == {i: {t} for i, t in want.items()}
    assert sum(map(len, got.values())) == docs.count() and lines.dedup_lines(docs).columns == [*docs.columns, "n_lines_removed"]
    assert lines.dedup_lines(none).count() == 0


def test_line_dedup_of_a_large_group_apart_from_its_leader(spark):
    # variants of one line of ten words, two words off: near their original, not near each other
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(10)]
    texts = []
    for _ in range(40):
        w = list(base)
        for k in rng.sample(range(10), 2):
            w[k] = word()
        texts.append(" ".join(w))
    # a frequent stranger with the words at the front leads their common buckets
    texts += [" ".join(base[:6] + [word() for _ in range(5)])] * 3 + [" ".join(base)]
    rng.shuffle(texts)
    want = brute_lines(dict(enumerate(texts)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == want and sum(bool(t) for t in want.values()) == 2


def test_line_dedup_of_long_lines_and_clashing_columns(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = [x if rng.random() > 0.05 else f"x{rng.randrange(10**6)}" for x in w]
    other = [f"y{rng.randrange(10**6)}" for _ in range(60_000)]
    solid = "".join(rng.choice("abcdefgh0123456789") for _ in range(300_000))
    texts = [" ".join(w), " ".join(near), " ".join(other), solid, solid[:100_000] + "-" + solid[100_001:]]
    rows = [(i, t, i, f"n{i}", True, [i], i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _row_key string, _new boolean, n_lines_removed array<long>, uid long")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_gone", "_row_key", "_new", "uid", "n_lines_removed"]
    assert sorted((r.doc_id, r.text, r._gone, r._row_key, r.n_lines_removed) for r in got.collect()) == [(i, "" if i in (1, 4) else t, i, f"n{i}", int(i in (1, 4))) for i, t in enumerate(texts)]


def test_line_sketches():
    rng = random.Random(4)
    texts = ["", "short", "a" * 1000, *("".join(rng.choice("abc \u4e00\U0001f600") for _ in range(n)) for n in (11, 12, 47, 48, 300, 301, 5000)), None]
    got = lines.sketch(pa.array(texts)).to_pylist()
    assert got == [x for t in texts for x in lines.sketch(pa.array([t])).to_pylist()]
    for t, g in zip(texts, got, strict=True):
        t = t or ""
        codes = np.array([ord(c) for c in t], np.uint64)
        runs = sorted(set(lines._run_hashes(codes, 6).tolist()))[: lines.KEYS]
        blocks = 4 if len(t) >= lines.SIM_CHARS else 0
        assert len(g["keys"]) == (len(runs) if len(t) >= 12 else 0) + blocks
        assert set((lines._mixed(np.array(runs if len(t) >= 12 else [], np.uint64) >> np.uint64(12)) & ~np.uint64(1)).view(np.int64).tolist()) == {k for k in g["keys"] if k % 2 == 0}
        h = lines._run_hashes(codes, 4)
        for name, x in (("s", h), ("s2", lines._mixed(h + np.uint64(1)))):
            bits = sum((2 * sum(v >> b & 1 for v in x.tolist()) > len(x)) << b for b in range(64))
            assert g[name] == (int(np.uint64(bits).view(np.int64)) if blocks else None)


def test_line_dedup_finds_what_edit_distance_finds(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    texts = ["die.", "doie.", "abcdefgh", "abcdefghxy", "supercalifragilistic", "supercalifragilixtic"]
    for n in (5, 10, 10, 20, 20, 30, 50, 100):
        w = [word() for _ in range(n)]
        texts.append(" ".join(w))
        w[rng.randrange(n)] = word()
        texts.append(" ".join(w))
    for n in (12, 30, 60, 200):
        x = han(n)
        texts += [x, x[: n // 2] + "\u3042" + x[n // 2 + 1 :]]
    alike = lambda a, b: 100 * edit_distance(a, b) <= 20 * max(len(a), len(b))
    want = {j for j, b in enumerate(texts) if any(alike(a, b) for a in texts[:j])}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in lines.dedup_lines(df).collect() if r.n_lines_removed} == want and len(want) > 12


# --- licences --------------------------------------------------------------------------------------------------------


def test_licenses(spark, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(t):
        w = word.findall(t.translate(LOWER))
        return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {(x,) for x in w}

    known = [(n, grams(t)) for n, t in licenses.TEMPLATES]

    def best(t):
        u = grams(t)
        found = [(-2 * len(u & s) / (len(u) + len(s)), n) for n, s in known if u and 10 * len(u & s) >= 4 * (len(u) + len(s))]
        return min(found) if found else None

    mit = licenses.TEMPLATES[5][1]
    texts = [None, "", "licensed", "Released under the MIT license!", "intro\n\n" + mit.replace(". ", ".\n") + "\n\nmore words here", "# Licensed under the Apache License,\n# Version 2.0.", mit.lower(), "nothing of the kind\n" * 50, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        t = texts[r.doc_id] or ""
        units = [t, *(t.split("\n") if "\n" in t else [])]
        blank = re.split(r"\n(?:[^\w\n]*\n)+", t)
        hits = [b for u in units if (b := best(u))] + [b for p in blank if "\n" in p and p != t and (b := best(p))]
        assert r.n_matches == len(hits) and r.license == (min(hits)[1] if hits else None)
        assert r.score is None if not hits else abs(r.score + min(hits)[0]) < 1e-9
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_inside_prose_and_over_paragraphs(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    notices = {n: t for n, t in licenses.TEMPLATES if 300 < len(t) < 2000 and n in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause")}
    full = {n: t for n, t in licenses.TEMPLATES if len(t) > 4000}
    assert len(notices) == 4 and {"Apache-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"} <= set(full)
    cases = [(n, prose(80) + "\n\n" + re.sub(r"(\.|:) ", r"\1\n\n", t) + "\n\n" + prose(80)) for n, t in notices.items()]
    cases += [("MIT", "The code is free to use. Released under the MIT License. Pull requests are welcome.")]
    cases += [(n, prose(300) + "\n\n" + t + "\n" + prose(300)) for n, t in full.items()] + [(None, prose(400))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, (n, t) in enumerate(cases):
        assert got[i].license == n, (i, n, got[i])
        for m in got[i].matches:
            assert 0 <= m.start < m.end <= len(t.encode()) and m.score >= 0.8
    two = cases[0][1] + "\n" + cases[0][1] + " " + cases[4][1]
    assert len(licenses.scan_licenses(spark.createDataFrame([(1, two)], "doc_id long, text string")).first().matches) == 3


# --- personal data ---------------------------------------------------------------------------------------------------


def strict_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "1", "4", "255", "0", " ", "+", "(", ")", "_", "b.c", "@d.e", "012", "4111111111111111", "+1 (988) 555-2485", "é"]), max_size=14).map("".join))
def test_strict_spans(text):
    assert pii.base_spans(text) == strict_spans(text)


def test_strict_spans_of_very_long_runs():
    for text in ("7" * 1_000_000, "1." * 300_000, "1..2." * 100_000 + "1.2.3.4", "+1" + " (" * 200_000, "a" * 500_000 + "@" + "b" * 500_000, "- " * 300_000 + "4111-1111-1111-1111"):
        assert [(k, b - a) for a, k, b in pii.base_spans(text)][-1:] == {"1": [(1, 7)], "-": [(2, 19)]}.get(text[0], [])
        pii.candidates(text)


def test_personal_data(spark, docs, none):
    rng = random.Random(3)
    texts = [f"w1 w2 mail me at ab{i}.c@mail.example.com or {rng.randint(1, 255)}.1.2.{i} w3" for i in range(40)] + [f"contact us: jo{i} (at) example (dot) org w4" for i in range(40)] + [None, "", "clean words only", "order 1234567890123 of page 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        base = [(x.start, x.kind, x.end) for x in rows[i].base]
        spans = [(x.start, x.kind, x.end) for x in rows[i].spans]
        assert base == strict_spans(t) and set(base) <= set(spans)
    assert sum(len(rows[i].spans) for i in range(40, 80)) >= 30, "obfuscated addresses are found"
    assert not rows[80].spans and not rows[82].spans and not rows[83].spans
    assert pii.find_personal_data(none).count() == 0


def test_few_candidates_are_decided_too(spark, none):
    texts = [f"contact us: jo{i} (at) example (dot) org w4" for i in range(8)] + ["order 1234567890123 of page 5"]
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(len(rows[i]) == 1 for i in range(8)) and not rows[8]


def test_em_separates_reliable_votes():
    # labelers 0 and 5 are right together, labeler 3 guesses
    right, wrong, guess = 1 | (1 << 10), 2 | (2 << 10), 1 << 6
    q = pii.em(np.array([right | guess, right, wrong | guess, wrong]), np.array([50.0, 50, 50, 50]))
    assert q[0] > 0.9 and q[1] > 0.9 and q[2] < 0.1 and q[3] < 0.1
