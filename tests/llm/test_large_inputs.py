"""Inputs that are large in one way: blank lines, copies of items, notices in one text, lines that share an opening, typos all over a line."""

import random
import string
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.llm import decontam, licenses, lines, quoting


def test_a_megabyte_of_blank_lines(spark):
    blank = "\n" * 500_000 + "some words here\n" + " \r\n" * 200_000
    rows = [(1, 0, "user", blank), (1, 1, "user", "> some words here\nyes"), (1, 2, "user", "a first paragraph\nof two lines\n \t\n\r\n\nand a second one"), (1, 3, "user", "> and a second one\n>\n>\nright")]
    got = {r.turn: r for r in quoting.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].reply_to == 0 and got[3].reply_to == 2 and got[0].reply_to is None


def test_copies_of_items_in_small_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(12))), (2, "nothing here")], "doc_id long, text string")
    items = spark.range(100_000).select(F.lit("a").alias("item_id"), F.lit(" ".join(f"w{i}" for i in range(12))).alias("text"))
    items = items.unionByName(spark.createDataFrame([("b", "v " * 3000), ("c", "nothing here")], "item_id string, text string"))
    whole = {r.doc_id: (r["items"], r.hits) for r in decontam.find_contamination(docs, items).collect()}
    assert whole[1][0] == ["a"] and whole[2][0] == ["c"]
    monkeypatch.setattr(decontam, "BLOCK_TEXT", 1000)
    assert {r.doc_id: (r["items"], r.hits) for r in decontam.find_contamination(docs, items).collect()} == whole


def test_ten_megabytes_of_notices(spark):
    mit = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    notice = " ".join(mit.split()) + " other words between notices "
    text = notice * (10_000_000 // len(notice))
    began = time.time()
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_matches >= 1 and {m.license for m in r.matches} == {"MIT"} and time.time() - began < 60
    spans = sorted((m.start, m.end) for m in r.matches if m.unit == "window")
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def word(rng):
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9)))


@pytest.mark.parametrize("words", [12, 20, 60])
def test_letters_changed_all_over_a_line(spark, words):
    """One letter changed in every k-th word leaves an edit similarity of 0.92 and more: such lines are one group."""
    rng = random.Random(words)
    pairs = []
    for k in (2, 3, 4, 5, 6, 8):
        for _ in range(40):
            a = [word(rng) for _ in range(words)]
            b = list(a)
            for i in range(0, words, k):
                at = rng.randrange(len(b[i]))
                b[i] = b[i][:at] + ("#" if b[i][at] != "#" else "x") + b[i][at + 1 :]
            pairs.append((k, " ".join(a), " ".join(b)))
    docs = spark.createDataFrame([(2 * i + j, t) for i, (_, a, b) in enumerate(pairs) for j, t in enumerate((a, b))], "doc_id long, text string")
    gone = {r.doc_id for r in lines.duplicate_lines(docs).collect()}
    assert gone <= {2 * i + 1 for i in range(len(pairs))}
    for k in (2, 3, 4, 5, 6, 8):
        mine = [i for i, p in enumerate(pairs) if p[0] == k]
        assert sum(2 * i + 1 in gone for i in mine) >= 0.9 * len(mine), k


def test_lines_that_share_an_opening_only(spark, monkeypatch):
    """The pairs that are compared grow with the number of lines, not with its square."""
    compared = []
    met = lines._met

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return met(pairs, *rest)

    monkeypatch.setattr(lines, "_met", counted)
    totals = []
    for n in (500, 2000):
        rng = random.Random(n)
        rows = [(i, "posted by some member on this board " + " ".join(word(rng) for _ in range(14))) for i in range(n)]
        compared.clear()
        assert lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
        totals.append(sum(compared))
    assert totals[1] < 6 * totals[0] and totals[1] < 2000 * 40


def test_links_within_large_buckets_apart_from_their_leaders(spark):
    """Near copies of many lines of the same few words meet in no bucket of their own, nor do its leaders connect them; all pairs of blocks find them."""
    rng = random.Random(21)
    words = [word(rng) for _ in range(8)]
    rows = []
    for i in range(120):
        a = [rng.choice(words) for _ in range(40)]
        b = list(a)
        for k in rng.sample(range(40), 3):
            b[k] = rng.choice(words)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    lost = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.kept_doc_id) for r in lost) == [(2 * i + 1, 2 * i) for i in range(120)]


@pytest.mark.parametrize("block", [5, 1000])
def test_blocks_of_a_bucket_hold_all_its_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(22)
    bits = [sum(1 << b for b in rng.sample(range(62), 12)) for _ in range(60)]
    rows = [(k, 60, i, rng.randrange(40, 90), i % 7, [bits[i] * (i % 9 > 0)] + [0] * 7) for k in (3, 4) for i in range(60)]
    rows = [(k, size, a, n if k == 3 else n + 7, c, b) for k, size, a, n, c, b in rows]
    got = lines._pairs_in_large(spark.createDataFrame(rows, "key long, size long, a long, n int, component long, bits array<long>"), 80).collect()
    near = lambda x, y: 100 * min(x[3], y[3]) >= 80 * max(x[3], y[3]) and (not x[5][0] * y[5][0] or (x[5][0] & y[5][0]).bit_count() >= lines.SHARED * 12)
    want = {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and near(x, y)}
    assert sorted((r.u, r.v) for r in got) == sorted(want) and len(want) > 100


def test_parts_are_encoded_in_joined_strings(monkeypatch):
    """Parts from inside a row share strings (64 calls became one), and have the ids that they have alone; special tokens inside a text too."""
    from tokenizers import Tokenizer

    from inkstone.llm import packing
    from inkstone.llm._bytes import blocks

    rng = random.Random(23)
    encoder, plain = packing.PartEncoder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    special = sorted(set(plain.get_vocab()) - set(plain.get_vocab(with_added_tokens=False)))[:1] or ["<|endoftext|>"]
    pieces = [word(rng) for _ in range(400)] + ["a\nb", "中文", "\U0001f600x", "it's", "x　y", "12,5", *special]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(300))) + rng.choice(["", " ", "\n ", "  "]) for _ in range(30)] + ["", " ", "  a", None]
    strings, batch = [], encoder.tokenizer.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, some, **kw):
            strings.extend(some)
            return batch(some, **kw)

    encoder.tokenizer = Counting()
    got = []
    for b in blocks(pa.array(texts), size=1 << 20):
        ids, first = encoder.encode(b)
        got += [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:], strict=True)]
    assert got == [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(strings) < len(encoder.keys) / 2
