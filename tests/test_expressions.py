"""Column expressions: golden cases, and agreement with the rules stated anew in brute_reflow."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import charsets as cs
from inkstone.functions import convert as cv
from inkstone.functions import lines as ln
from inkstone.functions import text as tx
from inkstone.operators import archive as ar
from inkstone.operators import dialog as dg
from inkstone.operators import pages as pg
from inkstone.plans import batch as bt
from inkstone.sources import files as fs

from . import brute_reflow as br


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *(e(F.col("t")).alias(f"c{k}") for k, e in enumerate(exprs))).orderBy("i").collect()]


GOLDEN = [
    (tx.is_mixed_cjk_ascii, ["第3章 Chapter 1"], ["iPhone 16", "第三章", "第3章!"]),
    (tx.is_mostly_cjk, ["ab汉字", "123汉"], ["abc汉字", "、。", ""]),
    (tx.has_unclosed_bracket, ["（a", "a）", "(a】"], ["（a）", "【《x》】", ""]),
    (tx.has_unclosed_quote, ["“a", "a”"], ["“‘a’”"]),
    (ln.is_page_marker, ["=== [Page 1/2] ===", "=== ==="], ["======"]),
    (ln.begins_with_list, ["- x", "(1) x", "（12）", "1. 苹果", "1.苹果", "十一、", "人、车"], ["-x", "1.23", "123、"]),
    (ln.is_metadata, ["书名：假面游戏", "作者 : 东野圭吾", "出版时间　2024-03-12"], ["ISBN 9787573506078", "作者：「某人」", "作者："]),
    (ln.is_title_heading, ["第三章", "番外：夏天", "卷一 起源", "前言，说明"], ["第三章的故事", "这是第十回合"]),
    (ln.is_heading_like, ["物品准备：", "12", "Chapter One", "（附录）", "【简介】", "これはテスト"], ["他笑了。", "你好，世界"]),
    (ln.is_divider, ["───", "***", "=-=", "★☆★"], ["--", "———"]),
    (ln.ends_sentence, ["他走了。", "他说：", "等等……", "“走吧。”", "(好.)"], ["He said:", "完"]),
    (ln.ends_with_bracket, ["（完）"], ["(test)", "【甲】乙】"]),
    (ar.is_safe_name, ["a..b", "word/document.xml"], ["/a", "a\\b", "../a", "a/../b", ""]),
]


@pytest.mark.parametrize("expr,true,false", GOLDEN, ids=[g[0].__name__ for g in GOLDEN])
def test_golden(spark, expr, true, false):
    assert values(spark, true + false, expr) == [(True,)] * len(true) + [(False,)] * len(false)


def test_null_stays_null(spark):
    assert values(spark, [None], tx.strip, tx.is_mostly_cjk, ln.collapse_repeats) == [(None, None, None)]


def test_expressions_agree_with_reflow(spark):
    parts = ["（完）", "第三章", "“走。”", "他说：", "a b", "一）x（", "x x x y", "===", "  　", "(好.)", "番外", "作者：甲", "【a】", "…", "12345678901234567", "abcdabcdabcd"]
    texts = [a + b for a in parts for b in [*parts, ""]]
    got = values(spark, texts, tx.has_unclosed_bracket, tx.has_unclosed_quote, ln.is_heading_like, lambda t: ln.is_title_heading(tx.lstrip(t)), ln.is_metadata, ln.ends_sentence, ln.ends_with_bracket, ln.collapse_repeats)
    want = [(br.bracket_issue(t), br.quote_issue(t), br.heading(t), br.title(t.lstrip(" \t\r\n　")), br.metadata(t), br.sentence_end(t), br.bracket_end(t), br.collapse(t)) for t in texts]
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_repeats(spark):
    texts = ["abcdabcdabcd", "哈" * 12, "abcdabcd", "abcabcabc", "背负着一切的麒麟 " * 4, "k a a a b b b", "x a a ab", ""]
    assert [r[0] for r in values(spark, texts, ln.collapse_repeats)] == ["abcd", "哈哈哈哈", "abcdabcd", "abcabcabc", "背负着一切的麒麟", "k a b b b", "x a a ab", ""]


def test_repeats_of_long_lines(spark):
    # a pattern with back references would exhaust the stack here
    words = [f"t{i}" for i in range(100_000)]
    texts = [" ".join([*words, "a", "a", "a"]), " ".join(["x y"] * 50_000), " ".join(words + words)]
    got = [r[0] for r in values(spark, texts, ln.collapse_repeats)]
    assert got == [" ".join([*words, "a"]), "x y", texts[2]]


def test_repeats_agree_with_a_search(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [("p q r s t u v w " * 3).strip() + " x", ("1 2 3 4 5 6 7 8 9 " * 4).strip()]

    def collapsed(line):
        w = line.split()
        for start in range(len(w)):
            for n in range(1, 9):
                k = 1
                while w[start + k * n : start + k * n + n] == w[start : start + n] and len(w[start : start + n]) == n:
                    k += 1
                if k >= 3:
                    return " ".join(w[: start + n] + w[start + k * n :])
        return " ".join(w)

    assert [r[0] for r in values(spark, texts, ln.collapse_repeats)] == [collapsed(t) for t in texts]


def test_brackets_nest(spark):
    rng = random.Random(4)
    kinds = "()（）[]【】《》a "
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["（" * 500 + "）" * 500, "(" * 500 + ")" * 499]
    assert [r[0] for r in values(spark, texts, tx.has_unclosed_bracket)] == [br.bracket_issue(t) for t in texts]


def test_dialog_depths(spark, monkeypatch):
    df = spark.createDataFrame([(1, "“a\nb”\n”「\n『"), (2, None), (3, "")], "i int, t string")
    got = {(r.i, r.line_no): list(r.depths) for r in dg.dialog_depths(df, ["i"], "t").collect()}
    assert got == {(1, 0): [1, 0, 0, 0, 0, 0], (1, 1): [0] * 6, (1, 2): [0, 0, 1, 0, 0, 0], (1, 3): [0, 0, 1, 1, 0, 0], (3, 0): [0] * 6}
    monkeypatch.setattr(dg, "RANGE", 3)
    rng = random.Random(6)
    texts = ["".join(rng.choice("“”‘’「」﹁﹂a\n\n") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    found = {(r.i, r.line_no): list(r.depths) for r in dg.dialog_depths(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").collect()}
    want = {}
    for i, t in enumerate(texts):
        depth = [0] * 6
        for no, line in enumerate(t.split("\n")):
            for c in line:
                for k, (x, y) in enumerate(cs.DIALOG_PAIRS):
                    depth[k] = depth[k] + 1 if c == x else max(0, depth[k] - 1) if c == y else depth[k]
            want[i, no] = list(depth)
    assert found == want


def test_dialog_depths_of_many_lines(spark):
    df = spark.createDataFrame([(1, "“a\n" * 50_000 + "b”\n" * 60_000)], "i int, t string")
    assert dg.dialog_depths(df, ["i"], "t").agg(F.count("*"), F.max(F.col("depths")[0]), F.max_by(F.col("depths")[0], "line_no")).first()[:] == (110_001, 50_000, 0)


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, ""), (1, 1, " a \r\nb ")], "doc_id long, page_no int, text string")
    assert pg.assemble_pages(df).first()["text"] == "=== [Page 1/2] ===\n\na \nb\n\n=== [Page 2/2] ===\n\n\n\n"
    three = spark.createDataFrame([(1, i) for i in range(3)], "doc_id long, page_no int")
    assert [(r.percent, r.bar.count("🟩"), len(r.bar)) for r in pg.page_progress(three).orderBy("page_no").collect()] == [(33, 3, 10), (66, 6, 10), (100, 10, 10)]


def test_configs(spark):
    for (d, r, i), want in {("s2t", "std", False): "s2t", ("s2t", "hk", False): "s2hk", ("s2t", "tw", False): "s2tw", ("s2t", "tw", True): "s2twp", ("t2s", "std", False): "t2s", ("t2s", "hk", False): "hk2s", ("t2s", "tw", False): "tw2s", ("t2s", "tw", True): "tw2sp"}.items():
        assert cv.Options(d, r, i).resolve() == want
    assert cv.Options(region="tw").resolve() == "s2twp"
    # asking for idioms selects Taiwan
    assert (cv.Options(idioms=True).resolve(), cv.Options("t2s", "hk", True).resolve()) == ("s2twp", "tw2sp")
    rows = [(d, r, i) for d in ("s2t", "t2s") for r in ("std", "hk", "tw") for i in (True, False, None)]
    df = spark.createDataFrame(rows, "d string, r string, i boolean").select("d", "r", "i", cv.resolve_config(F.col("d"), F.col("r"), F.col("i")).alias("c"))
    assert [x.c for x in df.collect()] == [cv.Options(*x).resolve() for x in rows]
    assert values(spark, ["S2TWP", "nope"], cv.config_id) == [(3,), (1,)]
    assert values(spark, ["“你好”‘a’"], lambda t: cv.convert_punctuation(t, "s2t")) == [("「你好」『a』",)]


def test_staged_dictionary(spark):
    rows = [("s2t", 1, "头", "頭"), ("s2t", 1, "头发", "頭髮"), ("s2t", 1, "发", "發"), ("s2t", 2, "頭髮", "髮"), ("s2t", 1, "", "x"), ("t2s", 1, "头", "x"), ("s2t", 3, "。", "."), ("s2t", 1, "a.b", "")]
    stages = cv.load_dictionary(spark.createDataFrame(rows, "config string, stage int, key string, value string"), "s2t")
    convert = cv.converter(stages, "s2t")
    assert values(spark, ["头发发头。a.bb a", "", None, "“x”", "\uf8ff头\uf8ff"], convert) == [("髮發頭.b a",), ("",), (None,), ("“x”",), ("\uf8ff頭\uf8ff",)]
    assert values(spark, ["“头”"], cv.converter(stages, "s2t", punctuation=True)) == [("「頭」",)]


def test_large_dictionary(spark):
    """A hundred thousand keys that begin, end and overlap like each other, against a walk through the text."""
    rng = random.Random(9)
    chars = [chr(0x4E00 + i) for i in range(3000)] + ["𠀀", "𠀁", "é", ".", "[", "\\"]
    table = {}
    while len(table) < 100_000:
        k = "".join(rng.choice(chars) for _ in range(rng.choice([1, 2, 2, 3, 4, 7])))
        table[k] = k[::-1] + "#"
    keys = list(table)
    texts = ["".join(rng.choice(keys if rng.random() < 0.7 else chars) for _ in range(60)) for _ in range(200)]

    def walk(t):
        out, i = "", 0
        while i < len(t):
            n = next((n for n in range(7, 0, -1) if t[i : i + n] in table and len(t[i : i + n]) == n), 0)
            out += table[t[i : i + n]] if n else t[i]
            i += n or 1
        return out

    rows = spark.createDataFrame([("s2t", 1, k, v) for k, v in table.items()], "config string, stage int, key string, value string")
    convert = cv.converter(cv.load_dictionary(rows, "s2t"), "s2t")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", convert(F.col("t")).alias("c"))
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.c for r in df.collect()] == [walk(t) for t in texts]


def test_icu_tables(spark):
    s, st, t, ts = cv.icu_char_tables(spark)
    assert len(s) == len(st) > 1000 and len(t) == len(ts) > 1000 and dict(zip(s, st, strict=True))["国"] == "國"


def test_pdf_tests(spark):
    df = spark.createDataFrame([(b"\xff%PDF-",)], "c binary").select(fs.is_pdf_content(F.col("c")), fs.is_pdf_start(F.col("c")))
    assert tuple(df.first()) == (True, False)


def test_names(spark):
    assert values(spark, ["/x/a.b.txt", "d", "/y/e.PDF"], fs.base_name, fs.extension) == [("a", "txt"), ("d", ""), ("e", "pdf")]


def test_utf16(spark):
    assert values(spark, ["𠀀a"], tx.utf16_length) == [(3,)]


def test_inline_strings():
    cell = '<c r="A1" t="inlineStr"><is><t>汉</t></is></c>'
    assert ar.convert_inline_strings(cell, lambda s: "X") == cell.replace("汉", "X")
    assert ar.convert_inline_strings('<c r="Z1"/>' + cell, lambda s: "X") == '<c r="Z1"/>' + cell


def test_font_masks(spark):
    xml = 'w:eastAsia="宋体" w:ascii="Arial"'
    df = spark.createDataFrame([(xml,)], "x string").select(ar.mask_fonts(F.col("x"), "docx").alias("m"))
    row = df.select("m.masked", "m.fonts", ar.unmask_fonts(F.col("m.masked"), F.col("m.fonts")).alias("back")).first()
    assert row.masked == 'w:eastAsia="__F_O_N_T_0__" w:ascii="__F_O_N_T_1__"' and row.fonts == ["宋体", "Arial"] and row.back == xml


def test_archives(spark):
    docx = ar.write_entries([{"ord": 0, "name": "word/", "is_dir": True, "data": b""}, {"ord": 1, "name": "word/document.xml", "is_dir": False, "data": 'w:ascii="汉" 汉'.encode()}], "docx")
    files = spark.createDataFrame([(1, "DOCX", docx), (2, "docx", b"no zip"), (3, "xlsx", docx)], "archive_id long, format string, content binary")
    rows = {r.archive_id: r for r in ar.convert_archives(files, lambda s: s.replace("汉", "漢")).collect()}
    assert [rows[i].success for i in (1, 2, 3)] == [True, False, False]
    assert ar.read_entries(rows[1].content)[0]["data"].decode() == 'w:ascii="汉" 漢'
    with pytest.raises(ValueError):
        ar.write_entries([], "epub")


def test_corrupt_entry_is_kept_empty():
    text = bytes(i * 7 % 251 for i in range(4000))
    data = bytearray(ar.write_entries([{"ord": 0, "name": "a.xml", "is_dir": False, "data": text}, {"ord": 1, "name": "b.xml", "is_dir": False, "data": b"fine"}], "docx"))
    at = data.index(b"a.xml") + 40
    data[at : at + 10] = b"\xff" * 10
    assert [(e["name"], e["data"]) for e in ar.read_entries(bytes(data))] == [("a.xml", b""), ("b.xml", b"fine")]


def test_batch(spark, tmp_path):
    docx = ar.write_entries([{"ord": 0, "name": "word/document.xml", "is_dir": False, "data": "汉".encode()}], "docx")
    rows = [(0, "/in/a.txt", "汉\r\n字".encode()), (1, "/in/b.docx", docx), (2, "/in/c.pdf", "一页|二页".encode()), (3, "/in/d.exe", b""), (4, "/in/gone.txt", None), (5, "/in/e", b"\xff")]
    files = spark.createDataFrame(rows, "ord int, path string, content binary")
    done, log = bt.run_batch(files, bt.Job(out_dir=str(tmp_path), page_header=True), lambda c: F.translate(c, "汉", "漢"), lambda s: s.replace("汉", "漢"), lambda b: b.decode().split("|"))
    said = {r.ord: (r.status, r.line) for r in log.collect()}
    assert {k: v[0] for k, v in said.items()} == {0: "done", 1: "done", 2: "done", 3: "unsupported", 4: "not_found", 5: "done_no_ext"}
    assert said[0][1] == f"1: {tmp_path}/a_s2t.txt -> ✅ Done."
    assert {r.status for r in fs.write_files(done).collect()} == {"done"}
    assert (tmp_path / "a_s2t.txt").read_text() == "漢\n字"
    assert (tmp_path / "c_s2t.txt").read_text().startswith("=== [Page 1/2] ===\n\n一页")


def test_list_order(spark):
    now = spark.createDataFrame([(0, "a.txt"), (1, "b.pdf")], "pos int, path string")
    new = spark.createDataFrame([(0, "c.pdf", True), (1, "d.txt", False), (2, "a.txt", False)], "ord int, path string, is_pdf boolean")
    assert [r.path for r in bt.ordered_list(now, new).orderBy("pos").collect()] == ["a.txt", "c.pdf", "b.pdf", "d.txt"]


def test_streaming(spark, tmp_path):
    from inkstone.streaming.ingest import stream_text

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("汉")
    (tmp_path / "in" / "b.exe").write_text("x")
    stream_text(spark, str(tmp_path / "in"), lambda c: F.translate(c, "汉", "漢"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["漢"]


def test_long_lists_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(bt, "_RANGE", 7)
    now = spark.createDataFrame([(i, f"{i}.txt") for i in range(50)], "pos int, path string")
    new = spark.createDataFrame([(i, f"{i}.txt") for i in range(30, 90)], "ord int, path string")
    got = bt.append_list(now, new)
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(i, f"{i}.txt") for i in range(90)]
    assert [r.path for r in bt.remove_from_list(got, new).orderBy("pos").collect()] == [f"{i}.txt" for i in range(30)]


def test_list_edits_and_selection(spark):
    now = spark.createDataFrame([(0, "a.txt"), (1, "b.pdf")], "pos int, path string")
    new = spark.createDataFrame([(0, "c.pdf"), (1, "a.txt"), (2, "d")], "ord int, path string")
    assert [r.path for r in bt.append_list(now, new).orderBy("pos").collect()] == ["a.txt", "b.pdf", "c.pdf", "d"]
    assert [tuple(r) for r in bt.remove_from_list(now, new).collect()] == [(0, "b.pdf")]
    assert values(spark, ["汉汉汉", " "], lambda t: bt.convert_selection(t, 1, 1, lambda c: F.translate(c, "汉", "漢"))) == [("汉漢汉",), (" ",)]
    assert values(spark, ["汉汉"], lambda t: bt.convert_selection(t, 0, None, lambda c: F.translate(c, "汉", "漢"))) == [("漢漢",)]
    files = spark.createDataFrame([("a.exe", b"x")], "path string, content binary")
    assert bt.preview(files).first()["text"] == "Not a valid text file."
    assert fs.decode_utf16le("汉\0".encode("utf-16-le")) == "汉" and fs.decode_utf16le(b"\x00\xd8a\x00") == "\ufffda"


def test_lines_are_converted_together(spark):
    stages = cv.Stages([{"ab": "X", "abc": "Y", "c": "ZZ", "\uf8fd": "mark"}, {"X": "x", "Y": "y"}])
    lines = ["abcab", "", None, "ab", "c\ncab", "a", "b", "\uf8fc", "\uf8fd\uf8ff", "“c”"]
    rows = [(k, x) for k, x in enumerate([lines, lines[:7], [], None, [None], [""], ["a", "b"], ["\uf8fcab", "c"]])]
    df = spark.createDataFrame(rows, "k int, x array<string>")
    one, all_ = cv.converter(stages, "s2t", True), cv.lines_converter(stages, "s2t", True)
    got = {r.k: (r.together, r.alone) for r in df.select("k", all_(F.col("x")).alias("together"), F.transform("x", one).alias("alone")).collect()}
    assert got[1] == (["yx", "", None, "x", "ZZ\nZZx", "a", "b"],) * 2
    assert all(a == b for a, b in got.values()) and got[3] == (None, None) and len(got) == len(rows)


def test_brackets_of_random_strings(spark):
    rng = random.Random(8)
    pairs = [("（", "）"), ("(", ")"), ("【", "】")]
    texts = ["", None, "字", "（" * 30 + "字" + "）" * 30, "（" * 30 + "字" + "）" * 29, "(（)）", "（)", ")(", "【（字）】(a)", "a⟨b⟩{c"]
    for _ in range(600):
        texts.append("".join(rng.choice([*rng.choice(pairs), "字", "a", " "]) for _ in range(rng.randint(1, 9))))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", tx.has_unclosed_bracket(F.col("x")).alias("y")).collect()
    got = {r.k: r.y for r in rows}
    assert got == {k: None if t is None else br.bracket_issue(t) for k, t in enumerate(texts)} and set(got.values()) == {True, False, None}
