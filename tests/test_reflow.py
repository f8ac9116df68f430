import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import charsets as cs
from inkstone.functions import lines as ln
from inkstone.functions import text as tx
from inkstone.operators import pages as pg
from inkstone.operators import reflow as rf

from . import brute_reflow

CASES = [
    ("第一章 开始\n今天天气很好，\n我们出去走走。", False, ["第一章 开始", "今天天气很好，我们出去走走。"]),
    ("他慢慢走进房间看了又看\n\n然后坐下。", False, ["他慢慢走进房间看了又看然后坐下。"]),
    ("他慢慢走进房间看了又看\n\n然后坐下。", True, ["他慢慢走进房间看了又看", "然后坐下。"]),
    ("他走进房间看了看\n\n然后坐下。", False, ["他走进房间看了看", "然后坐下。"]),
    ("她说：\n“我明天\n还会来。”", False, ["她说：", "“我明天还会来。”"]),
    ("“你好！”\n“再见。”", False, ["“你好！”", "“再见。”"]),
    ("1、苹果\n2、香蕉。", False, ["1、苹果", "2、香蕉。"]),
    ("=" * 12, False, ["===="]),
    ("=" * 13, False, ["=" * 13]),
    ("=== [Page 1/2] ===\n第一行文字没有结束的标点符号\n=== [Page 2/2] ===\n继续。", True, ["=== [Page 1/2] ===", "第一行文字没有结束的标点符号", "=== [Page 2/2] ===", "继续。"]),
]


ALPHABET = "汉人一（）(【】“”「」『』﹁﹂，。！：…、.a1 　\t\n-=*第章"
WORDS = [
    "汉字", "他说", "abc", "Chapter 1", "（", "）", "【完】", "(a)", "“", "”", "「走。」", "『", "』", "﹁", "。", "！", "，", "：", "…", "...", ".", "、", " ", "　", "\t", "\n", "\n", "\n\n",
    "- ", "1、", "（二）", "12) ", "三. ", "第三章", "番外", "前言", "卷一", "作者：", "书名　", "=== [Page 1/2] ===", "=====", "─── ", "x x x ", "哈哈哈哈" * 3, "长" * 130, "\r\n", "1",
]


def found(spark, texts, header):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return {r.i: None if r.s is None else [(x.kind, x.text) for x in r.s] for r in df.select("i", rf.segments(F.col("t"), header).alias("s")).collect()}


@pytest.mark.parametrize("header", [False, True])
def test_golden(spark, header):
    mine = [(t, want) for t, h, want in CASES if h is header]
    got = found(spark, [t for t, _ in mine], header)
    assert [[s for _, s in got[i]] for i in range(len(mine))] == [want for _, want in mine]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(mine)], "i int, t string")
    for compact, glue in ((False, "\n\n"), (True, "\n")):
        texts = {r.i: r.t for r in df.select("i", rf.reflow(F.col("t"), header, compact).alias("t")).collect()}
        assert [texts[i] for i in range(len(mine))] == [glue.join(want) for _, want in mine]


def test_blank_and_null(spark):
    df = spark.createDataFrame([(1, " \t\r\n "), (2, None), (3, ""), (4, "　")], "i int, t string")
    assert {r.i: r.t for r in df.select("i", rf.reflow(F.col("t")).alias("t")).collect()} == {1: " \t\r\n ", 2: None, 3: "", 4: ""}
    assert rf.reflow_segments(df, ["i"], "t").count() == 0


def texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        if rng.random() < 0.6:
            yield "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
        else:
            yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80)))


@pytest.mark.parametrize("header", [False, True])
def test_segments_against_the_rules(spark, header):
    some = [*texts(7, 2500), "　=== a ===\nb", "“" * 300 + "\n汉字", "a\x0b\n\x85\n汉", *("汉字" * n + "\n" for n in range(70))]
    # more lines than are folded together
    some += ["\n".join(texts(k, 60)) for k in range(4)]
    got = found(spark, some, header)
    for i, t in enumerate(some):
        if t.strip(" \t\r\n"):
            assert [s for _, s in got[i]] == brute_reflow.segments(t, header), t


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "汉字\n汉字")], "doc_id int, text string")
    plan = rf.reflow_segments(df, ["doc_id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_long_texts_take_linear_time(spark):
    df = spark.createDataFrame([(1, "今天天气很好我们出去走走，\n" * 50_000 + "完。")], "doc_id int, text string")
    segs = rf.reflow_segments(df, ["doc_id"], "text")
    assert segs.agg(F.count("*"), F.sum(F.length("text"))).first()[:] == (1, 50_000 * 13 + 2)


def test_document_text(spark):
    pages = spark.createDataFrame([(1, 2, "继续。"), (1, 1, "第一行文字没有结束的标点符号"), (2, 1, " ")], "doc_id int, page_no int, text string")
    got = {r.doc_id: (r.text, r.status) for r in pg.extract_documents(pages, header=True).collect()}
    assert got[1] == ("=== [Page 1/2] ===\n\n第一行文字没有结束的标点符号\n\n=== [Page 2/2] ===\n\n继续。", "done")
    assert pg.extract_documents(pages, header=False).where("doc_id = 2").first().status == "empty"


LINES = {
    ln.is_heading_like: [("物品准备：", True), ("12", True), ("Chapter One", True), ("（附录）", True), ("【简介】", True), ("これはテスト", True), ("他笑了。", False), ("你好，世界", False)],
    ln.is_title_heading: [("第三章", True), ("番外：夏天", True), ("卷一 起源", True), ("前言，说明", True), ("第三章的故事", False), ("这是第十回合", False)],
    ln.is_metadata: [("书名：假面游戏", True), ("作者 : 东野圭吾", True), ("出版时间　2024-03-12", True), ("ISBN 9787573506078", False), ("作者：「某人」", False), ("作者：", False)],
    ln.ends_sentence: [("他走了。", True), ("他说：", True), ("等等……", True), ("“走吧。”", True), ("(好.)", True), ("He said:", False), ("完", False)],
    tx.has_unclosed_bracket: [("（a", True), ("a）", True), ("(a】", True), ("（a）", False), ("【《x》】", False), ("", False)],
}


@pytest.mark.parametrize("test", LINES, ids=lambda f: f.__name__)
def test_lines(spark, test):
    rows = spark.createDataFrame(LINES[test], "line string, want boolean")
    assert rows.where(test(F.col("line")) != F.col("want")).collect() == []


def test_collapse(spark):
    cases = {
        "abcdabcdabcd": "abcd", "哈" * 12: "哈" * 4, "abcdabcd": "abcdabcd", "背负着一切的麒麟 " * 4: "背负着一切的麒麟", "k a a a b b b": "k a b b b", " a  b": "a b", "\t": "\t", "": "",
        "x abcdabcdabcd": "x abcd", "a b a b a b": "a b", "a b\ta b": "a b a b", "x y z ": "x y z",
    }
    rows = spark.createDataFrame(list(cases.items()), "line string, want string")
    assert rows.where(ln.collapse_repeats(F.col("line")) != F.col("want")).collect() == []
    rng = random.Random(3)
    lines = [" ".join(rng.choice("ab汉") * rng.randint(0, 3) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", ln.collapse_repeats(F.col("line")).alias("c")).collect()
    assert [(r.line, r.c) for r in got if r.c != brute_reflow.collapse(r.line)] == []


def test_brackets_against_deletion(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("（）()【】汉a") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", tx.has_unclosed_bracket(F.col("line")).alias("open")).collect():
        only = "".join(c for c in r.line if c in "（）()【】")
        for _ in range(20):
            only = only.replace("（）", "").replace("()", "").replace("【】", "")
        assert r.open == (only != "") and cs.BRACKETS
