"""Registered queries of the document operators, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import convert as cv
from ..functions import lines as ln
from ..functions import text as tx
from ..operators import archive as ar
from ..operators import dialog as dg
from ..operators import pages as pg
from ..operators import reflow as rf
from ..sources import archives as sa
from ..sources import files as fs
from ..sources import sink
from . import batch as bt

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# A CJK text derived from the documents: letters to ideographs and punctuation, rare ones to brackets and quotes.
_FROM = "abcdefghijklmnopqrstuvwxyz.,"
_TO = "一人十国书汉简体软）：发面后里台（香港日本！字「换」。，"
#: Ideographs to brackets of several kinds, for lines that are to be full of them.
_B_FROM, _B_TO = "十国书汉简体软发", "（）【】(]“”"
_WIDTH = 20


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table. One of fewer files than cores is dealt out to all of them first; larger ones are read where they are, without a shuffle."""
    df, cores = spark.read.parquet(f"{sf}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def cjk_lines(spark: SparkSession, sf: str, brackets: bool = False) -> DataFrame:
    """(doc_id, line_no, part_no, line): the derived text in slices of 20 characters."""
    t = F.translate(F.lower("text"), _FROM, _TO)
    t = F.translate(t, _B_FROM, _B_TO) if brackets else t
    rows = _read(spark, sf, "documents").select("doc_id", F.posexplode(tx.split_lines(t)).alias("line_no", "full"))
    last = F.greatest(F.floor((F.length("full") - 1) / _WIDTH), F.lit(0)).cast("int")
    rows = rows.select("doc_id", "line_no", "full", F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    return rows.select("doc_id", "line_no", "part_no", F.substring("full", F.col("part_no") * _WIDTH + 1, F.lit(_WIDTH)).alias("line"))


def _sql_lines(brackets: bool = False) -> str:
    t = f"translate(lower(text), '{_FROM}', '{_TO}')"
    t = f"translate({t}, '{_B_FROM}', '{_B_TO}')" if brackets else t
    return f"""WITH split AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS whole FROM (SELECT doc_id, string_split({t}, chr(10)) AS p FROM documents)),
parts AS (SELECT doc_id, line_no, whole, unnest(range(greatest(1, (length(whole) + {_WIDTH - 1}) // {_WIDTH}))) AS part_no FROM split),
l AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(part_no AS INTEGER) AS part_no, substr(whole, part_no * {_WIDTH} + 1, {_WIDTH}) AS line FROM parts)
"""


_ID = ["doc_id", "line_no", "part_no"]
_SID = "doc_id, line_no, part_no"


def _register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# --- the same predicates in DuckDB's words ---------------------------------------------------------------------------


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _last(x: str) -> str:
    return f"right(rtrim({x}, '{cs.WS_CHARS}'), 1)"


def _head(x: str) -> str:
    return f"left(rtrim({x}, '{cs.WS_CHARS}'), greatest(length(rtrim({x}, '{cs.WS_CHARS}')) - 1, 0))"


def _in(x: str, chars: str) -> str:
    return f"({x} <> '' AND contains('{chars}', {x}))"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _mostly(x: str) -> str:
    return f"({_count(x, f'[{cs.CJK}]')} > 0 AND {_count(x, f'[{cs.CJK}]')} >= {_count(x, '[A-Za-z]')})"


def _deleted(x: str, pairs, times: int = 10) -> str:
    """What is left after adjacent pairs are deleted again and again."""
    chars = cs.escaped("".join(a + b for a, b in pairs))
    out = f"regexp_replace({x}, '[^{chars}]', '', 'g')"
    pattern = "|".join("".join("\\" + c if c in "()[]{}" else c for c in a + b) for a, b in pairs)
    for _ in range(times):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return out


def _brackets_open(x: str) -> str:
    return f"({_deleted(x, cs.BRACKETS)} <> '')"


def _quotes_open(x: str) -> str:
    return "(" + " OR ".join(f"{_deleted(x, [q])} <> ''" for q in cs.QUOTES) + ")"


def _closer(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{a}' THEN '{b}'" for a, b in cs.BRACKETS) + " ELSE '' END"


def _strip(x: str) -> str:
    return f"trim({x}, '{cs.STRIP_CHARS}')"


def _keys(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ELLIPSIS = rf"(?:…|\.\.\.)[{cs.WS}]*\z"


# --- pages -----------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")


_PAGES_SQL = f"p AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, trim(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '{cs.ASCII_WS_CHARS}') AS t, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
for _name, _head_on in (("page_assembly", True), ("page_assembly_no_header", False)):
    _entry = "'=== [Page ' || i || '/' || n || '] ===' || chr(10) || chr(10) || " if _head_on else ""
    _register(
        _name,
        lambda spark, sf, on=_head_on: pg.assemble_pages(_pages(spark, sf), header=on),
        f"WITH {_PAGES_SQL} SELECT doc_id, CAST(max(n) AS INTEGER) AS n_pages, string_agg({_entry}t || chr(10) || chr(10), '' ORDER BY i) AS text FROM p GROUP BY doc_id",
    )
_register(
    "page_progress",
    lambda spark, sf: pg.page_progress(_pages(spark, sf)),
    f"WITH {_PAGES_SQL}, q AS (SELECT doc_id, page_no, CAST(floor(CAST(i AS DOUBLE) / n * 100) AS INTEGER) AS percent FROM p) SELECT *, repeat('🟩', percent * 10 // 100) || repeat('⬜', 10 - percent * 10 // 100) AS bar FROM q",
)

# --- trims and single characters -------------------------------------------------------------------------------------


def _line_split_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    rows = _read(spark, sf, "documents").select("doc_id", F.posexplode(tx.split_lines(tx.normalize_newlines(F.col("text")))).alias("line_no", "x")).select("doc_id", "line_no", F.concat(F.lit("　 "), "x", F.lit("\t  ")).alias("t"))
    return rows.select("doc_id", "line_no", tx.rstrip(t).alias("r"), tx.lstrip(t).alias("l"), tx.strip(t).alias("b"), tx.trim_ascii(t).alias("ascii"), tx.trim_ws(t).alias("ws"), F.length(tx.trim_ws(t)).alias("n"))


_register(
    "line_split_strip",
    _line_split_strip,
    f"""WITH s AS (SELECT doc_id, unnest(range(len(p))) AS line_no, '　 ' || unnest(p) || '\t  ' AS t FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS p FROM documents))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rtrim(t, '{cs.STRIP_CHARS}') AS r, ltrim(t, '{cs.STRIP_CHARS}') AS l, trim(t, '{cs.STRIP_CHARS}') AS b, trim(t, '{cs.ASCII_WS_CHARS}') AS ascii, trim(t, '{cs.WS_CHARS}') AS ws, CAST(length(trim(t, '{cs.WS_CHARS}')) AS INTEGER) AS n FROM s""",
)


def _last_prev(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("line")
    return cjk_lines(spark, sf).select(*_ID, tx.first_char(c).alias("first"), tx.last_char(c).alias("last"), tx.last_index(c).alias("last_index"), tx.last_char(tx.before_last(c)).alias("prev"), tx.previous_char(c, F.lit(5)).alias("before_fifth"))


_register(
    "last_prev_char",
    _last_prev,
    _sql_lines() + f"SELECT {_SID}, left(ltrim(line, '{cs.WS_CHARS}'), 1) AS first, {_last('line')} AS last, CAST(length(rtrim(line, '{cs.WS_CHARS}')) - 1 AS INTEGER) AS last_index, {_last(_head('line'))} AS prev, {_last('left(line, 5)')} AS before_fifth FROM l",
)
def _counted(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.lit("𠀀a"), F.translate("lang", "ef", "𠀀😀"))
    return _read(spark, sf, "documents").select("doc_id", tx.utf16_length(t).cast("long").alias("units"), cv.char_count_label(t).alias("label"))


_register(
    "char_count_utf16",
    _counted,
    r"SELECT doc_id, units, format('{:,}', units) AS label FROM (SELECT doc_id, CAST(length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS units FROM (SELECT doc_id, text || '𠀀a' || translate(lang, 'ef', '𠀀😀') AS t FROM documents))",
)
_register(
    "utf8_prefix",
    lambda spark, sf: cjk_lines(spark, sf).select(*_ID, tx.utf8_prefix(F.col("line"), 10).alias("prefix")),
    _sql_lines() + f"SELECT {_SID}, CASE " + " ".join(f"WHEN octet_length(encode(left(line, {k}))) <= 10 THEN left(line, {k})" for k in range(10, 0, -1)) + " ELSE '' END AS prefix FROM l",
)

# --- character classes -----------------------------------------------------------------------------------------------


def _line() -> Column:
    return F.col("line")


def _mixed() -> Column:
    return F.concat(F.left("line", F.lit(4)), F.col("part_no").cast("string"), F.lit(" -a"))


def _classes() -> list[tuple[str, Callable[[], Column], str]]:
    smixed = "(left(line, 4) || part_no || ' -a')"
    return [
        ("any_cjk", lambda: tx.contains_cjk(_line()), _m("line", f"[{cs.CJK}]")),
        ("non_ascii", lambda: tx.contains_non_ascii(_line()), _m("line", r"[^\x00-\x7F]")),
        ("all_ascii", lambda: tx.is_all_ascii(_line()), _m("line", r"^[\x00-\x7F]*\z")),
        ("latin", lambda: tx.has_latin(_line()), _m("line", "[A-Za-z]")),
        ("mixed", lambda: tx.is_mixed_cjk_ascii(_mixed()), f"({_m(smixed, rf'^[ \-/:.A-Za-z0-9\x{{FF10}}-\x{{FF19}}{cs.CJK}]*\z')} AND {_m(smixed, f'[{cs.CJK}]')} AND {_m(smixed, r'[A-Za-z0-9\x{FF10}-\x{FF19}]')})"),
        ("mostly", lambda: tx.is_mostly_cjk(_mixed()), _mostly(smixed)),
        ("all_cjk", lambda: tx.is_all_cjk(_line()), _m("line", rf"^[{cs.CJK}]+\z")),
        ("all_cjk_ws", lambda: tx.is_all_cjk(_line(), True), f"({_m('line', rf'^[{cs.CJK}{cs.WS}]+\z')} AND {_m('line', f'[{cs.CJK}]')})"),
        ("digits", lambda: tx.is_all_digits(F.concat(F.col("part_no").cast("string"), F.when(F.col("line_no") % 2 == 0, F.lit("")).otherwise(F.left(_line(), F.lit(1))))), _m("part_no || CASE WHEN line_no % 2 = 0 THEN '' ELSE left(line, 1) END", r"^[0-9]+\z")),
        ("white", lambda: tx.is_whitespace(F.substring(_line(), 3, 1)), _m("substr(line, 3, 1)", f"^[{cs.WS}]$")),
    ]


def _register_profile(name: str, make, brackets: bool = False) -> None:
    """A query of one column per (name, expression, SQL); expressions are made when the query is, since they need a session."""
    sql = _sql_lines(brackets) + f"SELECT {_SID}, " + ", ".join(f"{x} AS {n}" for n, _, x in make()) + " FROM l"
    _register(name, lambda spark, sf: cjk_lines(spark, sf, brackets).select(*_ID, *(c().alias(n) for n, c, _ in make())), sql)


def _punctuation() -> list[tuple[str, Callable[[], Column], str]]:
    return [
        ("clause_end", lambda: tx.ends_with(_line(), cs.CLAUSE_OR_END), _in(_last("line"), cs.CLAUSE_OR_END)),
        ("dialog_start", lambda: tx.begins_with_dialog(_line()), _m("line", f"^[{cs.WS}]*[{cs.DIALOG_OPENERS}]")),
        ("dialog_end", lambda: tx.ends_with(_line(), cs.DIALOG_CLOSERS), _in(_last("line"), cs.DIALOG_CLOSERS)),
        ("strong_end", lambda: tx.ends_with(_line(), cs.STRONG_ENDS), _in(_last("line"), cs.STRONG_ENDS)),
        ("has_strong", lambda: tx.contains_any(_line(), cs.STRONG_ENDS), _m("line", f"[{cs.STRONG_ENDS}]")),
        ("has_comma", lambda: tx.contains_any(_line(), cs.COMMAS), _m("line", f"[{cs.COMMAS}]")),
        ("colon_end", lambda: tx.ends_with(_line(), cs.COLONS), _in(_last("line"), cs.COLONS)),
        ("postfix_end", lambda: tx.ends_with(_line(), cs.POSTFIX_CLOSERS), _in(_last("line"), cs.POSTFIX_CLOSERS)),
        ("ellipsis", lambda: tx.ends_with_ellipsis(F.concat(_line(), F.lit("... "))), f"({_mostly('line')} AND {_m('line || $$... $$', _ELLIPSIS)})".replace("$$", "'")),
        ("complete", lambda: tx.ends_complete(_line()), f"({_in(_last('line'), cs.STRONG_ENDS + cs.COLONS)} OR {_m('line', rf'(?:…|\.\.)[{cs.WS}]*\z')})"),
    ]


def _brackets() -> list[tuple[str, Callable[[], Column], str]]:
    slisted = "'一）' || line"
    return [
        ("open", lambda: tx.has_unclosed_bracket(_line()), _brackets_open("line")),
        ("wrapped", lambda: tx.is_wrapped(_line()), f"(length(line) >= 3 AND ({_closer('left(line, 1)')}) <> '' AND ({_closer('left(line, 1)')}) = {_last('line')})"),
        ("closer", lambda: tx.matching_closer(F.left(_line(), F.lit(1))), _closer("left(line, 1)")),
        ("list_open", lambda: ln.list_has_unclosed_bracket(F.concat(F.lit("一）"), _line())), _brackets_open(f"regexp_replace({slisted}, '{ln.LIST_CLOSER_PREFIX}', '')")),
        ("quotes", lambda: tx.has_unclosed_quote(_line()), _quotes_open("line")),
        ("bracketed", lambda: ln.ends_with_bracket(_line()), _bracketed_sql("line")),
    ]


def _bracketed_sql(x: str) -> str:
    t, w = f"trim({x}, '{cs.WS_CHARS}')", cs.WS_CHARS
    inner = f"trim(substr({t}, 2, greatest(length({t}) - 2, 0)), '{w}')"
    balanced = "CASE " + " ".join(f"WHEN left({t}, 1) = '{a}' THEN {_deleted(t, [(a, b)])} = ''" for a, b in cs.BRACKETS) + " ELSE true END"
    return f"(length({t}) >= 2 AND ({_closer(f'left({t}, 1)')}) <> '' AND ({_closer(f'left({t}, 1)')}) = right({t}, 1) AND {_mostly(inner)} AND {balanced})"


_register_profile("char_class_profile", _classes)
_register_profile("punct_class_profile", _punctuation)
_register_profile("bracket_balance", _brackets, brackets=True)

# --- line heuristics -------------------------------------------------------------------------------------------------

_STARTS = ("", "- ", "(1) ", "（十二）", "1.", "12、", "3) ", "•", "第三章", "番外", "前言", "卷一", "=== ", "---", "1.5")


def _start(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _STARTS)), F.pmod(i, F.lit(len(_STARTS))).cast("int") + 1)


_SSTART = f"([{_keys(_STARTS)}])[1 + (doc_id + line_no + part_no) % {len(_STARTS)}]"


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    """Derived lines behind the beginnings that heuristics look for, some cut short, some with a page marker's end."""
    s = _start(F.col("doc_id") + F.col("line_no") + F.col("part_no"))
    n = F.pmod(F.col("doc_id") * 7 + F.col("part_no") * 3, F.lit(22)).cast("int")
    tail = F.when(F.pmod(F.col("part_no"), F.lit(5)) == 0, F.lit(" ===")).otherwise(F.lit(""))
    return cjk_lines(spark, sf).select(*_ID, F.concat(s, F.left("line", n), tail).alias("line"))


_SSHAPED = _sql_lines() + f", k AS (SELECT {_SID}, {_SSTART} || left(line, CAST((doc_id * 7 + part_no * 3) % 22 AS INTEGER)) || CASE WHEN part_no % 5 = 0 THEN ' ===' ELSE '' END AS line FROM l)\n"


def _title_sql(x: str) -> str:
    words = " OR ".join(f"starts_with({x}, '{w}')" for w in cs.TITLE_WORDS if w != "番外")
    return f"(length({x}) BETWEEN 1 AND 50 AND NOT {_m(f'substr({x}, 21)', '[,，]')} AND CASE WHEN starts_with({x}, '番外') THEN length({x}) <= 17 ELSE {words} OR {_m(x, ln.CHAPTER)} OR ({_m(x, ln.VOLUME)} AND length({x}) <= 22) END)"


def _heading_sql(x: str) -> str:
    s = _strip(x)
    last, head = _last(s), _head(s)
    mixed = rf"^[ \-/:.A-Za-z0-9\x{{FF10}}-\x{{FF19}}{cs.CJK}]*\z"
    limit = f"CASE WHEN {_m(s, r'^[\x00-\x7F]*\z')} OR ({_m(s, mixed)} AND {_m(s, f'[{cs.CJK}]')} AND {_m(s, r'[A-Za-z0-9\x{FF10}-\x{FF19}]')}) THEN 16 ELSE 8 END"
    inner = _strip(f"substr({s}, 2, greatest(length({s}) - 2, 0))")
    return f"""CASE WHEN {last} = '' OR (length({s}) >= 7 AND starts_with({s}, '=== ') AND ends_with({s}, '===')) THEN false
WHEN {_brackets_open(s)} OR {_quotes_open(s)} THEN false
WHEN {_in(last, cs.COLONS)} AND length({s}) <= {limit} AND {_m(head, rf'^[{cs.CJK}]+\z')} THEN true
WHEN {_in(last, cs.POSTFIX_CLOSERS)} AND NOT {_m(head, f'[{cs.COMMAS}]')} THEN true
WHEN length({s}) >= 3 AND ({_closer(f'left({s}, 1)')}) <> '' AND ({_closer(f'left({s}, 1)')}) = {last} AND {_mostly(inner)} THEN true
WHEN {_in(last, cs.CLAUSE_OR_END)} OR {_m(s, f'[{cs.COMMAS + cs.STRONG_ENDS}]')} OR length({s}) > {limit} THEN false
ELSE {_m(s, r'^[0-9]+\z')} OR {_m(s, r'[^\x00-\x7F]')} OR {_m(s, '[A-Za-z]')} END"""


def _markers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("line")
    return _shaped(spark, sf).select(*_ID, ln.is_page_marker(c).alias("marker"), ln.is_divider(F.concat(F.left(c, F.lit(3)), F.lit(" ═★"))).alias("divider"), ln.begins_with_list(c).alias("item"), ln.is_indented(F.concat(F.lit(" "), c)).alias("indented"), ln.is_chapter_ending(F.concat(F.left(c, F.lit(12)), F.lit("章】"))).alias("chapter_end"))


_register(
    "line_markers",
    _markers,
    _SSHAPED
    + f"""SELECT {_SID}, length(line) >= 7 AND starts_with(line, '=== ') AND ends_with(line, '===') AS marker,
{_m("regexp_replace(left(line, 3) || ' ═★', '[ \\t\\n\\r\\x{3000}]', '', 'g')", rf'^[{cs.DIVIDER}]{{3,}}\z')} AS divider, {_m(f"ltrim(line, '{cs.STRIP_CHARS}')", ln.LIST_START)} AS item,
{_m("' ' || line", r'^[ \t\x{3000}]{2}')} AS indented, length(left(line, 12) || '章】') <= 15 AND {_m("left(line, 12) || '章】'", rf'[{cs.CHAPTER_MARKERS}][{cs.escaped(cs.CHAPTER_END_BRACKETS)}]*\z')} AS chapter_end FROM k""",
)
_register("title_headings", lambda spark, sf: _shaped(spark, sf).select(*_ID, ln.is_title_heading(F.col("line")).alias("title")), _SSHAPED + f"SELECT {_SID}, {_title_sql('line')} AS title FROM k")
_register("short_headings", lambda spark, sf: _shaped(spark, sf).select(*_ID, ln.is_heading_like(F.col("line")).alias("heading")), _SSHAPED + f"SELECT {_SID}, {_heading_sql('line')} AS heading FROM k")

_META_KEYS = ("书名", "作者", "作家", "OCR", "出版日期", "前言 ")
_META_SEPARATORS = ("：", ":", "　", " ", " : ", "：「")


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    key = F.element_at(F.array(*map(F.lit, _META_KEYS)), F.pmod(F.col("doc_id"), F.lit(len(_META_KEYS))).cast("int") + 1)
    sep = F.element_at(F.array(*map(F.lit, _META_SEPARATORS)), F.pmod(F.col("line_no") + F.col("part_no"), F.lit(len(_META_SEPARATORS))).cast("int") + 1)
    line = F.concat(key, sep, F.left("line", F.pmod(F.col("part_no") * 5, F.lit(26)).cast("int")))
    return cjk_lines(spark, sf).select(*_ID, ln.is_metadata(line).alias("metadata"))


_s = _strip("line")
_register(
    "metadata_lines",
    _meta,
    _sql_lines()
    + f""", k AS (SELECT {_SID}, ([{_keys(_META_KEYS)}])[1 + doc_id % {len(_META_KEYS)}] || ([{_keys(_META_SEPARATORS)}])[1 + (line_no + part_no) % {len(_META_SEPARATORS)}] || left(line, (part_no * 5) % 26) AS line FROM l)
SELECT {_SID}, length({_s}) <= 30 AND {_strip(f"regexp_extract({_s}, '{ln.METADATA}', 1)")} IN ({_keys(cs.METADATA_KEYS)}) AND regexp_extract({_s}, '{ln.METADATA}', 2) <> '' AND left(regexp_extract({_s}, '{ln.METADATA}', 2), 1) NOT IN ({_keys(cs.DIALOG_OPENERS)}) AS metadata FROM k""",
)


def _boundary_sql(x: str, level: int) -> str:
    last, head = _last(x), _head(x)
    prev = _last(head)
    out = _in(last, cs.STRONG_ENDS)
    if level >= 3:
        out += f" OR ({last} IN ('.', ':') AND {_m(f'right({head}, 1)', f'[{cs.CJK}]')} AND {_mostly(x)})"
    out += f" OR ({_in(last, cs.DIALOG_CLOSERS + cs.POSTFIX_CLOSERS)} AND ({_in(prev, cs.STRONG_ENDS)} OR ({prev} = '.' AND {_m(_last(_head(head)), f'[{cs.CJK}]')} AND {_mostly(x)})))"
    if level < 3:
        out += f" OR ({last} = '：' AND {_mostly(x)}) OR ({_mostly(x)} AND {_m(x, _ELLIPSIS)})"
    if level < 2:
        out += f" OR {last} IN ('；', '：', ';', ':')"
    return f"({out})"


_ENDS = ("", "。", ".”", "：", "；", "…", "... ", "！）", ":", ".）", "」")


def _boundaries(spark: SparkSession, sf: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _ENDS)), F.pmod(F.col("doc_id") + F.col("part_no"), F.lit(len(_ENDS))).cast("int") + 1)
    rows = cjk_lines(spark, sf).select(*_ID, F.concat("line", end).alias("line"))
    return rows.select(*_ID, *(ln.ends_sentence(F.col("line"), k).alias(f"level{k}") for k in (1, 2, 3)), ln.at_end_allowing_closers(F.col("line"), F.length("line") - 3).alias("closers"))


_register(
    "sentence_boundary",
    _boundaries,
    _sql_lines()
    + f", k AS (SELECT {_SID}, line || ([{_keys(_ENDS)}])[1 + (doc_id + part_no) % {len(_ENDS)}] AS line FROM l) SELECT {_SID}, "
    + ", ".join(f"{_boundary_sql('line', k)} AS level{k}" for k in (1, 2, 3))
    + f", {_m('substr(line, greatest(length(line) - 1, 0 - length(line)))', '^[' + cs.WS + cs.escaped(cs.DIALOG_CLOSERS + ''.join(b for _, b in cs.BRACKETS)) + ']*' + chr(92) + 'z')} AS closers FROM k",
)
_unit = "CASE " + " ".join(f"WHEN length(t) % {u} = 0 AND length(t) // {u} >= 3 AND length(t) <= 200 AND repeat(left(t, {u}), length(t) // {u}) = t THEN left(t, {u})" for u in range(4, 11)) + " ELSE t END"
_register(
    "collapse_tokens",
    lambda spark, sf: cjk_lines(spark, sf).select(*_ID, ln.collapse_token(F.repeat(F.left("line", F.pmod(F.col("doc_id"), F.lit(12)).cast("int")), F.pmod(F.col("part_no"), F.lit(5)).cast("int"))).alias("token")),
    _sql_lines() + f", k AS (SELECT {_SID}, repeat(left(line, CAST(doc_id % 12 AS INTEGER)), part_no % 5) AS t FROM l) SELECT {_SID}, {_unit} AS token FROM k",
)
def _depths(spark: SparkSession, sf: str) -> DataFrame:
    rows = dg.dialog_depths(_read(spark, sf, "documents").select("doc_id", F.translate(F.lower("text"), _FROM, _TO).alias("text")), ["doc_id"], "text")
    return rows.select("doc_id", "line_no", *(F.col("depths")[k].alias(f"d{k}") for k in range(len(cs.DIALOG_PAIRS))))


def _depths_sql() -> str:
    """A counter that stops at zero is a running sum less its running minimum below zero."""
    pairs = list(enumerate(cs.DIALOG_PAIRS))
    kept = ", ".join(f"'{c}'" for _, q in pairs for c in q)
    sums = ", ".join(f"sum(CASE c WHEN '{a}' THEN 1 WHEN '{b}' THEN -1 ELSE 0 END) OVER o AS s{k}" for k, (a, b) in pairs)
    least = ", ".join(f"min(s{k}) OVER o AS m{k}" for k, _ in pairs)
    depth = ", ".join(f"CAST(s{k} - least(0, m{k}) AS INTEGER) AS d{k}" for k, _ in pairs)
    return f"""WITH t AS (SELECT doc_id, string_split(translate(lower(text), '{_FROM}', '{_TO}') || chr(10), '') AS a FROM documents),
e AS (SELECT * FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS c FROM t) WHERE c IN (chr(10), {kept})),
s AS (SELECT *, {sums} FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, {least} FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line_no, {depth} FROM m WHERE c = chr(10)"""


_register("dialog_depths", _depths, _depths_sql())

# --- reflow ----------------------------------------------------------------------------------------------------------


def _hard_broken(spark: SparkSession, sf: str) -> DataFrame:
    t = F.translate(F.lower("text"), _FROM, _TO)
    broken = F.array_join(F.transform(tx.split_lines(t), lambda x: F.regexp_replace(x, "(.{30})", "$1\n")), "\n")
    return _read(spark, sf, "documents").select("doc_id", broken.alias("text"))


def _collapsed_sql(tokens: str) -> str:
    """A line made of the tokens of a list column, its first phrase that comes three times and then repeated units collapsed. Slices are compared, not counted."""
    first = "least(" + ", ".join(f"16 * list_filter(range(1, len({tokens}) - {3 * n} + 2), lambda i: {tokens}[i:i + {2 * n - 1}] = {tokens}[i + {n}:i + {3 * n - 1}])[1] + {n}" for n in range(1, 9)) + ")"
    return f"""SELECT *, list_filter(range(place, len({tokens}) + 1), lambda j: ({tokens}[j] IS DISTINCT FROM {tokens}[j + n]))[1] - place AS run FROM (SELECT *, code // 16 AS place, code % 16 AS n FROM (SELECT *, {first} AS code FROM w))"""


_SQL_LINES_COLLAPSED = f""", w AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda x: x <> '') AS ws FROM src),
ph AS ({_collapsed_sql("ws")}),
c AS (SELECT * EXCLUDE (line, ws, code, place, n, run), CASE WHEN len(ws) = 0 THEN line ELSE array_to_string(list_transform(CASE WHEN place IS NULL THEN ws ELSE ws[1:place + n - 1] || ws[place + n * (run // n + 1):] END, lambda t: {_unit}), ' ') END AS line FROM ph)"""


_register(
    "collapse_repeats",
    lambda spark, sf: cjk_lines(spark, sf).select(*_ID, ln.collapse_repeats(F.concat_ws(" ", "line", "line", "line", F.lit("x"))).alias("line")),
    _sql_lines() + f", src AS (SELECT {_SID}, concat_ws(' ', line, line, line, 'x') AS line FROM l){_SQL_LINES_COLLAPSED} SELECT {_SID}, line FROM c",
)


def _cell(x: str, pairs: tuple) -> str:
    """What a line does to a counter of open marks that stops at zero: its sum and what it makes of zero, by deleting pairs that match."""
    rest = _deleted(x, [pairs])
    up = f"length(regexp_replace({rest}, '{pairs[1]}', '', 'g'))"
    return f"[2 * {up} - length({rest}), {up}]"


def _reflow_sql(lines: str, header: bool, table: str = "documents") -> str:
    """CTEs up to seg(doc_id, seg_no, kind, text): the rules as a recursion fin the lines, with the paragraph's text as state. lines: CTE src(doc_id, line_no, line)."""
    ws, strip = cs.WS_CHARS, cs.STRIP_CHARS
    kinds = range(len(cs.DIALOG_PAIRS))
    s = _strip("line")
    meta = f"(length({s}) <= 30 AND {_strip(f"regexp_extract({s}, '{ln.METADATA}', 1)")} IN ({_keys(cs.METADATA_KEYS)}) AND regexp_extract({s}, '{ln.METADATA}', 2) <> '' AND left(regexp_extract({s}, '{ln.METADATA}', 2), 1) NOT IN ({_keys(cs.DIALOG_OPENERS)}))"
    last, first = _last("line"), f"left(ltrim(line, '{ws}'), 1)"
    divider = _m("regexp_replace(lft, '[ \\t\\n\\r\\x{3000}]', '', 'g')", rf"^[{cs.DIVIDER}]{{3,}}\z")
    brackets = _deleted("line", cs.BRACKETS)
    facts = f"""SELECT doc_id, line_no, CASE WHEN {divider} THEN lft ELSE line END AS line,
CASE WHEN line = '' THEN 'blank' WHEN {divider} THEN 'divider' WHEN length(line) >= 7 AND starts_with(line, '=== ') AND ends_with(line, '===') THEN 'marker' WHEN {_title_sql("lft")} THEN 'title' WHEN {meta} THEN 'metadata' ELSE '' END AS kind,
{_heading_sql("line")} AS heading, ({_in(last, cs.COLONS + cs.POSTFIX_CLOSERS)} OR ({_m("line", rf"^[{cs.CJK}{cs.WS}]+\z")} AND {_m("line", f"[{cs.CJK}]")})) AS goes_on,
{_in(first, cs.DIALOG_OPENERS)} AS dialog, {_m("lft", ln.LIST_START)} AS item, {_in(last, cs.DIALOG_CLOSERS)} AS closes,
CASE WHEN {_m("lft", ln.LIST_START)} THEN {_brackets_open(f"regexp_replace(lft, '{ln.LIST_CLOSER_PREFIX}', '')")} ELSE {_brackets_open("line")} END AS broken, {_quotes_open("line")} AS quoted,
({_in(last, cs.STRONG_ENDS + cs.COLONS)} OR ({_mostly("line")} AND {_m("line", _ELLIPSIS)})) AS complete, {last} AS last, {_last(_head("line"))} AS prev, {brackets} AS brk, regexp_replace(line, '[^{cs.escaped("".join(a + b for a, b in cs.BRACKETS))}]', '', 'g') AS brks,
{_count("line", f"[{cs.CJK}]")} AS n_cjk, {_count("line", "[A-Za-z]")} AS n_latin, {", ".join(f"{_cell('line', q)} AS x{k}" for k, q in enumerate(cs.DIALOG_PAIRS))}
FROM (SELECT *, ltrim(line, '{strip}') AS lft FROM c)"""
    end, speaks, is_open = _last("buf"), "(" + " + ".join(f"d{k}" for k in kinds) + " > 0)", "(due <> '')"
    tail, mostly = "right(buf, 40)", "(cjk > 0 AND cjk >= latin)"
    closers = cs.DIALOG_CLOSERS + cs.POSTFIX_CLOSERS
    prev = _last(_head(tail))
    sentence = f"({_in(end, cs.STRONG_ENDS)} OR ({_in(end, closers)} AND ({_in(prev, cs.STRONG_ENDS)} OR ({prev} = '.' AND {_m(_last(_head(_head(tail))), f'[{cs.CJK}]')} AND {mostly}))) OR ({mostly} AND ({end} = '：' OR {_m(tail, _ELLIPSIS)})))"
    begin = f"left(ltrim(buf, '{ws}'), 1)"
    wrapped = f"(({_closer(begin)}) <> '' AND ({_closer(begin)}) = {end} AND pair = '' AND {mostly})"
    soft = "false" if header else f"(buf <> '' AND ({speaks} OR {is_open} OR ({end} <> '' AND NOT {_in(end, cs.STRONG_ENDS)})))"
    act = f"""CASE WHEN kind = 'blank' THEN CASE WHEN {soft} THEN 'skip' ELSE 'break' END WHEN kind <> '' THEN 'alone'
WHEN heading AND (buf = '' OR (NOT {is_open} AND ({end} = '' OR (NOT {_in(end, cs.COMMAS)} AND (NOT goes_on OR {_in(end, cs.CLAUSE_OR_END)}))))) THEN 'alone'
WHEN dialog AND closes AND NOT broken AND NOT quoted THEN 'quiet' WHEN item AND complete AND NOT broken AND NOT quoted THEN 'alone'
WHEN dialog OR item THEN CASE WHEN buf <> '' AND ((item AND {_m(f"ltrim(buf, '{strip}')", ln.LIST_START)}) OR ({end} <> '' AND NOT {_in(end, cs.COMMAS)} AND NOT {_m(end, f"[{cs.CJK}]")} AND NOT {speaks} AND NOT {is_open})) THEN 'speak anew' ELSE 'speak' END
WHEN complete AND NOT closes AND NOT quoted AND buf <> '' AND NOT {speaks} AND (NOT {is_open} OR length(buf) > 120) THEN 'join end' WHEN complete AND NOT closes AND NOT quoted AND buf = '' AND NOT broken THEN 'quiet'
WHEN closes THEN 'close' WHEN buf <> '' AND NOT {speaks} AND ((NOT {is_open} AND {sentence}) OR {wrapped}) THEN 'join anew' ELSE 'join' END"""
    old_due, old_pair = "CASE WHEN fresh THEN '' ELSE due END", "CASE WHEN fresh THEN '' ELSE pair END"
    own = f"CASE WHEN fresh OR {begin} = '' THEN left(ltrim(line, '{ws}'), 1) ELSE {begin} END"
    of_pair = f"array_to_string(list_filter(string_split(brks, ''), lambda z: z = own OR z = ({_closer('own')})), '')"
    pair = "CASE own " + " ".join(f"WHEN '{a}' THEN {_deleted(f'({old_pair}) || brk_own', [(a, b)], 6)}" for a, b in cs.BRACKETS) + " ELSE '' END"
    depths = ", ".join(f"CASE WHEN NOT adds THEN d{k} WHEN act = 'join end' THEN b{k} ELSE greatest(b{k} + x{k}[1], x{k}[2]) END AS d{k}" for k in kinds)
    befores = ", ".join(f"CASE WHEN forget THEN 0 ELSE d{k} END AS b{k}" for k in kinds)
    ends = f"(act = 'join end' OR (act = 'close' AND {' + '.join(f'd{k}' for k in kinds)} = 0 AND {_in('bef', cs.CLAUSE_OR_END)} AND (NOT was_open OR broken OR length(buf) > 120)))"
    return f"""{lines}{_SQL_LINES_COLLAPSED},
f AS MATERIALIZED ({facts}),
st AS (SELECT doc_id, -1 AS line_no, 0 AS code, '' AS buf, '' AS due, 0 AS cjk, 0 AS latin, '' AS pair, {", ".join(f"0 AS d{k}" for k in kinds)} FROM {table}
UNION ALL
SELECT doc_id, line_no, code, CASE WHEN fin THEN '' ELSE buf END, CASE WHEN fin THEN '' ELSE due END, CASE WHEN fin THEN 0 ELSE cjk END, CASE WHEN fin THEN 0 ELSE latin END, CASE WHEN fin THEN '' ELSE pair END, {", ".join(f"CASE WHEN fin AND silent THEN 0 ELSE d{k} END" for k in kinds)} FROM (
SELECT doc_id, line_no, code, buf, due, cjk, latin, pair, {", ".join(f"d{k}" for k in kinds)}, CASE WHEN act IN ('break', 'alone', 'quiet') THEN true WHEN act = 'skip' THEN false ELSE {ends} END AS fin, act NOT IN ('break', 'alone') OR had AS silent FROM (
SELECT doc_id, line_no, act, broken, had, bef, was_open, code, CASE WHEN adds THEN CASE WHEN fresh THEN line ELSE buf || line END ELSE buf END AS buf, CASE WHEN adds THEN {_deleted(f"({old_due}) || brk", cs.BRACKETS, 6)} ELSE due END AS due,
CASE WHEN adds THEN n_cjk + CASE WHEN fresh THEN 0 ELSE cjk END ELSE cjk END AS cjk, CASE WHEN adds THEN n_latin + CASE WHEN fresh THEN 0 ELSE latin END ELSE latin END AS latin,
CASE WHEN adds THEN {pair} ELSE pair END AS pair, {depths} FROM (
SELECT *, {of_pair} AS brk_own, {befores} FROM (
SELECT *, {own} AS own, NOT fresh AND {is_open} AS was_open, CASE WHEN prev <> '' THEN prev WHEN fresh THEN '' ELSE {end} END AS bef, (act IN ('speak', 'speak anew') AND dialog) OR (act = 'join' AND NOT had) OR act = 'join anew' AS forget,
CASE WHEN act IN ('skip', 'break') THEN 0 WHEN act = 'alone' AND heading THEN 3 WHEN act IN ('alone', 'quiet') THEN 4 WHEN fresh THEN 1 ELSE 2 END AS code FROM (
SELECT *, act NOT IN ('skip', 'break', 'alone', 'quiet') AS adds, buf = '' OR act IN ('speak anew', 'join anew') AS fresh, buf <> '' AS had FROM (
SELECT st.* EXCLUDE (line_no, code), f.* EXCLUDE (doc_id), {act} AS act FROM st JOIN f ON f.doc_id = st.doc_id AND f.line_no = st.line_no + 1))))))),
coded AS (SELECT st.doc_id, st.line_no, st.code, f.line, f.kind, count(CASE WHEN st.code IN (1, 3, 4) THEN 1 END) OVER (PARTITION BY st.doc_id ORDER BY st.line_no) AS k FROM st JOIN f ON f.doc_id = st.doc_id AND f.line_no = st.line_no WHERE st.code > 0),
seg AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS seg_no, CASE WHEN min(code) = 1 THEN 'paragraph' WHEN any_value(kind) <> '' THEN any_value(kind) WHEN min(code) = 3 THEN 'heading' ELSE 'line' END AS kind, string_agg(line, '' ORDER BY line_no) AS text FROM coded GROUP BY doc_id, k)
"""


def _src_sql(text: str, table: str, before: str = "") -> str:
    """WITH and the lines of a text column as src(doc_id, line_no, line), trimmed at the right."""
    return f"""WITH RECURSIVE {before}src AS (SELECT doc_id, unnest(range(len(p))) AS line_no, rtrim(unnest(p), '{cs.STRIP_CHARS}') AS line FROM (SELECT doc_id, string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10)) AS p FROM {table}))"""


_SBROKEN = f"regexp_replace(translate(lower(text), '{_FROM}', '{_TO}'), '(.{{30}})', '\\1' || chr(10), 'g')"
_register("reflow_segments", lambda spark, sf: rf.reflow_segments(_hard_broken(spark, sf), ["doc_id"], "text"), _reflow_sql(_src_sql(_SBROKEN, "documents"), False) + "SELECT * FROM seg")
_register(
    "reflow_text_compact",
    lambda spark, sf: _hard_broken(spark, sf).select("doc_id", rf.reflow(F.col("text"), True, True).alias("text")),
    _reflow_sql(_src_sql(_SBROKEN, "documents"), True) + "SELECT doc_id, string_agg(text, chr(10) ORDER BY seg_no) AS text FROM seg GROUP BY doc_id",
)

_SPAGES = _PAGES_SQL.replace("coalesce(text, '')", f"translate(lower(coalesce(text, '')), '{_FROM}', '{_TO}')")
_SASSEMBLED = f"""{_SPAGES}, asm AS (SELECT doc_id, CAST(max(n) AS INTEGER) AS n_pages, string_agg('=== [Page ' || i || '/' || n || '] ===' || chr(10) || chr(10) || t || chr(10) || chr(10), '' ORDER BY i) AS text FROM p GROUP BY doc_id), """
_register(
    "document_text",
    lambda spark, sf: pg.extract_documents(_pages(spark, sf).withColumn("text", F.translate(F.lower("text"), _FROM, _TO)), header=True),
    _reflow_sql(_src_sql("text", "asm", _SASSEMBLED), True, "asm") + "SELECT doc_id, n_pages, string_agg(seg.text, chr(10) || chr(10) ORDER BY seg_no) AS text, 'done' AS status FROM seg JOIN asm USING (doc_id) GROUP BY doc_id, n_pages",
)

# --- conversion ------------------------------------------------------------------------------------------------------

_CHOICES = (("s2t", "t2s"), ("std", "hk", "tw"), (True, False))


def _config_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents").select("doc_id", *(F.element_at(F.array(*map(F.lit, v)), F.pmod(F.floor(F.col("doc_id") / d), F.lit(len(v))).cast("int") + 1).alias(n) for n, v, d in zip(("direction", "region", "idioms"), _CHOICES, (1, 2, 6), strict=True)))
    name = cv.resolve_config(F.col("direction"), F.col("region"), F.col("idioms"))
    number = F.pmod(F.col("doc_id"), F.lit(20)).cast("int")
    return rows.select("doc_id", name.alias("config"), cv.config_id(F.upper(name)).alias("id"), cv.config_name(number).alias("by_id"), cv.is_config_id(number).alias("valid"), cv.config_id(F.lit("nope")).alias("unknown"))


_cfg = "CASE WHEN idioms THEN CASE direction WHEN 's2t' THEN 's2twp' ELSE 'tw2sp' END WHEN region = 'std' THEN direction WHEN direction = 's2t' THEN 's2' || region ELSE region || '2s' END"
_register(
    "config_resolution",
    _config_resolution,
    f"""WITH o AS (SELECT doc_id, (['s2t', 't2s'])[1 + doc_id % 2] AS direction, (['std', 'hk', 'tw'])[1 + (doc_id // 2) % 3] AS region, ([true, false])[1 + (doc_id // 6) % 2] AS idioms FROM documents), c AS (SELECT doc_id, {_cfg} AS config FROM o)
SELECT doc_id, config, CAST(list_position([{_keys(cs.CONFIGS)}], config) AS INTEGER) AS id, CASE WHEN doc_id % 20 BETWEEN 1 AND 16 THEN ([{_keys(cs.CONFIGS)}])[CAST(doc_id % 20 AS INTEGER)] ELSE 's2t' END AS by_id, doc_id % 20 BETWEEN 1 AND 16 AS valid, 1 AS unknown FROM c""",
)
#: A small character table for tests: simplified and traditional in the same order.
_SIMPLE, _TRADITIONAL = "国书汉简体发后台湾", "國書漢簡體發後臺灣"


def _converted(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("line")
    t = F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, F.translate(c, _SIMPLE, _TRADITIONAL)).when(F.pmod(F.col("doc_id"), F.lit(3)) == 1, F.lit("abc")).otherwise(c)
    code = cv.script_code(t, _SIMPLE, _TRADITIONAL)
    return cjk_lines(spark, sf).select(*_ID, cv.convert_punctuation(c, "s2t").alias("s2t"), cv.convert_punctuation(c, "t2s").alias("t2s"), cv.convert_chars(c, _SIMPLE, _TRADITIONAL).alias("chars"), code.alias("code"), cv.script_label(code).alias("label"), cv.auto_direction(code).alias("direction"))


_code = f"CASE WHEN translate(t, '{_TRADITIONAL}', '{_SIMPLE}') <> t THEN 1 WHEN translate(t, '{_SIMPLE}', '{_TRADITIONAL}') <> t THEN 2 ELSE 0 END"
_register(
    "script_conversion",
    _converted,
    _sql_lines()
    + f""", k AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN translate(line, '{_SIMPLE}', '{_TRADITIONAL}') WHEN 1 THEN 'abc' ELSE line END AS t FROM l), c AS (SELECT *, {_code} AS code FROM k)
SELECT {_SID}, translate(line, '“”‘’', '「」『』') AS s2t, translate(line, '「」『』', '“”‘’') AS t2s, translate(line, '{_SIMPLE}', '{_TRADITIONAL}') AS chars, code,
CASE code WHEN 2 THEN 'zh-Hans (简体)' WHEN 1 THEN 'zh-Hant (繁体)' ELSE 'non-zho （其它）' END AS label, CASE code WHEN 2 THEN 's2t' WHEN 1 THEN 't2s' END AS direction FROM c""",
)


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases: each token of the derived texts of two to eight characters that begins with one of a few, to the same reversed; a second stage for single characters."""
    words = _read(spark, sf, "documents").select(F.explode(F.split(F.translate(F.lower("text"), _FROM, _TO), r"[ \n]+")).alias("key")).where(F.length("key").between(2, 8) & F.left("key", F.lit(1)).isin("一", "十", "书", "发", "「")).distinct()
    phrases = words.select(F.lit("s2t").alias("config"), F.lit(1).alias("stage"), "key", F.concat(F.lit("〔"), F.reverse("key"), F.lit("〕")).alias("value"))
    return phrases.unionByName(spark.createDataFrame([("s2t", 1, "体", "體"), ("s2t", 2, "體", "躰"), ("s2t", 2, "发", "發")], "config string, stage int, key string, value string"))


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    convert = cv.lines_converter(cv.load_dictionary(_dictionary(spark, sf), "s2t"), "s2t", punctuation=True)

    def slices(full: Column, line_no: Column) -> Column:
        last = F.greatest(F.floor((F.length(full) - 1) / _WIDTH), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(line_no.alias("line_no"), k.alias("part_no"), F.substring(full, k * _WIDTH + 1, F.lit(_WIDTH)).alias("line")))

    # the lines of a document are converted together, in one row
    parts = F.flatten(F.transform(tx.split_lines(F.translate(F.lower("text"), _FROM, _TO)), slices))
    done = tx.bound(parts, lambda p: F.zip_with(p, convert(p["line"]), lambda x, line: F.struct(x["line_no"].alias("line_no"), x["part_no"].alias("part_no"), line.alias("line"))))
    return _read(spark, sf, "documents").select("doc_id", F.inline(done))


# the longest key at a place, from left to right: at each place the keys that fit there, then a walk that passes over what it took
_register(
    "convert_phrases",
    _phrases,
    "WITH RECURSIVE " + _sql_lines().removeprefix("WITH ")
    + f""", d AS (SELECT DISTINCT w AS key, '〔' || reverse(w) || '〕' AS val FROM (SELECT unnest(regexp_split_to_array(translate(lower(text), '{_FROM}', '{_TO}'), '[ \n]+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 8 AND left(w, 1) IN ('一', '十', '书', '发', '「')
UNION ALL SELECT '体', '體'),
fit AS (SELECT {_SID}, i, max_by(key, length(key)) AS key FROM (SELECT {_SID}, i, unnest(range(1, 9)) AS n, line FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM l)) x JOIN d ON d.key = substr(line, i, n) AND length(d.key) = n GROUP BY {_SID}, i),
places AS (SELECT {_SID}, list(coalesce(length(key), 1) ORDER BY i) AS ns, list(coalesce(val, substr(line, i, 1)) ORDER BY i) AS vs FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM l) LEFT JOIN fit USING ({_SID}, i) LEFT JOIN d USING (key) GROUP BY {_SID}),
walk AS (SELECT {_SID}, coalesce(ns, []) AS ns, vs, 1 AS i, '' AS done FROM l LEFT JOIN places USING ({_SID}) UNION ALL SELECT {_SID}, ns, vs, i + ns[i], done || vs[i] FROM walk WHERE i <= len(ns))
SELECT {_SID}, translate(replace(replace(done, '體', '躰'), '发', '發'), '“”‘’', '「」『』') AS line FROM walk WHERE i > len(ns)""",
)

# --- files, batches, archives ----------------------------------------------------------------------------------------

_NAMES = ("a.txt", "b.c.md", "d", "e.PDF", "f.docx", "g.epub", "h.exe", ".bashrc", "i_s2t.txt", "j.tar.gz")


def _file_rows(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.pmod("doc_id", F.lit(len(_NAMES))).cast("int") + 1)
    folder = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("/out/")).otherwise(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("/")))
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(folder, name).alias("path"), (F.pmod("doc_id", F.lit(17)) != 0).alias("exists"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return bt.plan(_file_rows(spark, sf), bt.Job(out_dir="/out"))


_SPLAN = f"""WITH f AS (SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '/out/' ELSE '/in/' || doc_id || '/' END || ([{_keys(_NAMES)}])[1 + doc_id % {len(_NAMES)}] AS path, doc_id % 17 <> 0 AS "exists" FROM documents),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM f),
e AS (SELECT ord, path, "exists", regexp_extract(name, '^([^.]*)', 1) AS base, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM n),
r AS (SELECT *, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ({_keys(cs.OFFICE_EXTENSIONS)}) THEN 'office' WHEN ext = '' OR ext IN ({_keys(cs.TEXT_EXTENSIONS)}) THEN 'text' ELSE 'unsupported' END AS route FROM e),
o AS (SELECT *, CASE route WHEN 'pdf' THEN '/out/' || base || '_s2t.txt' WHEN 'unsupported' THEN NULL ELSE '/out/' || base || '_s2t' || CASE WHEN ext = '' THEN '' ELSE '.' || ext END END AS out_path FROM r),
s AS (SELECT *, CASE WHEN NOT "exists" THEN 'not_found' WHEN route = 'unsupported' THEN 'unsupported' WHEN route <> 'pdf' AND path = out_path THEN 'same_path' ELSE 'ready' END AS status FROM o),
p AS (SELECT *, status = 'ready' AND ord = max(ord) OVER (PARTITION BY CASE WHEN status = 'ready' THEN out_path END) AS wins FROM s)
"""
_register("batch_plan", _plan, _SPLAN + "SELECT * FROM p")
_says = "CASE st " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bt.MESSAGES.items()) + " END"
_register(
    "batch_log",
    lambda spark, sf: bt.log_lines(_plan(spark, sf)),
    _SPLAN
    + f""", q AS (SELECT *, CASE WHEN status = 'ready' AND route = 'text' AND ext = '' THEN 'done_no_ext' WHEN status = 'ready' THEN 'done' ELSE status END AS st FROM p)
SELECT ord, st AS status, (ord + 1) || ': ' || CASE WHEN st IN ('not_found', 'unsupported') THEN path ELSE out_path END || ' -> ' || {_says} AS line FROM q""",
)


def _pdf_tests(spark: SparkSession, sf: str) -> DataFrame:
    data = F.concat(F.repeat(F.lit("x"), F.pmod("page_id", F.lit(70)).cast("int")), F.lit("%PDF-1.7"), F.lit("y")).cast("binary")
    return _read(spark, sf, "pages").select("page_id", fs.is_pdf_content(data).alias("anywhere"), fs.is_pdf_start(data).alias("first"), fs.is_pdf_name(fs.extension(F.concat("url", F.when(F.col("page_id") % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".pdf.txt"))))).alias("named"))


_register("pdf_tests", _pdf_tests, "SELECT page_id, page_id % 70 <= 59 AS anywhere, page_id % 70 = 0 AS first, page_id % 2 = 0 AS named FROM pages")

_ENTRIES = ("word/document.xml", "word/header1.xml", "xl/sharedStrings.xml", "xl/worksheets/sheet1.xml", "ppt/slides/slide3.xml", "ppt/notesSlides/notesSlide1.xml", "content.xml", "OEBPS/Ch1.XHTML", "a/../b", "/abs", "a\\b", "a..b", "", "ppt/slides/slide1.rels")
_FORMATS = ("docx", "xlsx", "pptx", "odt", "epub", "zip")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _ENTRIES)), F.pmod("doc_id", F.lit(len(_ENTRIES))).cast("int") + 1)
    fmt = F.element_at(F.array(*map(F.lit, _FORMATS)), F.pmod(F.floor(F.col("doc_id") / len(_ENTRIES)), F.lit(len(_FORMATS))).cast("int") + 1)
    rows = _read(spark, sf, "documents").select("doc_id", name.alias("name"), fmt.alias("format"))
    n, f = F.col("name"), F.col("format")
    return rows.select("doc_id", "name", "format", ar.is_safe_name(n).alias("safe"), ar.is_target(f, n, F.lit(False)).alias("target"), ar.masks_fonts(f, n).alias("masked"))


_register(
    "archive_entries",
    _entries,
    f"""WITH e AS (SELECT doc_id, ([{_keys(_ENTRIES)}])[1 + doc_id % {len(_ENTRIES)}] AS name, ([{_keys(_FORMATS)}])[1 + (doc_id // {len(_ENTRIES)}) % {len(_FORMATS)}] AS format FROM documents)
SELECT doc_id, name, format, name <> '' AND NOT starts_with(name, '/') AND NOT contains(name, chr(92)) AND NOT contains(name, '../') AND NOT contains(name, '/..') AS safe,
CASE format WHEN 'docx' THEN name = 'word/document.xml' WHEN 'xlsx' THEN name = 'xl/sharedStrings.xml' OR (starts_with(name, 'xl/worksheets/') AND ends_with(name, '.xml'))
WHEN 'pptx' THEN starts_with(name, 'ppt/') AND ends_with(name, '.xml') AND (contains(name, 'slides/slide') OR contains(name, 'notesSlides/notesSlide')) WHEN 'odt' THEN name = 'content.xml'
WHEN 'epub' THEN regexp_matches(lower(name), '\\.(xhtml|html|opf|ncx)$') ELSE false END AS target, format <> 'xlsx' OR name = 'xl/sharedStrings.xml' AS masked FROM e""",
)


def _font_masks(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(F.lit('<w:rFonts w:eastAsia="'), F.col("page_id").cast("string"), F.lit('" w:ascii="Arial" w:b="1"/>'), F.left("url", F.lit(20)))
    return _read(spark, sf, "pages").select("page_id", xml.alias("xml"), ar.mask_fonts(xml, "docx").alias("m")).select("page_id", F.col("m.masked").alias("masked"), F.array_join("m.fonts", "|").alias("fonts"), (ar.unmask_fonts(F.col("m.masked"), F.col("m.fonts")) == F.col("xml")).alias("back"))


_register("font_masks", _font_masks, """SELECT page_id, '<w:rFonts w:eastAsia="__F_O_N_T_0__" w:ascii="__F_O_N_T_1__" w:b="1"/>' || left(url, 20) AS masked, page_id || '|Arial' AS fonts, true AS back FROM pages""")


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Each page as an EPUB, exploded, and converted: what came of its text."""
    table = str.maketrans("ae", "人书")

    def build(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for page, html in frame.itertuples(index=False):
                entries = [{"ord": 0, "name": "OEBPS/", "is_dir": True, "data": b""}, {"ord": 1, "name": "OEBPS/a.xhtml", "is_dir": False, "data": (html or "").encode()}, {"ord": 2, "name": "mimetype", "is_dir": False, "data": b"application/epub+zip"}]
                rows.append((page, "EPUB", ar.write_entries(entries, "epub")))
            yield pd.DataFrame(rows, columns=["archive_id", "format", "content"])

    files = _read(spark, sf, "pages").select("page_id", "html").mapInPandas(build, "archive_id long, format string, content binary")
    done = ar.convert_archives(files, lambda s: s.translate(table))
    entries = ar.explode_archives(done.where("success").select("archive_id", "format", "content"))
    text = entries.where(F.col("name") == "OEBPS/a.xhtml").select("archive_id", F.col("data").cast("string").alias("text"))
    return done.select("archive_id", "success", "fragments").join(text, "archive_id")


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkstone-")
    return f"{base.rstrip('/')}/inkstone/{uuid.uuid4().hex}"


def _archive_source(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of fifty pages each, written as files and read as entries, in parts of 4 KB."""

    def build(frame):
        import pandas as pd

        rows = sorted(zip(frame["page_id"], frame["html"], strict=True))
        entries = [{"ord": i, "name": f"pages/{p}.html", "is_dir": False, "data": (h or "").encode()} for i, (p, h) in enumerate(rows)]
        return pd.DataFrame({"name": [f"{rows[0][0] // 50}.zip"], "data": [ar.write_entries(entries, "zip")]})

    folder = _scratch(spark)
    built = _read(spark, sf, "pages").select("page_id", "html").groupBy(F.floor(F.col("page_id") / 50)).applyInPandas(build, "name string, data binary")
    failed = fs.write_files(built.withColumn("out_path", F.concat(F.lit(folder + "/"), "name"))).where("status <> 'done'").count()
    if failed:
        raise OSError(f"{failed} archives could not be written")
    rows = sa.read_archives(spark, folder, split=4096)
    archive = F.regexp_extract("path", r"([0-9]+)\.zip$", 1).cast("long")
    return rows.select(archive.alias("archive"), "name", "size", "status", F.col("data").cast("string").alias("text"))


def _file_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text saved as a file by one commit, and the files read back."""
    folder = _scratch(spark)
    # a null id has a name of its own
    name = F.concat_ws("/", F.coalesce(F.pmod("doc_id", F.lit(64)), F.lit(64)).cast("string"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    rows = _read(spark, sf, "documents").select(F.concat(F.lit(f"{folder}/out/"), name).alias("out_path"), F.col("text").cast("binary").alias("data"))
    found = sink.read_back(sink.save_files(rows, f"{folder}/staging"))
    sink.abort_files(f"{folder}/staging/data")
    doc_id = F.nullif(F.regexp_extract("path", r"/(-?[0-9]*)[a-z]*\.txt$", 1), F.lit("")).cast("long")
    return found.select(doc_id.alias("doc_id"), "status", F.col("found_length").alias("length"), F.col("found_sha256").alias("sha256"), (F.col("sha256") == F.col("found_sha256")).alias("same"))


_register("file_sink", _file_sink, "SELECT doc_id, 'done' AS status, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length, sha256(coalesce(text, '')) AS sha256, true AS same FROM documents")
_register("archive_source", _archive_source, "SELECT page_id // 50 AS archive, 'pages/' || page_id || '.html' AS name, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, 'done' AS status, coalesce(html, '') AS text FROM pages")
_register("archive_roundtrip", _roundtrip, """SELECT page_id AS archive_id, true AS success, 1 AS fragments, translate(coalesce(html, ''), 'ae', '人书') AS text FROM pages WHERE coalesce(html, '') NOT LIKE '%font-family%'""")
