"""Paragraph reflow: joins the hard-broken lines of scanned or extracted CJK text into paragraphs, as one Column expression.

1. `line_facts` turns each line into a struct of facts: its cleaned text, what it is, how it begins and ends, its brackets, quotes and open
   dialog marks as what they do to those that are open before it.
2. `_fold` runs over the lines with the state of the paragraph under construction: what is open, its first and last characters, its
   length. `decide` is the rule that maps a line and this state to an action; `_after` is what the action leaves. The fold gives a code for each
   line; it goes in chunks of lines, so that lists of codes are never copied as a whole.
3. The codes tell where segments begin; texts are put together from slices of the lines. Each step is linear in the text.

Catalyst expressions only, no Python workers, no shuffle: a document is a row. Lengths are in code points.
"""

from __future__ import annotations

from functools import reduce as _reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import lines as ln
from ..functions import text as tx
from ..functions.text import bound

#: A bracket left open does not hold a paragraph of more characters together.
RUNAWAY = 120
#: Characters that tell whether a paragraph begins as a list item, and how it ends (white space as single blanks).
_HEAD, _TAIL = 8, 8
#: Lines that are folded together.
_CHUNK = 128

_OPEN, _CLOSE = "".join(a for a, _ in cs.BRACKETS), "".join(b for _, b in cs.BRACKETS)
_DIALOG = "".join(a + b for a, b in cs.DIALOG_PAIRS)
_PAIRS = "|".join(f"[{cs.escaped(a)}][{cs.escaped(b)}]" for a, b in cs.BRACKETS)
_SENTENCE_END = rf"(?:[{cs.STRONG_ENDS}]|[{cs.STRONG_ENDS}] ?[{cs.escaped(cs.DIALOG_CLOSERS + cs.POSTFIX_CLOSERS)}]) ?\z"
_DOTTED_END = rf"[{cs.CJK}] ?\. ?[{cs.escaped(cs.DIALOG_CLOSERS + cs.POSTFIX_CLOSERS)}] ?\z"
_CJK_END = r"(?:：|…|\.\.\.) ?\z"


def _all(*tests: Column) -> Column:
    """The conjunction; later tests are not made where an earlier one fails."""
    return _reduce(lambda x, y: F.when(x, y).otherwise(F.lit(False)), tests)


def _any(*tests: Column) -> Column:
    return _reduce(lambda x, y: F.when(x, F.lit(True)).otherwise(y), tests)


#: What is no bracket, quote or dialog mark; runs of common characters are passed by at once.
_NO_MARKS = rf"[\x{{3400}}-\x{{9FFF}}A-Za-z0-9 ]++|[^{tx.class_ranges(_OPEN + _CLOSE + _DIALOG)}]++"
_NO_BRACKETS = f"[^{tx.class_ranges(_OPEN + _CLOSE)}]++"
_CLOSERS = f"[{tx.class_ranges(_CLOSE)}]"


def _nest(due: Column, only: Column) -> Column:
    """The closers that are due after a string of brackets, nearest first; `!` once a closer came that was not."""

    def step(due: Column, c: Column) -> Column:
        closer = F.translate(c, _OPEN, _CLOSE)
        return F.when(due == "!", due).when(closer != c, F.concat(closer, due)).when(F.left(due, F.lit(1)) == c, F.substring(due, F.lit(2), F.length(due))).otherwise(F.lit("!"))

    return (
        F.when((only == "") | (due == "!"), due).when(~only.rlike(_CLOSERS), F.concat(F.reverse(F.translate(only, _OPEN, _CLOSE)), due))
        .when((due == "") & only.rlike("^" + _CLOSERS), F.lit("!")).otherwise(F.aggregate(F.split(only, ""), due, step))
    )


def _pair_depth(depth: Column, only: Column, opener: Column) -> Column:
    """The depth of the opener's pair after a string of brackets; -1 once it went below zero."""
    closer = F.translate(opener, _OPEN, _CLOSE)

    def step(d: Column, c: Column) -> Column:
        return F.when(d < 0, d).when(c == opener, d + 1).when(c == closer, d - 1).otherwise(d)

    return F.when((only == "") | (closer == opener), depth).otherwise(F.aggregate(F.split(only, ""), depth, step))


def _heading(s: Column, last: Column, odd: Column, e: Column) -> Column:
    """is_heading_like of a line, with what is known: s the line stripped, its last character, whether brackets or quotes are open, and its counts."""
    n, first, head = F.length(s), F.left(s, F.lit(1)), tx.before_last(s)
    ascii_ = ~tx.contains_non_ascii(s)
    limit = F.when(n <= cs.SHORT_HEADING, F.lit(True)).when(n > 2 * cs.SHORT_HEADING, F.lit(False)).otherwise(_any(ascii_, tx.is_mixed_cjk_ascii(s)))
    wrapped = _all(n >= 3, F.translate(first, _OPEN, _CLOSE) == last, first != last, _mostly(e["cjk"], e["latin"]))
    short = F.when(last.isin(*dict.fromkeys(cs.CLAUSE_OR_END)), F.lit(False)).when(~limit, F.lit(False)).when(tx.contains_any(s, cs.COMMAS + cs.STRONG_ENDS), F.lit(False)).otherwise(_any(e["cjk"] > 0, ~ascii_, tx.is_all_digits(s), tx.has_latin(s)))
    colon = _all(last.isin(*cs.COLONS), limit, e["cjk"] > 0, tx.is_all_cjk(head))
    return F.when(odd | (last == "") | ln.is_page_marker(s), F.lit(False)).otherwise(_any(colon, _all(last.isin(*cs.POSTFIX_CLOSERS), ~tx.contains_any(head, cs.COMMAS)), wrapped, short))


def _title(left: Column) -> Column:
    begins = F.left(left, F.lit(1)).isin(*dict.fromkeys(w[0] for w in (*cs.TITLE_WORDS, "卷", "章")))
    return _all(F.length(left) <= 50, begins | F.contains(left, F.lit("第")), ln.is_title_heading(left))


def _mostly(cjk: Column, latin: Column) -> Column:
    return (cjk > 0) & (cjk >= latin)


def line_facts(raw: Column) -> Column:
    """A struct of what reflow needs to know about a line."""

    def told(t: Column) -> Column:
        parts = F.struct(
            tx.lstrip(t).alias("left"), tx.rtrim_ws(t).alias("r"), tx.first_char(t).alias("first"), F.length(t).alias("n"),
            F.regexp_replace(t, _NO_MARKS, "").alias("marks"),
            F.regexp_replace(t, f"[{cs.CJK}]+", "").alias("foreign"),
        )
        return F.when(t != "", bound(parts, lambda p: bound(ends(t, p), lambda e: bound(opened(t, p, e), lambda o: facts(t, p, e, o)))))

    def ends(t: Column, p: Column) -> Column:
        before = F.left(p["r"], F.greatest(F.length(p["r"]) - 1, F.lit(0)))
        cjk = p["n"] - F.length(p["foreign"])
        latin = F.length(p["foreign"]) - F.length(F.regexp_replace(p["foreign"], "[A-Za-z]+", ""))
        brackets = F.translate(p["marks"], _DIALOG, "")
        return F.struct(
            F.right(p["r"], F.lit(1)).alias("last"), tx.last_char(before).alias("prev"), cjk.cast("int").alias("cjk"), latin.cast("int").alias("latin"),
            ln.begins_with_list(p["left"]).alias("item"), brackets.alias("brackets"), F.when(p["marks"] != brackets, tx.dialog_moves(p["marks"])).alias("dialogs"),
        )

    def opened(t: Column, p: Column, e: Column) -> Column:
        none = F.lit("")
        only = F.when(e["brackets"] == "", none).otherwise(F.regexp_replace(e["brackets"], _PAIRS, ""))
        # the closer of a list number is no bracket
        listed = F.regexp_replace(F.regexp_replace(p["left"], ln.LIST_CLOSER_PREFIX, ""), _NO_BRACKETS, "")
        inner = F.when(e["brackets"] == "", none).when(e["item"], listed).otherwise(only)
        # quotes are balanced if they come to nothing from any depth; counters of that many wrap around
        kinds = F.slice(e["dialogs"], 1, len(cs.QUOTES))
        quotes = F.when(e["dialogs"].isNull(), F.lit(False)).when(F.length(p["marks"]) > 255, tx.has_unclosed_quote(p["marks"])).otherwise(F.exists(kinds, lambda x: (x["sum"] != 0) | (x["low"] != 0)))
        return F.struct(only.alias("only"), (_nest(none, inner) != "").alias("bracket"), quotes.alias("quote"), F.when(e["item"], _nest(none, only) != "").alias("plain"))

    def facts(t: Column, p: Column, e: Column, o: Column) -> Column:
        last = e["last"]
        mark = _all(p["n"] >= 7, F.startswith(t, F.lit("=== ")), ln.is_page_marker(t))
        kind = (
            F.when(F.left(p["left"], F.lit(1)).rlike(f"[{cs.DIVIDER}]") & ln.is_divider(p["left"]), F.lit("divider"))
            .when(mark, F.lit("marker"))
            .when(_title(p["left"]), F.lit("title"))
            .when(_all(t.rlike(f"[{cs.METADATA_SEPARATORS}]"), ln.is_metadata(t)), F.lit("metadata"))
            .otherwise(F.lit(""))
        )
        heading = _heading(tx.rstrip(p["left"]), last, F.coalesce(o["plain"], o["bracket"]) | o["quote"], e)
        goes_on = _any(last.isin(*cs.COLONS, *cs.POSTFIX_CLOSERS), _all(e["cjk"] > 0, F.regexp_replace(p["foreign"], f"[{cs.WS}]+", "") == ""))
        dots = _all(last.isin("…", "."), _mostly(e["cjk"], e["latin"]), p["r"].rlike(r"(?:…|\.\.\.)\z"))
        tail = F.when(p["n"] > 64, F.right(t, F.lit(64))).otherwise(t)
        # white space of more than the end's length is as rare as it is harmless to look at the whole line for it
        end = F.right(F.regexp_replace(tail, f"[{cs.WS}]+", " "), F.lit(_TAIL))
        return F.struct(
            F.when(kind == "divider", p["left"]).otherwise(t).alias("text"), kind.alias("kind"), _all(kind == "", heading).alias("heading"), goes_on.alias("goes_on"),
            p["first"].isin(*cs.DIALOG_OPENERS).alias("dialog"), e["item"].alias("item"), last.isin(*cs.DIALOG_CLOSERS).alias("closes"),
            o["bracket"].alias("bracket"), o["quote"].alias("quote"), _any(last.isin(*cs.STRONG_ENDS, *cs.COLONS), dots).alias("complete"),
            last.alias("last"), e["prev"].alias("prev"), p["first"].alias("first"), p["n"].alias("n"), o["only"].alias("only"),
            F.when(F.length(end) < _TAIL, F.right(F.regexp_replace(t, f"[{cs.WS}]+", " "), F.lit(_TAIL))).otherwise(end).alias("tail"), F.left(p["left"], F.lit(_HEAD)).alias("head"), e["cjk"].alias("cjk"), e["latin"].alias("latin"),
            e["dialogs"].alias("dialogs"),
        )

    return bound(tx.rstrip(raw), lambda t: bound(ln.collapse_repeats(t), told))


# --- the fold --------------------------------------------------------------------------------------------------------

_SKIP, _BREAK, _ALONE, _ALONE_QUIET, _SPEAK, _SPEAK_ANEW, _JOIN, _JOIN_ANEW, _JOIN_END, _END_QUOTE = range(10)
#: Codes of lines: nothing, the begin of a paragraph, its continuation, a line that stands alone (as a heading if it looks like one; or not).
_NOTHING, _FIRST, _MORE, _STANDS, _PLAIN = range(5)

#: The paragraph: whether it has lines, its length, closers due, last and first visible character, head and tail, CJK and Latin characters,
#: the depth of the pair of its first character, depths of dialog marks and whether any is open, and the codes of the chunk's lines.
_STATE = {
    "full": "boolean", "len": "int", "due": "string", "end": "string", "first": "string", "head": "string", "tail": "string",
    "cjk": "int", "latin": "int", "pair": "int", "depths": "array<int>", "speaks": "boolean", "codes": "array<int>",
}
_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in _STATE.items()) + ">"


def decide(line: Column, p: Column, page_header: bool) -> Column:
    """What becomes of a line (null: blank), given the paragraph before it."""
    act = lambda a: F.lit(a)
    full, end, speaks = p["full"], p["end"], p["speaks"]
    is_open = p["due"] != ""
    soft = F.lit(False) if page_header else _all(full, _any(speaks, is_open, _all(end != "", ~end.isin(*cs.STRONG_ENDS))))
    sound = ~line["bracket"] & ~line["quote"]
    stands = _any(~full, _all(~is_open, _any(end == "", _all(~end.isin(*cs.COMMAS), _any(~line["goes_on"], end.isin(*cs.CLAUSE_OR_END))))))
    follows = _any((end == "") | end.isin(*cs.COMMAS), speaks | is_open, end.rlike(f"[{cs.CJK}]"))
    items = _all(line["item"], p["head"].rlike(ln.LIST_START))
    speaking = (
        F.when(line["dialog"] & line["closes"] & sound, act(_ALONE_QUIET)).when(line["item"] & line["complete"] & sound, act(_ALONE))
        .when(_all(full, _any(items, ~follows)), act(_SPEAK_ANEW)).otherwise(act(_SPEAK))
    )
    finished = line["complete"] & ~line["closes"] & ~line["quote"]
    mostly = _mostly(p["cjk"], p["latin"])
    sentence = _any(p["tail"].rlike(_SENTENCE_END), _all(mostly, _any(p["tail"].rlike(_CJK_END), p["tail"].rlike(_DOTTED_END))))
    wrapped = _all(F.translate(p["first"], _OPEN, _CLOSE) == end, p["first"] != end, p["pair"] == 0, mostly)
    anew = _all(full, ~speaks, _any(_all(~is_open, sentence), wrapped))
    return (
        F.when(line.isNull(), F.when(soft, act(_SKIP)).otherwise(act(_BREAK)))
        .when((line["kind"] != "") | _all(line["heading"], stands), act(_ALONE))
        .when(line["dialog"] | line["item"], speaking)
        .when(_all(finished, ~full, ~line["bracket"]), act(_ALONE_QUIET))
        .when(_all(finished, full, ~speaks, ~is_open | (p["len"] > RUNAWAY)), act(_JOIN_END))
        .when(line["closes"], act(_END_QUOTE))
        .when(anew, act(_JOIN_ANEW))
        .otherwise(act(_JOIN))
    )


def _paragraph(p: Column, **changes: Column) -> Column:
    return F.struct(*(changes.get(k, p[k]).cast(v).alias(k) for k, v in _STATE.items()))


_SILENT = "array_repeat(0, %d)" % len(cs.DIALOG_PAIRS)


def _emptied(p: Column, codes: Column, forget: Column | None = None) -> Column:
    """The state without a paragraph; open dialog marks are forgotten, where `forget` says so."""
    depths, speaks = F.expr(_SILENT), F.lit(False)
    if forget is not None:
        depths, speaks = F.when(forget, depths).otherwise(p["depths"]), ~forget & p["speaks"]
    zero, none = F.lit(0), F.lit("")
    return _paragraph(p, full=F.lit(False), len=zero, due=none, end=none, first=none, head=none, tail=none, cjk=zero, latin=zero, pair=zero, depths=depths, speaks=speaks, codes=codes)


def _step(p: Column, line: Column, page_header: bool) -> Column:
    """The state after a line."""

    def act_on(act: Column) -> Column:
        def coded(code: Column) -> Column:
            return F.concat(p["codes"], F.array(code))

        alone = coded(F.when(act == _BREAK, F.lit(_NOTHING)).when((act == _ALONE) & line["heading"], F.lit(_STANDS)).otherwise(F.lit(_PLAIN)))
        new = ~p["full"] | act.isin(_SPEAK_ANEW, _JOIN_ANEW)
        return (
            F.when(act == _SKIP, _paragraph(p, codes=coded(F.lit(_NOTHING))))
            .when(act <= _ALONE_QUIET, _emptied(p, alone, p["full"] | (act == _ALONE_QUIET)))
            .otherwise(bound(new, lambda new: bound(added(act, new, coded(F.when(new, F.lit(_FIRST)).otherwise(F.lit(_MORE)))), lambda q: closed(act, new, q))))
        )

    def added(act: Column, new: Column, codes: Column) -> Column:
        def either(first: Column, more: Column) -> Column:
            return F.when(new, first).otherwise(more)

        forget = (act.isin(_SPEAK, _SPEAK_ANEW) & line["dialog"]) | ((act == _JOIN) & ~p["full"]) | (act == _JOIN_ANEW)
        silent = F.expr(_SILENT)
        before = F.when(forget, silent).otherwise(p["depths"])
        tracked = F.zip_with(before, line["dialogs"], lambda d, x: F.greatest(d + x["sum"], x["sum"] - x["low"]))
        depths = F.when(line["dialogs"].isNull() | (act == _JOIN_END), before).otherwise(tracked)
        head, tail = F.concat(p["head"], line["text"]), F.concat(p["tail"], line["tail"])
        first = F.when(new | (p["first"] == ""), line["first"]).otherwise(p["first"])
        # a pair's depth counts from the paragraph's first visible character on
        pair = F.when(line["only"] == "", either(F.lit(0), p["pair"])).otherwise(_pair_depth(either(F.lit(0), p["pair"]), line["only"], first))
        return bound(depths, lambda d: _paragraph(
            p, full=F.lit(True), len=either(line["n"], p["len"] + line["n"]),
            due=_nest(either(F.lit(""), p["due"]), line["only"]),
            end=F.when(new | (line["last"] != ""), line["last"]).otherwise(p["end"]), first=first,
            head=F.when(new, line["head"]).when(F.length(p["head"]) >= _HEAD, p["head"]).otherwise(F.left(tx.lstrip(head), F.lit(_HEAD))),
            tail=F.when(new | (F.length(line["tail"]) >= _TAIL), line["tail"]).otherwise(F.right(F.regexp_replace(tail, f"[{cs.WS}]+", " "), F.lit(_TAIL))),
            cjk=either(line["cjk"], p["cjk"] + line["cjk"]), latin=either(line["latin"], p["latin"] + line["latin"]), pair=pair,
            depths=d, speaks=F.when(line["dialogs"].isNull() & ~forget, p["speaks"]).otherwise(F.exists(d, lambda x: x > 0)), codes=codes,
        ))

    def closed(act: Column, new: Column, q: Column) -> Column:
        """Whether the line that was added ends the paragraph."""
        before = F.when(line["prev"] != "", line["prev"]).when(~new, p["end"]).otherwise(F.lit(""))
        was_open = ~new & (p["due"] != "")
        ends = _any(act == _JOIN_END, _all(act == _END_QUOTE, ~q["speaks"], before.isin(*cs.CLAUSE_OR_END), ~was_open | line["bracket"] | (q["len"] > RUNAWAY)))
        return F.when(ends, _emptied(q, q["codes"])).otherwise(q)

    return bound(decide(line, p, page_header), act_on)


def _fold(lines: Column, page_header: bool) -> Column:
    """A code for each line of an array of facts."""
    start = F.struct(*(F.expr({"boolean": "false", "int": "0", "string": "''", "array<int>": _SILENT if k == "depths" else "array()"}[v]).cast(v).alias(k) for k, v in _STATE.items()))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / _CHUNK).cast("int")), lambda k: F.slice(lines, k * _CHUNK + 1, F.lit(_CHUNK)))

    def chunk(acc: Column, some: Column) -> Column:
        begin = _paragraph(acc["p"], codes=F.array().cast("array<int>"))
        done = F.aggregate(some, begin, lambda p, line: _step(p, line, page_header))
        return bound(done, lambda d: F.struct(d.alias("p"), F.concat(acc["all"], F.array(d["codes"])).alias("all")))

    zero = F.struct(start.cast(_TYPE).alias("p"), F.array().cast("array<array<int>>").alias("all")).cast(f"struct<p:{_TYPE},all:array<array<int>>>")
    return F.flatten(F.aggregate(chunks, zero, chunk)["all"])


def _segments(text: Column, page_header: bool) -> Column:
    """array<struct<kind,text>> of a text that is not blank."""
    raw = F.split(tx.normalize_newlines(text), "\n", -1)

    def of(lines: Column) -> Column:
        coded = F.zip_with(lines, _fold(lines, page_header), lambda x, c: F.struct(c.alias("code"), x["text"].alias("text"), x["kind"].alias("kind")))
        return bound(F.filter(coded, lambda x: x["code"] > _NOTHING), told)

    def told(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: F.get(rows, i - 1)["code"] != _MORE)
        return F.when(F.size(rows) == 0, F.array().cast("array<struct<kind:string,text:string>>")).otherwise(bound(starts, lambda s: F.transform(s, lambda i, k: segment(rows, s, i, k))))

    def segment(rows: Column, starts: Column, i: Column, k: Column) -> Column:
        first = F.get(rows, i - 1)
        after = F.coalesce(F.get(starts, k + 1), F.size(rows) + 1)
        kind = F.when(first["code"] == _FIRST, F.lit("paragraph")).when(first["kind"] != "", first["kind"]).when(first["code"] == _STANDS, F.lit("heading")).otherwise(F.lit("line"))
        body = F.when(after == i + 1, first["text"]).otherwise(F.array_join(F.transform(F.slice(rows, i, after - i), lambda x: x["text"]), ""))
        return F.struct(kind.alias("kind"), body.alias("text"))

    return bound(F.transform(raw, line_facts), of)


def _blank(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n")) == ""


def segments(text: Column, page_header: bool = False) -> Column:
    """array<struct<kind,text>>: paragraphs and stand-alone lines; none for a text of blanks only, NULL for NULL."""
    return F.when(_blank(text), F.array().cast("array<struct<kind:string,text:string>>")).otherwise(F.when(text.isNotNull(), _segments(text, page_header)))


def reflow(text: Column, page_header: bool = False, compact: bool = False) -> Column:
    """The reflowed text; NULL stays NULL, text of blanks only stays as it is."""
    joined = F.array_join(F.transform(_segments(text, page_header), lambda s: s["text"]), "\n" if compact else "\n\n")
    return F.when(_blank(text), text).otherwise(F.when(text.isNotNull(), joined))


def reflow_segments(df: DataFrame, id_cols: list[str], text_col: str, page_header: bool = False) -> DataFrame:
    """One row per segment: id columns, seg_no from 0, kind and text; NULL and blank texts have none."""
    # the array is a column of its own below the generator, so that it is made once
    return df.select(*id_cols, F.posexplode(segments(F.col(text_col), page_header)).alias("seg_no", "seg")).select(*id_cols, "seg_no", "seg.kind", "seg.text")
