"""Line heuristics: page markers, list items, repeats, metadata, headings, dividers and sentence boundaries, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as cs
from . import text as tx

# Patterns valid for Java and RE2.
LIST_START = rf"^(?:[{cs.escaped(cs.BULLETS)}][{cs.WS}]|\([{cs.LIST_NUMBER}]{{1,2}}\)|（[{cs.LIST_NUMBER}]{{1,2}}）|[{cs.LIST_NUMBER}]{{1,2}}(?:[{cs.escaped(cs.LIST_CLOSERS)}]|\.[{cs.WS}{cs.CJK}]))"
LIST_CLOSER_PREFIX = rf"^[{cs.LIST_NUMBER}]{{1,2}}[)）]"
METADATA = rf"(?s)^([^{cs.METADATA_SEPARATORS}]{{1,10}})[{cs.METADATA_SEPARATORS}][ \t\r\x{{3000}}]*(.*)\z"
CHAPTER = rf"(?s)^[^第]{{0,10}}第.{{0,5}}?[{cs.CHAPTER_MARKERS}](?:[^{cs.NOT_AFTER_MARKER}]|\z)"
VOLUME = rf"^[卷章][{cs.NUMERALS}]"
# With a back reference, for Java only.
REPEATED_UNIT = r"(?s)^(.{4,10}?)\1{2,}\z"


def is_page_marker(t: Column) -> Column:
    return (F.length(t) >= 7) & F.startswith(t, F.lit("=== ")) & F.endswith(t, F.lit("==="))


def begins_with_list(t: Column) -> Column:
    return tx.lstrip(t).rlike(LIST_START)


def list_has_unclosed_bracket(t: Column) -> Column:
    """As has_unclosed_bracket, but the closer of a list number is no stray bracket."""
    return tx.has_unclosed_bracket(F.regexp_replace(tx.lstrip(t), LIST_CLOSER_PREFIX, ""))


def collapse_token(t: Column) -> Column:
    """A token of 4 to 200 characters that repeats a unit of 4 to 10 at least three times becomes the unit."""
    # three units take twelve characters
    return F.when(F.length(t).between(12, 200), F.regexp_replace(t, REPEATED_UNIT, "$1")).otherwise(t)


def _first_repeat(tokens: Column) -> Column:
    """(start from 1, length, tokens in the repeated part) of the first phrase of up to eight tokens that comes three times or more; null if none does.

    A phrase of n tokens comes three times from where 2 n tokens in a row equal the n-th one after them.
    """

    def of(n: int) -> Column:
        same = F.array_join(F.zip_with(tokens, F.slice(tokens, n + 1, F.size(tokens)), lambda a, b: F.when(a.eqNullSafe(b), "1").otherwise("0")), "")
        return tx.bound(same, lambda s: tx.bound(F.instr(s, "1" * (2 * n)), lambda at: F.when(at > 0, F.struct(at.alias("start"), F.lit(n).alias("n"), F.length(F.regexp_extract(F.substring(s, at, F.length(s)), "^1+", 0)).alias("run")))))

    return F.array_min(F.array(*map(of, range(1, 9))))


def collapse_phrase(tokens: Column) -> Column:
    """The first phrase of up to eight tokens that comes at least three times in a row is kept once, in an array of tokens.

    A lone token cannot repeat, so lines are searched only if they have some token three times.
    """
    three = F.size(tokens) >= 3
    repeats = F.size(tokens) - F.size(F.array_distinct(tokens)) >= 2

    def cut(found: Column) -> Column:
        after = found["start"] + found["n"] * (F.floor(found["run"] / found["n"]).cast("int") + 1)
        return F.concat(F.slice(tokens, 1, found["start"] + found["n"] - 1), F.slice(tokens, after, F.size(tokens)))

    return F.when(three & repeats, F.coalesce(tx.bound(_first_repeat(tokens), lambda f: F.when(f.isNotNull(), cut(f))), tokens)).otherwise(tokens)


def collapse_repeats(t: Column) -> Column:
    """Tokens between blanks and tabs, with repeated phrases, then repeated units, collapsed and joined by one blank.

    A phrase that comes three times leaves at least two tokens that are no news; most lines have fewer, or no blank at all.
    """
    spaces = F.contains(t, F.lit(" ")) | F.contains(t, F.lit("\t"))

    def tokens(parts: Column) -> Column:
        return F.filter(parts, lambda x: x != "")

    def searched(w: Column) -> Column:
        return F.when(F.size(w) == 0, t).otherwise(F.array_join(F.transform(collapse_phrase(w), collapse_token), " "))

    def plain(parts: Column) -> Column:
        single = ~(F.contains(t, F.lit("  ")) | F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" ")) | F.contains(t, F.lit("\t")))
        return F.when(single & ~t.rlike("[^ ]{12}"), t).otherwise(tx.bound(tokens(parts), lambda w: F.when(F.size(w) == 0, t).otherwise(F.array_join(F.transform(w, collapse_token), " "))))

    # a split by one character needs no pattern; empty parts count as repeats, which does no harm
    split = F.split(F.translate(t, "\t", " "), " ", -1)
    many = tx.bound(split, lambda parts: F.when(F.size(parts) - F.size(F.array_distinct(parts)) < 2, plain(parts)).otherwise(tx.bound(tokens(parts), searched)))
    return F.when(~spaces, collapse_token(t)).otherwise(many)


def is_metadata(t: Column) -> Column:
    s = tx.strip(t)
    key, rest = tx.strip(F.regexp_extract(s, METADATA, 1)), F.regexp_extract(s, METADATA, 2)
    return (F.length(s) <= 30) & key.isin(*cs.METADATA_KEYS) & (rest != "") & ~F.left(rest, F.lit(1)).isin(*cs.DIALOG_OPENERS)


def is_title_heading(t: Column) -> Column:
    """Of a left-stripped line: a title word, a numbered chapter or a volume with a numeral."""
    n = F.length(t)
    words = F.lit(False)
    for w in cs.TITLE_WORDS:
        if w != "番外":
            words = words | F.startswith(t, F.lit(w))
    extra = F.startswith(t, F.lit("番外"))
    late_comma = F.substring(t, 21, 30).rlike("[,，]")
    body = F.when(extra, n <= 17).otherwise(words | t.rlike(CHAPTER) | (t.rlike(VOLUME) & (n <= 22)))
    return n.between(1, 50) & ~late_comma & body


def is_heading_like(t: Column) -> Column:
    """A short line that reads as a heading."""
    s = tx.strip(t)
    n = F.length(s)
    last, head = tx.last_char(s), tx.before_last(s)
    limit = F.when(tx.is_all_ascii(s) | tx.is_mixed_cjk_ascii(s), F.lit(2 * cs.SHORT_HEADING)).otherwise(F.lit(cs.SHORT_HEADING))
    inner = tx.strip(F.substring(s, F.lit(2), F.greatest(n - 2, F.lit(0))))
    return (
        F.when((s == "") | (last == "") | is_page_marker(s), F.lit(False))
        .when(tx.has_unclosed_bracket(s) | tx.has_unclosed_quote(s), F.lit(False))
        .when(tx.is_one_of(last, cs.COLONS) & (n <= limit) & tx.is_all_cjk(head), F.lit(True))
        .when(tx.is_one_of(last, cs.POSTFIX_CLOSERS) & ~tx.contains_any(head, cs.COMMAS), F.lit(True))
        .when(tx.is_wrapped(s) & tx.is_mostly_cjk(inner), F.lit(True))
        .when(tx.is_one_of(last, cs.CLAUSE_OR_END) | tx.contains_any(s, cs.COMMAS + cs.STRONG_ENDS) | (n > limit), F.lit(False))
        .otherwise(tx.is_all_digits(s) | tx.contains_non_ascii(s) | tx.has_latin(s))
    )


def is_indented(t: Column) -> Column:
    return t.rlike(r"^[ \t\x{3000}]{2}")


def is_chapter_ending(t: Column) -> Column:
    return (F.length(t) <= 15) & t.rlike(rf"[{cs.CHAPTER_MARKERS}][{cs.escaped(cs.CHAPTER_END_BRACKETS)}]*\z")


def is_divider(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t\n\r\x{3000}]", "").rlike(rf"^[{cs.DIVIDER}]{{3,}}\z")


def at_end_allowing_closers(t: Column, index: Column) -> Column:
    """Whether only white space, closing quotes and closing brackets follow an index."""
    closers = cs.escaped(cs.DIALOG_CLOSERS + "".join(b for _, b in cs.BRACKETS))
    return F.substring(t, index + 2, F.length(t)).rlike(rf"^[{cs.WS}{closers}]*\z")


def ends_sentence(t: Column, level: int = 2) -> Column:
    """Whether a line ends a sentence; level 3 is strict, 2 also takes a full-width colon or an ellipsis, 1 any colon or semicolon."""
    last, head = tx.last_char(t), tx.before_last(t)
    prev = tx.last_char(head)
    # a full stop of scanned text stands for a CJK one if a CJK character comes before it
    stop = (prev == ".") & tx.contains_cjk(tx.last_char(tx.before_last(head))) & tx.is_mostly_cjk(t)
    out = tx.is_one_of(last, cs.STRONG_ENDS)
    if level >= 3:
        out = out | (last.isin(".", ":") & tx.contains_cjk(F.right(head, F.lit(1))) & tx.is_mostly_cjk(t))
    out = out | (tx.is_one_of(last, cs.DIALOG_CLOSERS + cs.POSTFIX_CLOSERS) & (tx.is_one_of(prev, cs.STRONG_ENDS) | stop))
    if level < 3:
        out = out | ((last == "：") & tx.is_mostly_cjk(t)) | tx.ends_with_ellipsis(t)
    if level < 2:
        out = out | last.isin("；", "：", ";", ":")
    return out


def ends_with_bracket(t: Column) -> Column:
    """Whether a line is one bracketed, mostly CJK phrase."""
    s = tx.trim_ws(t)
    opener = F.left(s, F.lit(1))
    closer = tx.matching_closer(opener)
    inner = tx.trim_ws(F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))))
    return (F.length(s) >= 2) & (closer != "") & (F.right(s, F.lit(1)) == closer) & tx.is_mostly_cjk(inner) & tx.is_type_balanced(s, opener)
