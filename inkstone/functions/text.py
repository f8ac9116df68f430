"""Text and character-class expressions: Column to Column, all within Catalyst.

NULL text gives NULL; lengths and positions are in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as cs


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once."""
    return F.transform(F.array(value), body)[0]


# --- encoding, newlines, trims ---------------------------------------------------------------------------------------


def decode_lenient(content: Column) -> Column:
    """UTF-8 bytes as text; what is not valid becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def trim_ascii(t: Column) -> Column:
    """Trims ASCII white space; the ideographic space stays."""
    return F.trim(t, F.lit(cs.ASCII_WS_CHARS))


def rstrip(t: Column) -> Column:
    return F.rtrim(t, F.lit(cs.STRIP_CHARS))


def lstrip(t: Column) -> Column:
    return F.ltrim(t, F.lit(cs.STRIP_CHARS))


def strip(t: Column) -> Column:
    return F.trim(t, F.lit(cs.STRIP_CHARS))


def trim_ws(t: Column) -> Column:
    """Trims all white space of the full set."""
    return F.trim(t, F.lit(cs.WS_CHARS))


def rtrim_ws(t: Column) -> Column:
    return F.rtrim(t, F.lit(cs.WS_CHARS))


def split_lines(t: Column) -> Column:
    return F.split(t, "\n", -1)


def is_whitespace(c: Column) -> Column:
    return matches(c, f"^[{cs.WS}]$")


def last_char(t: Column) -> Column:
    """The last character that is not white space, or ''."""
    return F.right(rtrim_ws(t), F.lit(1))


def last_index(t: Column) -> Column:
    """Its index from 0; -1 if there is none."""
    return F.length(rtrim_ws(t)) - 1


def previous_char(t: Column, index: Column) -> Column:
    """The last character before an index that is not white space, or ''."""
    return last_char(F.left(t, index))


def before_last(t: Column) -> Column:
    """The text before its last character that is not white space."""
    r = rtrim_ws(t)
    return F.left(r, F.greatest(F.length(r) - 1, F.lit(0)))


def first_char(t: Column) -> Column:
    return F.left(F.ltrim(t, F.lit(cs.WS_CHARS)), F.lit(1))


def utf16_length(t: Column) -> Column:
    """UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def utf8_prefix(t: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` UTF-8 bytes that ends at a character."""
    data = F.substring(t.cast("binary"), 1, limit)
    tail = r"(?:[\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF7][\x80-\xBF]{0,2})$"
    return F.encode(F.regexp_replace(F.decode(data, "ISO-8859-1"), tail, ""), "ISO-8859-1").cast("string")


# --- character classes -----------------------------------------------------------------------------------------------


def contains_any(t: Column, chars: str) -> Column:
    return matches(t, f"[{cs.escaped(chars)}]")


def is_one_of(c: Column, chars: str) -> Column:
    """Whether a single character is in the set; '' is not."""
    return c.isin(*dict.fromkeys(chars))


def contains_cjk(t: Column) -> Column:
    return matches(t, f"[{cs.CJK}]")


def contains_non_ascii(t: Column) -> Column:
    return matches(t, r"[^\x00-\x7F]")


def is_all_ascii(t: Column) -> Column:
    return matches(t, r"^[\x00-\x7F]*\z")


def has_latin(t: Column) -> Column:
    return matches(t, "[A-Za-z]")


def is_all_digits(t: Column) -> Column:
    return matches(t, r"^[0-9]+\z")


def is_mixed_cjk_ascii(t: Column) -> Column:
    """CJK and ASCII letters or digits (or full-width digits), both, with nothing else but neutral characters."""
    return matches(t, rf"^[ \-/:.A-Za-z0-9\x{{FF10}}-\x{{FF19}}{cs.CJK}]*\z") & contains_cjk(t) & matches(t, r"[A-Za-z0-9\x{FF10}-\x{FF19}]")


def is_mostly_cjk(t: Column) -> Column:
    """At least one CJK character, and no fewer of them than ASCII letters."""
    n = F.regexp_count(t, F.lit(f"[{cs.CJK}]"))
    return (n > 0) & (n >= F.regexp_count(t, F.lit("[A-Za-z]")))


def is_all_cjk(t: Column, allow_ws: bool = False) -> Column:
    return matches(t, rf"^[{cs.CJK}{cs.WS if allow_ws else ''}]+\z") & contains_cjk(t)


def begins_with_dialog(t: Column) -> Column:
    return matches(t, f"^[{cs.WS}]*[{cs.DIALOG_OPENERS}]")


def ends_with(t: Column, chars: str) -> Column:
    """Whether the last character that is not white space is in the set."""
    return matches(t, rf"[{cs.escaped(chars)}][{cs.WS}]*\z")


def ends_with_ellipsis(t: Column) -> Column:
    return is_mostly_cjk(t) & matches(t, rf"(?:…|\.\.\.)[{cs.WS}]*\z")


def ends_complete(t: Column) -> Column:
    """Strong end, colon, or an ellipsis of at least two dots."""
    return ends_with(t, cs.STRONG_ENDS + cs.COLONS) | matches(t, rf"(?:…|\.\.)[{cs.WS}]*\z")


# --- brackets and quotes ---------------------------------------------------------------------------------------------


def matching_closer(c: Column) -> Column:
    """The closing bracket of an opening one, else ''."""
    out = F.lit("")
    for a, b in cs.BRACKETS:
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def is_wrapped(t: Column) -> Column:
    """First character and last one that is not white space are a bracket pair, of three characters at least."""
    closer = matching_closer(F.left(t, F.lit(1)))
    return (F.length(t) >= 3) & (closer != "") & (closer == last_char(t))


def class_ranges(chars: str) -> str:
    """The characters as the inside of a class, neighbours as ranges: a class is tried part by part."""
    out: list[list[int]] = []
    for c in sorted(map(ord, set(chars))):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


_OPEN, _CLOSE = "".join(a for a, _ in cs.BRACKETS), "".join(b for _, b in cs.BRACKETS)
#: What is no bracket; runs of common characters are passed by at once.
_NO_BRACKETS = rf"[\x{{3400}}-\x{{9FFF}}A-Za-z0-9 ]++|[^{class_ranges(_OPEN + _CLOSE)}]++"


def has_unclosed_bracket(t: Column) -> Column:
    """Whether brackets of all kinds fail to nest: left open, closed without being open, or crossed.

    The text is cut down to its brackets first. Most that fail to nest begin with a closer or end with an opener; for the others the fold keeps the
    closers that are still due, nearest first.
    """
    # neighbours that match nest wherever they are, and are most of what there is
    pairs = "|".join(f"[{cs.escaped(a)}][{cs.escaped(b)}]" for a, b in cs.BRACKETS)
    only = F.regexp_replace(F.regexp_replace(t, _NO_BRACKETS, ""), pairs, "")

    def step(due: Column, c: Column) -> Column:
        closer = F.translate(c, _OPEN, _CLOSE)
        return F.when(due == "!", due).when(closer != c, F.concat(closer, due)).when(F.left(due, F.lit(1)) == c, F.substring(due, F.lit(2), F.length(due))).otherwise(F.lit("!"))

    def nests(o: Column) -> Column:
        astray = F.left(o, F.lit(1)).isin(*_CLOSE) | F.right(o, F.lit(1)).isin(*_OPEN)
        return F.when(o == "", F.lit(False)).when(astray, F.lit(True)).otherwise(F.aggregate(F.split(o, ""), F.lit(""), step) != "")

    return F.when(t.isNotNull(), bound(only, nests))


def _depth_fails(only: Column, opener: Column, wrap: int | None = None) -> Column:
    """Whether a string of openers and closers of one kind goes below zero or ends above."""

    def step(depth: Column, c: Column) -> Column:
        up = depth + 1 if wrap is None else F.pmod(depth + 1, F.lit(wrap))
        return F.when(depth < 0, depth).when(c == opener, up).otherwise(depth - 1)

    return bound(only, lambda o: F.when(o == "", F.lit(False)).otherwise(F.aggregate(F.split(o, ""), F.lit(0), step) != 0))


def has_unclosed_quote(t: Column) -> Column:
    """Whether any of the four quote kinds is left open or closed without being open; each is counted on its own, modulo 256."""
    out = F.lit(False)
    for a, b in cs.QUOTES:
        out = out | contains_any(t, a + b) & _depth_fails(F.regexp_replace(t, f"[^{a}{b}]+", ""), F.lit(a), 256)
    return out


def is_type_balanced(t: Column, opener: Column) -> Column:
    """Whether the brackets of the opener's kind balance; true for what opens nothing."""
    closer = matching_closer(opener)
    kept = F.array_join(F.filter(F.split(t, ""), lambda c: (c == opener) | (c == closer)), "")
    return F.when(closer == "", F.lit(True)).otherwise(~_depth_fails(kept, opener))


def dialog_moves(line: Column) -> Column:
    """For each kind of dialog marks what a line does to a counter that stops at zero: the sum of its steps, and the lowest running sum (0 at most).

    From a depth d it comes to max(d + sum, sum - low); two lines one after the other are of this kind again.
    """

    def kind(a: str, b: str) -> Column:
        def counted(own: Column) -> Column:
            # neighbours that match do nothing; if none are left, all closers come before all openers
            up, down = (F.length(own) - F.length(F.translate(own, c, "")) for c in (a, b))
            least = F.aggregate(F.split(own, ""), F.lit(0), _counter(a, b))
            low = F.when(F.contains(own, F.lit(a + b)), up - down - least).otherwise(-down)
            return F.struct((up - down).alias("sum"), low.alias("low"))

        own = bound(F.replace(F.regexp_replace(line, f"[^{a}{b}]+", ""), F.lit(a + b), F.lit("")), counted)
        return F.when(F.contains(line, F.lit(a)) | F.contains(line, F.lit(b)), own).otherwise(F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low")))

    return F.array(*(kind(a, b) for a, b in cs.DIALOG_PAIRS))


def _counter(opener: str, closer: str):
    return lambda d, c: F.when(c == opener, d + 1).when((c == closer) & (d > 0), d - 1).otherwise(d)
