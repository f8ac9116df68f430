"""Reflow stated once more, as a list of rules over whole strings, to compare the operator with. No regular expressions, nothing kept incrementally."""

from inkstone.functions import charsets as cs

WS, STRIP = cs.WS_CHARS, cs.STRIP_CHARS
OPENERS = [a for a, _ in cs.BRACKETS]
CLOSERS = [b for _, b in cs.BRACKETS]


def cjk(c):
    return "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿"


def latin(c):
    return "a" <= c.lower() <= "z" and c.isascii()


def mostly(s):
    n = sum(map(cjk, s))
    return n > 0 and n >= sum(map(latin, s))


def visible(s):
    """The characters that are not white space."""
    return [c for c in s if c not in WS]


def last(s):
    return (visible(s) or [""])[-1]


def bracket_issue(s):
    stack = []
    for c in s:
        if c in OPENERS:
            stack.append(c)
        elif c in CLOSERS:
            if not stack or CLOSERS[OPENERS.index(stack.pop())] != c:
                return True
    return bool(stack)


def quote_issue(s):
    for a, b in cs.QUOTES:
        depth = 0
        for c in s:
            depth += (c == a) - (c == b)
            if depth < 0:
                return True
        if depth:
            return True
    return False


def number(c):
    return "0" <= c <= "9" or "０" <= c <= "９" or "一" <= c <= "十"


def list_start(line):
    s = line.lstrip(STRIP)
    if not s:
        return False
    if s[0] in cs.BULLETS and s[1:2] and s[1] in WS:
        return True
    for n in (1, 2):
        for a, b in ("()", "（）"):
            if s[0] == a and len(s) > n + 1 and all(map(number, s[1 : n + 1])) and s[n + 1] == b:
                return True
        if len(s) > n and all(map(number, s[:n])):
            if s[n] in cs.LIST_CLOSERS:
                return True
            if s[n] == "." and len(s) > n + 1 and (s[n + 1] in WS or cjk(s[n + 1])):
                return True
    return False


def list_bracket_issue(line):
    s = line.lstrip(STRIP)
    for n in (1, 2):
        if len(s) > n and all(map(number, s[:n])) and s[n] in ")）":
            return bracket_issue(s[n + 1 :])
    return bracket_issue(s)


def collapse(line):
    words = [w for w in line.replace("\t", " ").split(" ") if w]
    if not words:
        return line

    def phrase(words):
        for start in range(len(words)):
            for n in range(1, 9):
                part, k = words[start : start + n], 1
                while len(part) == n and words[start + k * n : start + k * n + n] == part:
                    k += 1
                if k >= 3:
                    return words[: start + n] + words[start + k * n :]
        return words

    def unit(w):
        if 4 <= len(w) <= 200:
            for n in range(4, 11):
                if len(w) % n == 0 and len(w) // n >= 3 and w[:n] * (len(w) // n) == w:
                    return w[:n]
        return w

    return " ".join(map(unit, phrase(words)))


def divider(s):
    marks = [c for c in s if c not in " \t\n\r　"]
    return len(marks) >= 3 and all("─" <= c <= "╿" or c in "-=_~～*＊★☆" for c in marks)


def marker(s):
    return len(s) >= 7 and s.startswith("=== ") and s.endswith("===")


def title(s):
    if not 0 < len(s) <= 50 or any(c in ",，" for c in s[20:]):
        return False
    for w in cs.TITLE_WORDS:
        if s.startswith(w):
            return len(s) <= 17 if w == "番外" else True
    if "第" in s[:11]:
        at = s.index("第")
        for j in range(at + 1, min(len(s), at + 7)):
            if s[j] in cs.CHAPTER_MARKERS and not (j + 1 < len(s) and s[j + 1] in cs.NOT_AFTER_MARKER):
                return True
    return len(s) >= 2 and s[0] in "卷章" and s[1] in cs.NUMERALS and len(s) <= 22


def metadata(line):
    s = line.strip(STRIP)
    if len(s) > 30:
        return False
    at = next((i for i, c in enumerate(s) if c in cs.METADATA_SEPARATORS), -1)
    if not 1 <= at <= 10 or s[:at].strip(STRIP) not in cs.METADATA_KEYS:
        return False
    rest = s[at + 1 :].lstrip(" \t\r　")
    return bool(rest) and rest[0] not in cs.DIALOG_OPENERS


def heading(line):
    s = line.strip(STRIP)
    if not visible(s) or marker(s) or bracket_issue(s) or quote_issue(s):
        return False
    end = last(s)
    before = s[: s.rindex(end)]
    neutral = all(c in " -/:." or c.isascii() and c.isalnum() or "０" <= c <= "９" or cjk(c) for c in s)
    mixed = neutral and any(map(cjk, s)) and any(c.isascii() and c.isalnum() or "０" <= c <= "９" for c in s)
    limit = 16 if s.isascii() or mixed else 8
    if end in cs.COLONS and len(s) <= limit and before and all(map(cjk, before)):
        return True
    if end in cs.POSTFIX_CLOSERS and not set(before) & set(cs.COMMAS):
        return True
    if len(s) >= 3 and (s[0], end) in cs.BRACKETS and mostly(s[1:-1].strip(STRIP)):
        return True
    if end in cs.CLAUSE_OR_END or set(s) & set(cs.COMMAS + cs.STRONG_ENDS) or len(s) > limit:
        return False
    return not s.isascii() or all("0" <= c <= "9" for c in s) or any(map(latin, s))


def ellipsis(s):
    t = s.rstrip(WS)
    return mostly(s) and (t.endswith("…") or t.endswith("..."))


def complete(s):
    return bool(visible(s)) and (last(s) in cs.STRONG_ENDS + cs.COLONS or ellipsis(s))


def sentence_end(s):
    v = visible(s)
    if not v:
        return False
    if v[-1] in cs.STRONG_ENDS:
        return True
    if v[-1] in cs.DIALOG_CLOSERS + cs.POSTFIX_CLOSERS and len(v) > 1:
        if v[-2] in cs.STRONG_ENDS or v[-2] == "." and len(v) > 2 and cjk(v[-3]) and mostly(s):
            return True
    return v[-1] == "：" and mostly(s) or ellipsis(s)


def bracket_end(s):
    t = s.strip(WS)
    if len(t) < 2 or (t[0], t[-1]) not in cs.BRACKETS or not mostly(t[1:-1].strip(WS)):
        return False
    return not bracket_issue("".join(c for c in t if c in (t[0], t[-1])))


def segments(text, header):
    out, buffer, dialog = [], "", {}

    def update(s):
        for c in s:
            for a, b in cs.DIALOG_PAIRS:
                if c == a:
                    dialog[a] = dialog.get(a, 0) + 1
                if c == b:
                    dialog[a] = max(0, dialog.get(a, 0) - 1)

    def flush():
        nonlocal buffer
        if buffer:
            out.append(buffer)
            buffer = ""
            dialog.clear()

    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = collapse(raw.rstrip(STRIP))
        left = s.lstrip(STRIP)
        issue, speaking = bracket_issue(buffer), any(dialog.values())
        if not s:
            if header or not buffer or not (speaking or issue or last(buffer) and last(buffer) not in cs.STRONG_ENDS):
                flush()
            continue
        if divider(left):
            flush()
            out.append(left)
            continue
        if marker(s) or title(left) or metadata(left):
            flush()
            out.append(s)
            continue
        if heading(s):
            end = last(buffer)
            goes_on = all(cjk(c) or c in WS for c in s) and any(map(cjk, s)) or last(s) in cs.COLONS + cs.POSTFIX_CLOSERS
            if not buffer or not issue and (not end or end not in cs.COMMAS and not (goes_on and end not in cs.CLAUSE_OR_END)):
                flush()
                out.append(s)
                continue
        is_dialog = bool(visible(s)) and visible(s)[0] in cs.DIALOG_OPENERS
        is_item = list_start(s)
        closes = bool(visible(s)) and last(s) in cs.DIALOG_CLOSERS
        broken = list_bracket_issue(s) if is_item else bracket_issue(s)
        if is_dialog or is_item:
            if is_dialog and closes and not broken and not quote_issue(s):
                flush()
                out.append(s)
                dialog.clear()
                continue
            if is_item and complete(s) and not broken and not quote_issue(s):
                flush()
                out.append(s)
                continue
            if buffer:
                end = last(buffer)
                cut = is_item and list_start(buffer) or bool(end) and end not in cs.COMMAS and not cjk(end) and not speaking and not issue
                if cut:
                    out.append(buffer)  # what is open in the dialog stays open here
                    buffer = ""
            buffer += s
            if is_dialog:
                dialog.clear()
            update(s)
            continue
        if buffer and complete(s) and not closes and not quote_issue(s) and not speaking and (not issue or len(buffer) > 120):
            buffer += s
            flush()
            continue
        if not buffer and complete(s) and not broken and not quote_issue(s):
            out.append(s)
            dialog.clear()
            continue
        if closes:
            before = (visible(s)[-2:-1] or [last(buffer)])[0]
            buffer += s
            update(s)
            if not any(dialog.values()) and before and before in cs.CLAUSE_OR_END and (not issue or broken or len(buffer) > 120):
                flush()
            continue
        if not buffer:
            buffer = s
            dialog.clear()
            update(s)
            continue
        if not speaking and (sentence_end(buffer) and not issue or bracket_end(buffer)):
            flush()
        buffer += s
        update(s)
    if buffer:
        out.append(buffer)
    return out
