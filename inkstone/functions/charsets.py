"""Character sets, word lists and tables that results depend on."""

from __future__ import annotations

# White space: six ASCII characters and 19 others; not U+180E, U+200B or U+FEFF.
WS_CHARS = " \t\n\x0b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_WS_CHARS = " \t\n\x0b\f\r"
STRIP_CHARS = " \t\r\n\u3000"

# Regular-expression classes (the inside of brackets), valid for Java, RE2 and, with regex_class(), Python.
WS = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
LIST_NUMBER = r"0-9\x{FF10}-\x{FF19}\x{4E00}-\x{5341}"
DIVIDER = r"\x{2500}-\x{257F}\-=_~\x{FF5E}\*\x{FF0A}\x{2605}\x{2606}"

CLAUSE_OR_END = "。！？；：…—”」’』）】》〗〕〉］｝＞.!?):?>"
DIALOG_OPENERS = "“‘「『"
DIALOG_CLOSERS = "”’」』"
STRONG_ENDS = "。！？!?"
COMMAS = "，,、"
COLONS = "：:"
POSTFIX_CLOSERS = "）)"
LIST_CLOSERS = ")）、"
BULLETS = "-*＊•‧▪◦○●※"

BRACKETS = (
    ("（", "）"),
    ("(", ")"),
    ("［", "］"),
    ("[", "]"),
    ("｛", "｝"),
    ("{", "}"),
    ("＜", "＞"),
    ("<", ">"),
    ("⟨", "⟩"),
    ("〈", "〉"),
    ("【", "】"),
    ("《", "》"),
    ("〔", "〕"),
    ("〖", "〗"),
)
QUOTES = (("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"))
#: Pairs whose open state a paragraph carries from line to line.
DIALOG_PAIRS = (*QUOTES, ("﹁", "﹂"), ("﹃", "﹄"))

TITLE_WORDS = ("前言", "序章", "终章", "尾声", "后记", "番外", "尾聲", "後記", "楔子")
CHAPTER_MARKERS = "章节部卷節回"
NOT_AFTER_MARKER = "分合的"
NUMERALS = "一二三四五六七八九十"
CHAPTER_END_BRACKETS = "】》〗〕〉」』）］"
SHORT_HEADING = 8
METADATA_SEPARATORS = "：:　"
METADATA_KEYS = (
    "書名", "书名", "作者", "譯者", "译者", "校訂", "校订", "出版社", "出版時間", "出版时间", "出版日期",
    "版權", "版权", "版權頁", "版权页", "版權信息", "版权信息",
    "責任編輯", "责任编辑", "編輯", "编辑", "責編", "责编", "定價", "定价",
    "簡介", "简介", "前言", "序章", "終章", "终章", "尾聲", "尾声", "後記", "后记",
    "品牌方", "出品方", "授權方", "授权方", "電子版權", "数字版权", "掃描", "扫描", "OCR",
    "CIP", "在版編目", "在版编目", "分類號", "分类号", "主題詞", "主题词", "類型", "类型", "系列",
    "發行日", "发行日", "初版", "ISBN",
)

TEXT_EXTENSIONS = tuple(
    "txt md rst html htm xhtml xml json yml yaml ini cfg toml csv tsv c cpp cc cxx h hpp cs java kt kts py rb go rs swift "
    "js mjs cjs ts tsx jsx sh bash zsh ps1 cmd bat gradle cmake make mak ninja tex bib log srt vtt ass ttml2".split()
)
OFFICE_EXTENSIONS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")

#: Conversion configurations, by id from 1.
CONFIGS = ("s2t", "s2tw", "s2twp", "s2hk", "t2s", "t2tw", "t2twp", "t2hk", "tw2s", "tw2sp", "tw2t", "tw2tp", "hk2s", "hk2t", "jp2t", "t2jp")

#: Patterns of font values by document format; the second group is the value.
FONT_PATTERNS = {
    "docx": r'(w:(?:eastAsia|ascii|hAnsi|cs)=")(.*?)(")',
    "xlsx": r'(val=")(.*?)(")',
    "pptx": r'(typeface=")(.*?)(")',
    "odf": r"""((?:style:font-name(?:-asian|-complex)?|svg:font-family|style:name)=['"])([^'"]+)(['"])""",
    "epub": r"""(font-family\s*:\s*)([^;"']+)([;"']?)""",
}
MAX_ENTRY_BYTES = 256 * 1024 * 1024


def escaped(chars: str) -> str:
    """The characters as the inside of a class, for Java, RE2 and Python."""
    return "".join("\\" + c if c in r"\]^-[&~" else c for c in dict.fromkeys(chars))


def python_class(inside: str) -> str:
    """The inside of a class in Python's notation."""
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].zfill(8), inside)
