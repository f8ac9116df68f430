"""Office and EPUB archives: entries as rows, choice of the text entries, font masking, conversion, and archives again."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs

ENTRY = "ord int, name string, is_dir boolean, data binary"


def is_safe_name(name: Column) -> Column:
    """No empty or absolute names, NUL, backslashes or steps up."""
    return (name != "") & ~name.rlike(r"^/|\\|\x00|\.\./|/\.\.")


def is_shared_strings(name: Column) -> Column:
    return name == "xl/sharedStrings.xml"


def is_worksheet(name: Column) -> Column:
    return F.startswith(name, F.lit("xl/worksheets/")) & F.endswith(name, F.lit(".xml"))


def is_target(fmt: Column, name: Column, is_dir: Column) -> Column:
    """Whether an entry of an archive of that format is converted."""
    slide = F.startswith(name, F.lit("ppt/")) & F.endswith(name, F.lit(".xml")) & name.rlike("slides/slide|notesSlides/notesSlide")
    return ~is_dir & (
        F.when(fmt == "docx", name == "word/document.xml")
        .when(fmt == "xlsx", is_shared_strings(name) | is_worksheet(name))
        .when(fmt == "pptx", slide)
        .when(fmt.isin("odt", "ods", "odp"), name == "content.xml")
        .when(fmt == "epub", F.lower(name).rlike(r"\.(?:xhtml|html|opf|ncx)$"))
        .otherwise(F.lit(False))
    )


def masks_fonts(fmt: Column, name: Column) -> Column:
    return (fmt != "xlsx") | is_shared_strings(name)


def font_pattern(fmt: str) -> str | None:
    return cs.FONT_PATTERNS.get("odf" if fmt in ("odt", "ods", "odp") else fmt)


def mask_fonts(xml: Column, fmt: str) -> Column:
    """struct(masked, fonts): the k-th font value replaced by a marker, and the values in order."""
    pattern = font_pattern(fmt)
    if pattern is None:
        return F.struct(xml.alias("masked"), F.array().cast("array<string>").alias("fonts"))
    # what lies between the matches, with each match's own edges
    between = F.split(F.regexp_replace(xml, f"(?d){pattern}", "$1\u0001$3"), "\u0001", -1)
    fonts = F.regexp_extract_all(xml, F.lit(f"(?d){pattern}"), F.lit(2))
    marked = F.transform(between, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit("__F_O_N_T_"), i - 1, F.lit("__"), part)))
    return F.struct(F.array_join(marked, "").alias("masked"), fonts.alias("fonts"))


def unmask_fonts(xml: Column, fonts: Column) -> Column:
    """Markers back to the original values; later markers first, so that no marker is part of another."""
    order = F.sequence(F.lit(0), F.size(fonts) - 1)
    return F.when(F.size(fonts) == 0, xml).otherwise(
        F.aggregate(order, xml, lambda acc, i: F.replace(acc, F.concat(F.lit("__F_O_N_T_"), i, F.lit("__")), F.element_at(fonts, i + 1)))
    )


_CELL = re.compile(r"<c\b[^>]*>[\s\S]*?</c>")
_TEXT_NODE = re.compile(r"(<t\b[^>]*>)([\s\S]*?)(</t>)")


def convert_inline_strings(xml: str, convert: Callable[[str], str]) -> str:
    """Converts the text nodes of a worksheet's inline-string cells; a cell ends at the next closing tag, whatever opened it."""

    def cell(m: re.Match) -> str:
        opening = m[0].partition(">")[0]
        if 't="inlineStr"' not in opening and "t='inlineStr'" not in opening:
            return m[0]
        return _TEXT_NODE.sub(lambda t: t[1] + convert(t[2]) + t[3] if t[2] else t[0], m[0])

    return _CELL.sub(cell, xml)


def read_entries(content: bytes, strict: bool = True) -> list[dict]:
    """The entries of a zip archive in its order; unsafe names are left out, too large or unreadable ones are kept empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i, info in enumerate(z.infolist()):
            name = info.filename.replace("\\", "/") if strict else info.filename
            if not name or name.startswith("/") or "\0" in name or "\\" in name or "../" in name or "/.." in name:
                continue
            data = b""
            if not info.is_dir() and not (strict and info.file_size > cs.MAX_ENTRY_BYTES):
                try:
                    data = z.read(info)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    data = b""
            out.append({"ord": i, "name": name, "is_dir": info.is_dir(), "data": data})
    return out


def write_entries(entries: list[dict], fmt: str, keep_dirs: bool = False, require_mimetype: bool = True) -> bytes:
    """A zip archive of the entries; an EPUB's `mimetype` comes first and uncompressed."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        rows = sorted(entries, key=lambda e: e["ord"])
        if fmt == "epub":
            head = [e for e in rows if e["name"] == "mimetype"]
            if require_mimetype and not head:
                raise ValueError("'mimetype' file is missing. EPUB requires this.")
            for e in head[:1]:
                z.writestr(zipfile.ZipInfo("mimetype"), e["data"], zipfile.ZIP_STORED)
            rows = [e for e in rows if e["name"] != "mimetype"]
        for e in rows:
            if e["is_dir"]:
                if keep_dirs:
                    z.writestr(zipfile.ZipInfo(e["name"].rstrip("/") + "/"), b"")
                continue
            z.writestr(zipfile.ZipInfo(e["name"]), bytes(e["data"]), zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def explode_archives(files: DataFrame, id_col: str = "archive_id", fmt_col: str = "format", content_col: str = "content", strict: bool = True) -> DataFrame:
    """One row per entry: archive_id, format, ord, name, is_dir, data, and error (one row with ord -1) where an archive can't be read."""
    source = files.select(F.col(id_col).cast("long").alias("archive_id"), F.lower(fmt_col).alias("format"), F.col(content_col).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, fmt, content in frame.itertuples(index=False):
                try:
                    rows = [(archive, fmt, e["ord"], e["name"], e["is_dir"], e["data"], None) for e in read_entries(content, strict)]
                except (zipfile.BadZipFile, TypeError):
                    rows = [(archive, fmt, -1, None, False, None, "Failed to open ZIP archive.")]
                yield pd.DataFrame(rows, columns=["archive_id", "format", "ord", "name", "is_dir", "data", "error"])

    return source.mapInPandas(run, f"archive_id long, format string, {ENTRY}, error string")


def convert_entry(xml: str, fmt: str, name: str, convert: Callable[[str], str], keep_font: bool = True) -> str:
    """A target entry's XML converted, with font values kept as they were."""
    if fmt == "xlsx" and name.startswith("xl/worksheets/"):
        return convert_inline_strings(xml, convert)
    fonts: list[str] = []
    pattern = font_pattern(fmt) if keep_font else None
    if pattern:

        def mask(m: re.Match) -> str:
            fonts.append(m[2])
            return f"{m[1]}__F_O_N_T_{len(fonts) - 1}__{m[3]}"

        xml = re.sub(pattern, mask, xml)
    xml = convert(xml)
    for k, value in enumerate(fonts):
        xml = xml.replace(f"__F_O_N_T_{k}__", value)
    return xml


def convert_archives(files: DataFrame, convert: Callable[[str], str], id_col: str = "archive_id", fmt_col: str = "format", content_col: str = "content", keep_font: bool = True, keep_dirs: bool = False, require_mimetype: bool = True) -> DataFrame:
    """One row per archive: archive_id, format, success, message, fragments and content (the new archive).

    Row-local: an archive is opened, converted and closed in one task, since it is one cell before and after.
    """
    source = files.select(F.col(id_col).cast("long").alias("archive_id"), F.lower(fmt_col).alias("format"), F.col(content_col).alias("content"))
    targets = {
        "docx": lambda n: n == "word/document.xml",
        "xlsx": lambda n: n == "xl/sharedStrings.xml" or (n.startswith("xl/worksheets/") and n.endswith(".xml")),
        "pptx": lambda n: n.startswith("ppt/") and n.endswith(".xml") and ("slides/slide" in n or "notesSlides/notesSlide" in n),
        "epub": lambda n: n.lower().endswith((".xhtml", ".html", ".opf", ".ncx")),
    } | dict.fromkeys(("odt", "ods", "odp"), lambda n: n == "content.xml")

    def one(fmt: str, content: bytes) -> tuple:
        try:
            entries = read_entries(content)
        except (zipfile.BadZipFile, TypeError):
            return False, "❌ Failed to open ZIP archive.", 0, None
        chosen = [e for e in entries if not e["is_dir"] and targets.get(fmt, lambda n: False)(e["name"])]
        if not chosen:
            return False, f"❌ No valid XML fragments were found. Is the format '{fmt}' correct?", 0, None
        for e in chosen:
            e["data"] = convert_entry(e["data"].decode("utf-8", "replace"), fmt, e["name"], convert, keep_font).encode()
        try:
            return True, f"✅ Successfully converted {len(chosen)} fragment(s) in {fmt} document.", len(chosen), write_entries(entries, fmt, keep_dirs, require_mimetype)
        except ValueError as e:
            return False, f"❌ {e}", len(chosen), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(a, f, *one(f, c)) for a, f, c in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["archive_id", "format", "success", "message", "fragments", "content"])

    return source.mapInPandas(run, "archive_id long, format string, success boolean, message string, fragments int, content binary")
