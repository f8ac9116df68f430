"""Pages of documents: assembly of page texts in order, progress, and the way from pages to converted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .reflow import reflow


def assemble_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", header: bool = True) -> DataFrame:
    """(doc, n_pages, text): each page's trimmed text and a blank line, behind `=== [Page i/N] ===` if headers are on.

    One shuffle by document; a document's pages meet in one row, as the result demands.
    """
    body = tx.trim_ascii(tx.normalize_newlines(F.coalesce(F.col(text), F.lit(""))))
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), body.alias("t")))).alias("p"))

    def entry(x: Column, i: Column) -> Column:
        head = F.concat(F.lit("=== [Page "), i + 1, F.lit("/"), F.size("p"), F.lit("] ===\n\n")) if header else F.lit("")
        return F.concat(head, x["t"], F.lit("\n\n"))

    return rows.select(doc, F.size("p").alias("n_pages"), F.array_join(F.transform("p", entry), "").alias(text))


def progress_bar(percent: Column, width: int = 10) -> Column:
    filled = F.floor(F.least(F.greatest(percent, F.lit(0)), F.lit(100)) * width / 100).cast("int")
    return F.concat(F.repeat(F.lit("🟩"), filled), F.repeat(F.lit("⬜"), F.lit(width) - filled))


def page_progress(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """(doc, page, percent, bar) after each page of a document."""
    w = Window.partitionBy(doc)
    percent = F.floor(F.row_number().over(w.orderBy(page)) / F.count(F.lit(1)).over(w) * 100).cast("int")
    return pages.select(doc, page, percent.alias("percent")).withColumn("bar", progress_bar(F.col("percent")))


def extract_documents(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text", header: bool = False, auto_reflow: bool = True, compact: bool = False, convert: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pages to document text: assembled, reflowed if asked for, converted if a conversion is given. Adds a status: done or empty."""
    out = assemble_pages(pages, doc, page, text, header)
    body = F.col(text)
    blank = tx.trim_ascii(body) == ""
    if auto_reflow:
        body = reflow(body, header, compact)
    if convert:
        body = convert(body)
    return out.select(doc, "n_pages", F.when(blank, F.lit("")).otherwise(body).alias(text), F.when(blank, F.lit("empty")).otherwise(F.lit("done")).alias("status"))
