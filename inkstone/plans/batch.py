"""Batch conversion: a list of files becomes a plan (route, output, status) and then a log, without a driver loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..operators import archive as ar
from ..operators.pages import extract_documents
from ..sources import files as fs
from ..sources import sink


@dataclass(frozen=True)
class Job:
    """Options of a batch run."""

    config: str = "s2t"
    out_dir: str = "./output"
    punctuation: bool = True
    convert_filename: bool = False
    page_header: bool = False
    auto_reflow: bool = True
    compact: bool = False


MESSAGES = {
    "not_found": "❌ File not found.",
    "same_path": "❌ Skip: Output Path = Source Path.",
    "unsupported": "❌ Skip: Unsupported file type.",
    "read_error": "❌ Error opening for read.",
    "write_error": "❌ Error opening for write.",
    "empty": "❌ Empty or non-text PDF.",
    "cancelled": "Batch cancelled.",
    "done_no_ext": "✅ Done (treated as text: no extension).",
    "done": "✅ Done.",
}


def output_path(out_dir: str, base: Column, config: str, ext: Column) -> Column:
    return F.concat(F.lit(f"{out_dir}/"), base, F.lit(f"_{config}"), F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext)))


def pdf_output_path(out_dir: str, base: Column, config: str) -> Column:
    return F.concat(F.lit(f"{out_dir}/"), base, F.lit(f"_{config}.txt"))


def plan(files: DataFrame, job: Job, convert: Callable[[Column], Column] | None = None) -> DataFrame:
    """ord, path, exists → route, out_path, status and `wins` (of files with the same output, the last one).

    `convert` is for the files' names: a converter that leaves punctuation alone. Status: not_found, unsupported, same_path (PDFs excepted) or ready.
    """
    config = job.config if job.config in cs.CONFIGS else "s2t"
    base, ext = fs.base_name(F.col("path")), fs.extension(F.col("path"))
    if job.convert_filename and convert:
        base = convert(base)
    rows = files.select("ord", "path", F.coalesce("exists", F.lit(True)).alias("exists"), base.alias("base"), ext.alias("ext"))
    rows = rows.withColumn("route", fs.route(F.col("ext")))
    rows = rows.withColumn("out_path", F.when(F.col("route") == "pdf", pdf_output_path(job.out_dir, F.col("base"), config)).when(F.col("route") != "unsupported", output_path(job.out_dir, F.col("base"), config, F.col("ext"))))
    same = (F.col("route") != "pdf") & (F.col("path") == F.col("out_path"))
    rows = rows.withColumn("status", F.when(~F.col("exists"), F.lit("not_found")).when(F.col("route") == "unsupported", F.lit("unsupported")).when(same, F.lit("same_path")).otherwise(F.lit("ready")))
    # an aggregate and a join, so that ten thousand files of one name do not meet in one task
    last = rows.where("status = 'ready'").groupBy(F.col("out_path").alias("written")).agg(F.max("ord").alias("last"))
    wins = (F.col("status") == "ready") & (F.col("ord") == F.col("last"))
    return rows.join(last, rows["out_path"] == last["written"], "left").select(*rows.columns, F.coalesce(wins, F.lit(False)).alias("wins"))


def log_lines(rows: DataFrame) -> DataFrame:
    """ord (from 0), status and the log line of planned or finished rows."""
    shown = F.when(F.col("status").isin("not_found", "unsupported", "read_error", "empty"), F.col("path")).otherwise(F.col("out_path"))
    said = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    status = F.when((F.col("status").isin("ready", "done")) & (F.col("route") == "text") & (F.col("ext") == ""), F.lit("done_no_ext")).when(F.col("status") == "ready", F.lit("done")).otherwise(F.col("status"))
    rows = rows.withColumn("_status", status)
    return rows.select("ord", F.col("_status").alias("status"), F.concat((F.col("ord") + 1).cast("string"), F.lit(": "), shown, F.lit(" -> "), said[F.col("_status")]).alias("line"))


#: List entries that one task numbers, about.
_RANGE = 1 << 16


def numbered(rows: DataFrame) -> DataFrame:
    """pos from 0 and path, in order of zone and k (a whole number): ranks in ranges of k, and where each range begins."""
    split = rows.withColumn("part", F.floor(F.col("k") / _RANGE))
    sizes = split.groupBy("zone", "part").agg(F.count(F.lit(1)).alias("c"))
    # one row with a number for each range, of which there are as many as the list has times _RANGE entries
    all_ = sizes.agg(F.array_sort(F.collect_list(F.struct("zone", "part", "c"))).alias("x"))
    begun = all_.select(F.explode(F.transform("x", lambda r, i: F.struct(r["zone"].alias("zone"), r["part"].alias("part"), F.aggregate(F.slice("x", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("before")))).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("zone", "part").orderBy("k", "path")) - 1
    return split.withColumn("rank", rank).join(begun, ["zone", "part"]).select((F.col("before") + F.col("rank")).cast("int").alias("pos"), "path")


def ordered_list(current: DataFrame, added: DataFrame) -> DataFrame:
    """A file list after files were added: unseen paths only; new PDFs go behind the last file that is none, others to the end.

    current: pos, path; added: ord, path, is_pdf (by content). Returns pos, path.
    """
    fresh = added.join(current.select("path"), "path", "left_anti").groupBy("path").agg(F.min("ord").alias("ord"), F.min_by("is_pdf", "ord").alias("is_pdf"))
    anchor = current.agg(F.coalesce(F.max(F.when(~F.lower("path").endswith(".pdf"), F.col("pos"))), F.when(F.count(F.lit(1)) == 0, F.lit(-1)).otherwise(F.max("pos"))).alias("anchor"))
    old = current.crossJoin(F.broadcast(anchor)).select("path", F.when(F.col("pos") <= F.col("anchor"), F.lit(0)).otherwise(F.lit(2)).alias("zone"), F.col("pos").cast("long").alias("k"))
    new = fresh.select("path", F.when(F.col("is_pdf"), F.lit(1)).otherwise(F.lit(3)).alias("zone"), F.col("ord").cast("long").alias("k"))
    return numbered(old.unionByName(new))


def run_batch(files: DataFrame, job: Job, convert: Callable[[Column], Column], convert_text: Callable[[str], str], pdf_decoder: Callable[[bytes], list[str]] | None = None, convert_name: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, log) of a batch: files is ord, path, content (NULL where the file is missing).

    convert_name is for file names, which keep their punctuation; without it, names stay as they are.

    results: ord, path, out_path, data; log: ord, status, line. The three routes are separate branches of one plan, each of which
    reads only its own rows.
    """
    planned = plan(files.select("ord", "path", F.col("content").isNotNull().alias("exists")), job, convert_name)
    ready = planned.where("wins").select("ord", "path", "base", "ext", "route", "out_path").join(files.select("ord", "content"), "ord")

    text = tx.normalize_newlines(tx.decode_lenient(F.col("content")))
    texts = ready.where("route = 'text'").select("ord", "path", "out_path", convert(text).cast("binary").alias("data"), F.lit("done").alias("status"))
    office = ar.convert_archives(ready.where("route = 'office'").select(F.col("ord").alias("archive_id"), F.col("ext").alias("format"), "content"), convert_text)
    offices = ready.where("route = 'office'").select("ord", "path", "out_path").join(office.select(F.col("archive_id").alias("ord"), F.col("content").alias("data"), F.when(F.col("success"), F.lit("done")).otherwise(F.lit("read_error")).alias("status")), "ord")
    out = texts.unionByName(offices)
    if pdf_decoder:
        pages = fs.decode_pdfs(ready.where("route = 'pdf'"), pdf_decoder, "ord").where("error is null").select(F.col("ord").alias("doc_id"), "page_no", "text")
        docs = extract_documents(pages, header=job.page_header, auto_reflow=job.auto_reflow, compact=job.compact, convert=convert)
        pdfs = ready.where("route = 'pdf'").select("ord", "path", "out_path").join(docs.select(F.col("doc_id").alias("ord"), F.col("text").cast("binary").alias("data"), F.col("status").alias("s")), "ord", "left")
        out = out.unionByName(pdfs.select("ord", "path", "out_path", "data", F.coalesce("s", F.lit("empty")).alias("status")))
    finished = planned.drop("status").join(out.select("ord", F.col("status").alias("done")), "ord", "left").join(planned.select("ord", "status"), "ord")
    finished = finished.withColumn("status", F.coalesce("done", "status"))
    return out.where("status = 'done'").drop("status"), log_lines(finished)


def save_batch(results: DataFrame, log: DataFrame, staging: str) -> tuple[DataFrame, DataFrame]:
    """Writes the results of a batch by one commit: (log, progress).

    A file that can't be written has the status write_error in the log, whatever was planned for it; rows whose output another row of the list
    overwrites keep theirs. progress: status, n, total, one row per status, whose n add up to the log's rows. Calling it again after a failure
    goes on with the batch that was staged.
    """
    spark = results.sparkSession
    written = sink.save_files(results, staging, order_col="ord")
    failed = results.select("ord", "out_path").join(written.where("status = 'write_error'").select(F.col("path").alias("out_path")), "out_path").select("ord", "out_path")
    marked = log.join(failed, "ord", "left")
    line = F.concat((F.col("ord") + 1).cast("string"), F.lit(": "), F.col("out_path"), F.lit(f" -> {MESSAGES['write_error']}"))
    told = marked.select("ord", F.when(F.col("out_path").isNotNull(), F.lit("write_error")).otherwise(F.col("status")).alias("status"), F.when(F.col("out_path").isNotNull(), line).otherwise(F.col("line")).alias("line"))
    # written, so that texts are not converted once more for each look at the log
    told.write.mode("overwrite").parquet(f"{staging}/told")
    told = spark.read.parquet(f"{staging}/told")
    return told, told.groupBy("status").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(told.agg(F.count(F.lit(1)).alias("total"))))


def append_list(current: DataFrame, added: DataFrame) -> DataFrame:
    """A file list after a drop: unseen paths at the end, in their order. current: pos, path; added: ord, path."""
    fresh = added.join(current.select("path"), "path", "left_anti").groupBy("path").agg(F.min("ord").cast("long").alias("k"))
    both = current.select("path", F.lit(0).alias("zone"), F.col("pos").cast("long").alias("k")).unionByName(fresh.select("path", F.lit(1).alias("zone"), "k"))
    return numbered(both)


def remove_from_list(current: DataFrame, removed: DataFrame) -> DataFrame:
    """A file list without the given paths, numbered anew."""
    return numbered(current.join(removed.select("path"), "path", "left_anti").select("path", F.lit(0).alias("zone"), F.col("pos").cast("long").alias("k")))


def convert_selection(t: Column, start: int, length: int | None, convert: Callable[[Column], Column]) -> Column:
    """Converts a span of the text (start from 0), or the whole if there is no span; blank text stays as it is."""
    if length is None:
        return F.when(tx.trim_ws(t) == "", t).otherwise(convert(t))
    return F.concat(F.left(t, F.lit(start)), convert(F.substring(t, F.lit(start + 1), F.lit(length))), F.substring(t, F.lit(start + length + 1), F.length(t)))


def preview(files: DataFrame, limit: int = 1) -> DataFrame:
    """(path, text) of the first files, by `ord` if there is one, else by path; those that are not text-like say so."""
    text = tx.normalize_newlines(tx.decode_lenient(F.col("content")))
    return files.orderBy("ord" if "ord" in files.columns else "path").limit(limit).select("path", F.when(fs.is_text_like(fs.extension(F.col("path"))), text).otherwise(F.lit("Not a valid text file.")).alias("text"))
