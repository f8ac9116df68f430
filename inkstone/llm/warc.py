"""WARC archives: writing segmented, chunk-framed records, and reading them back with segment reassembly.

Writing: a page's payload is framed in HTTP chunks behind a response head; a block longer than SEGMENT bytes goes out as
one `response` record (segment 1) and `continuation` records that name its id. Of equal payloads of at least
MIN_REVISIT bytes, the page with the smallest id is the response and the others are `revisit` records without a block. Files are
written by Spark's text writer: the line separator CR LF CR LF is what ends a WARC record.
Reading: files are parsed record by record by Content-Length; continuation records are grouped by their origin's id, ordered by
segment number, checked against the total length, and the chunk framing is decoded. Only segmented blocks are shuffled.
Revisits find their response by record id; ids with over 1/1024 of the revisits are joined by broadcast.

Defined cases: null html is an empty payload and null url a `urn:` target; empty and short payloads are always responses; a null page_id
is a response of its own and comes back null; rows that repeat a page_id and its payload come back as often as they went in, as
responses if that id is the smallest; a record whose segments or digest do not agree comes back with intact = false and
no payload; a very long payload is written in segments, whole; of equal payloads the smallest page_id is the response, nulls apart; an
empty table gives no rows; other columns are not read. An archive is read as one row, so files may have 2 GB at most.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._store import bound_arrow_batches, broadcast_if_small, join_hot, materialise, scratch_path

SEGMENT = 32 << 10
CHUNK = 4 << 10
MIN_REVISIT = 100
#: Segments bound a record to SEGMENT bytes and its header, so a file holds about 33 MB before compression, whatever the pages' sizes.
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _record_id(page, digest):
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one logical record per page into gzip-compressed WARC files under path."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")))).alias("url"),
        html.cast("binary").alias("payload"),
        F.sha2(html, 256).alias("digest"),
    )
    size = F.octet_length("payload")
    classes = base.where(size >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = materialise(classes, "payloads")
    n = classes.count()
    if broadcast_if_small(classes, n, 128) is classes:
        marked = join_hot(base, classes, "digest", "n", base.count())
    else:
        marked = base.join(F.broadcast(classes.drop("n")), "digest", "left")
    revisit = F.coalesce((size >= MIN_REVISIT) & (F.col("page_id") > F.col("first")), F.lit(False))
    framed = F.array_join(
        F.transform(
            F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat(
                F.lower(F.hex(F.least(F.lit(CHUNK), size - i * CHUNK))).cast("binary"), F.lit(b"\r\n"),
                F.substring(F.col("payload"), i * CHUNK + 1, F.lit(CHUNK)), F.lit(b"\r\n"),
            ).cast("string"),
        ),
        "",
    )
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(F.lit(_HEAD), framed, F.lit("0\r\n\r\n"))).cast("binary")
    rows = marked.withColumn("revisit", revisit).withColumn("block", block).withColumn("total", F.octet_length("block"))
    last = F.greatest(F.lit(0), F.floor((F.col("total") - 1) / SEGMENT)).cast("int")
    rows = rows.select(
        "page_id", "url", "digest", "first", "revisit", "total", last.alias("last"),
        F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("block"), i * SEGMENT + 1, F.lit(SEGMENT)))).alias("k", "part"),
    )
    own = _record_id(F.col("page_id"), F.col("digest"))
    go_on = F.col("k") > 0

    def line(name: str, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(go_on, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", own, ~go_on),
        line("WARC-Record-ID", F.concat(F.regexp_replace(own, ">$", ""), F.lit("-"), F.col("k") + 1, F.lit(">")), go_on),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("X-Page-ID", F.col("page_id"), ~go_on),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), ~go_on),
        line("Content-Type", F.lit("application/http; msgtype=response"), ~go_on),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("revisit")),
        line("WARC-Refers-To", _record_id(F.col("first"), F.col("digest")), F.col("revisit")),
        line("WARC-Segment-Number", F.col("k") + 1, F.col("last") > 0),
        line("WARC-Segment-Origin-ID", own, go_on),
        line("WARC-Segment-Total-Length", F.col("total"), go_on & (F.col("k") == F.col("last"))),
        line("Content-Length", F.octet_length("part")),
        F.lit("\r\n"),
    )
    value = F.concat(head, F.col("part").cast("string"))
    rows.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELDS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "X-Page-ID": "page_id", "WARC-Payload-Digest": "declared", "WARC-Refers-To": "refers_id", "WARC-Segment-Number": "segment", "WARC-Segment-Origin-ID": "origin_id", "WARC-Segment-Total-Length": "total", "WARC-Target-URI": "url"}
_RECORDS = ", ".join(f"{x} {'long' if x in ('page_id', 'segment', 'total') else 'string'}" for x in _FIELDS.values()) + ", block binary"


def parse_records(stream) -> Iterator[dict]:
    """The records of a WARC stream, one at a time; a block is read by its Content-Length."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one must begin: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        block = stream.read(int(fields.get("Content-Length", 0)))
        row = {v: fields.get(k) for k, v in _FIELDS.items()}
        for k in ("page_id", "segment", "total"):
            row[k] = int(row[k]) if row[k] is not None else None
        row["declared"] = row["declared"].removeprefix("sha256:") if row["declared"] else None
        yield row | {"block": block}


def dechunk(block: bytes) -> bytes | None:
    """The payload of an HTTP response block in chunked transfer framing; None if the framing is broken."""
    at = block.find(b"\r\n\r\n")
    if at < 0:
        return None
    head, at, out = block[:at].lower(), at + 4, []
    if b"transfer-encoding: chunked" not in head:
        return block[at:]
    while True:
        end = block.find(b"\r\n", at)
        try:
            n = int(block[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 4 + n > len(block):
            return None
        if n == 0:
            return b"".join(out)
        out.append(block[end + 2 : end + 2 + n])
        if block[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: page_id, record_type, record_id, url, refers_id, payload, payload_bytes, payload_digest, intact.

    A revisit has no payload here; resolve_revisits() adds what its response has.
    """
    bound_arrow_batches(spark)
    names = [*_FIELDS.values(), "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "block" else pa.int64() if n in ("page_id", "segment", "total") else pa.string()) for n in names])
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                data = raw.as_buffer()
                for row in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(data))) if bytes(data[:2]) == b"\x1f\x8b" else io.BytesIO(data)):
                    rows.append(row)
                    held += len(row["block"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORDS)

    @pandas_udf("binary")
    def decode(blocks: pd.Series) -> pd.Series:
        return pd.Series([dechunk(x) if x is not None else None for x in blocks], dtype=object)

    whole = records.where("segment is null").select("page_id", "record_type", "record_id", "url", "refers_id", "declared", "block", F.lit(True).alias("complete"))
    parts = records.where("segment is not null").withColumn("key", F.coalesce("origin_id", "record_id"))
    joined = parts.groupBy("key").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"), F.max(F.when(F.col("segment") == 1, F.col("url"))).alias("url"),
        F.max("refers_id").alias("refers_id"), F.max("declared").alias("declared"), F.max("total").alias("total"),
        F.sum(F.when(F.col("segment") == 1, 1)).alias("times"), F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("p"),
    )
    block = F.array_join(F.transform("p", lambda x: x["block"].cast("string")), "").cast("binary")
    ordered = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["segment"] == i)
    complete = F.coalesce(ordered & (F.octet_length(block) == F.col("total")), F.lit(False))
    rebuilt = joined.select("page_id", "record_type", F.col("key").alias("record_id"), "url", "refers_id", "declared", block.alias("block"), complete.alias("complete"), F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times"), F.lit(1)).cast("int"))).alias("copy")).drop("copy")
    rows = whole.unionByName(rebuilt)
    rows = rows.withColumn("payload", decode(F.when(F.col("complete") & (F.col("record_type") == "response"), F.col("block")))).drop("block")
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    intact = (F.col("record_type") == "revisit") | F.coalesce(F.col("complete") & (F.col("payload_digest") == F.col("declared")), F.lit(False))
    return rows.withColumn("intact", intact).withColumn("payload", F.when(F.col("intact"), F.col("payload"))).drop("complete")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes and payload_digest; a revisit's come from the response that it names."""
    kept = materialise(records.select("page_id", "record_type", "record_id", "refers_id", "payload_bytes", "payload_digest"), "records")
    own = kept.where("record_type <> 'revisit'").select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    again = kept.where("record_type = 'revisit'").select("page_id", "record_type", "refers_id")
    named = again.groupBy("refers_id").agg(F.count(F.lit(1)).alias("n"))
    said = kept.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(named, "refers_id").dropDuplicates(["refers_id"])
    found = join_hot(again, said, "refers_id", "n", again.count())
    return own.unionByName(found.select(*own.columns))


def op3_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Query: all pages written to WARC archives in the shared folder and read back."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = resolve_revisits(read_warc(spark, path))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id > f.first THEN f.first END AS refers_to
FROM p JOIN f USING (html)
"""
