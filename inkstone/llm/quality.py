"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks, within limits for each length.

Repetitive text compresses far better than prose of its length, random text far worse; the limits depend on the length
because short inputs cannot compress well. Row-local: one pass over the texts, no shuffle.

Defined cases: null and empty text have no words, fail the base rules and have null ratios; a very long text is one row
and is measured whole; repeated rows are measured each on its own; a ratio equal to a limit is within it; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._bytes import SPACED, blocks, grams, mix, rows_of
from ._store import bound_arrow_batches

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Limits for texts (or chunks) of up to `upto` bytes: rejected below `low` or above `high`; above `wide` if most bytes are not ASCII."""

    upto: float
    low: float
    high: float
    wide: float


@dataclass(frozen=True)
class Limits:
    """Production limits. Ratios are compressed / raw bytes at `level`, without frame headers' content size or checksum.

    The limits lie between measured ratios. Documents labelled good in sf0.1 give 1.31 and more up to 30 bytes, 1.15 and more up to 60, 0.75 and more up to
    120, 0.63 to 0.92 up to 160, 0.57 to 0.82 up to 200 (a short frame's own bytes weigh much, so no high limit parts random text there); a phrase of 20
    bytes over and over gives 0.60 at 60 bytes, 0.41 at 90, 0.31 at 120, 0.19 at 199. Longer good ones give 0.58 to 0.82 at 200 to 400 bytes, 0.51 to 0.71 up to 1000, 0.46 to 0.58 up to 2000, 0.45 to 0.52 up to
    4000, 0.40 to 0.47 beyond, and their chunks 0.44 to 0.48. A passage of 120 bytes over and over gives 0.32 at 300 bytes and
    0.14 or less from 700; one of 400 bytes 0.37 at 700, 0.17 at 1500 and less beyond. Base64 gives 0.92, 0.82, 0.78, 0.76, 0.75; random lower-case letters
    0.65 at 700 bytes, 0.62 at 1500, 0.61 to 0.58 beyond. Under 1000 bytes random letters are no denser than good prose, so no limit can part them.
    Scripts of several bytes a character carry more in each than Latin ones; for them the high limits are loose.
    """

    level: int = 3
    chunk_bytes: int = 4096
    chunk_tail: int = 200
    repetitive_chunks: float = 0.5
    incompressible_chunks: float = 0.5
    whole: tuple[Band, ...] = (Band(30, 0.9, 9, 9), Band(60, 0.8, 9, 9), Band(120, 0.5, 9, 9), Band(160, 0.43, 0.99, 0.99), Band(200, 0.40, 0.95, 0.97), Band(400, 0.34, 0.87, 0.90), Band(1000, 0.38, 0.73, 0.90), Band(2000, 0.32, 0.61, 0.82), Band(4000, 0.29, 0.57, 0.82), Band(16000, 0.27, 0.57, 0.78), Band(float("inf"), 0.23, 0.57, 0.75))
    chunk: Band = Band(float("inf"), 0.27, 0.57, 0.80)
    min_words: int = 10
    max_repeat_percent: int = 20


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, low_chunks double, high_chunks double, reason string"


def _base(block) -> tuple[np.ndarray, ...]:
    inside = SPACED[block.data]
    starts, ends, first = block.spans(SPACED)
    n_words = np.diff(first)
    word_chars = block.sums(inside & ((block.data & 0xC0) != 0x80))
    n_symbols = block.sums(_SYMBOLS[block.data])

    l_starts, l_ends, l_first = block.lines()
    total = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    wordy = np.flatnonzero(total[l_ends] > total[l_starts])
    row = rows_of(l_first)[wordy]
    h = mix(block.hashes(l_starts[wordy], l_ends[wordy]) + row.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1]) + 1
    n_dup = np.bincount(row[order[same]], minlength=block.rows)

    words = block.hashes(starts, ends)
    g, at = grams(words, first, 5)
    g = mix(g + rows_of(first)[at].astype(np.uint64)) if len(g) else g
    order = np.argsort(g)
    s = g[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    begin = np.zeros(len(words) + 5, np.int64)
    begin[at[order[twin]]] = 1
    run = np.cumsum(begin)
    run[5:] -= run[:-5].copy()
    hit = np.concatenate([[0], np.cumsum(run[: len(words)] > 0)])
    n_repeat = hit[first[1:]] - hit[first[:-1]]
    return n_words, word_chars, n_symbols, n_dup, n_repeat


def _measure(raw: bytes, limits: Limits, packer: zstandard.ZstdCompressor) -> tuple[float | None, float | None, float | None, str | None]:
    """Ratio of the whole, shares of chunks under and over the chunk limits, and why it is rejected, if it is."""
    if not raw:
        return None, None, None, None
    ratio = len(packer.compress(raw)) / len(raw)
    band = next(b for b in limits.whole if len(raw) <= b.upto)
    wide = 2 * np.count_nonzero(np.frombuffer(raw, np.uint8) > 127) > len(raw)
    low = high = n = 0
    if len(raw) > limits.chunk_bytes:
        for a in range(0, len(raw), limits.chunk_bytes):
            part = raw[a : a + limits.chunk_bytes]
            if len(part) < limits.chunk_tail:
                break
            # a tail is measured on its own, by the limits for its length
            own = limits.chunk if len(part) == limits.chunk_bytes else next(b for b in limits.whole if len(part) <= b.upto)
            r = len(packer.compress(part)) / len(part)
            low += r < own.low
            high += r > (own.wide if wide else own.high)
            n += 1
    low, high = low / max(n, 1), high / max(n, 1)
    why = "repetitive" if ratio < band.low else "incompressible" if ratio > (band.wide if wide else band.high) else None
    if why is None and low > limits.repetitive_chunks:
        why = "repetitive chunks"
    if why is None and high > limits.incompressible_chunks:
        why = "incompressible chunks"
    return ratio, low, high, why


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: base counts, the base verdict, compression ratios and the final verdict `kept`."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=limits.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for block in blocks(text):
                n_words, word_chars, n_symbols, n_dup, n_repeat = _base(block)
                failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_percent * n_words)
                raw = block.data.tobytes()
                more = [_measure(raw[a:b], limits, packer) for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)]
                kept = [not f and m[3] is None for f, m in zip(failed.tolist(), more, strict=True)]
                why = ["base rules" if f else m[3] for f, m in zip(failed.tolist(), more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, block.rows), *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)), pa.array(failed), pa.array(kept), *(pa.array([m[i] for m in more], pa.float64()) for i in range(3)), pa.array(why, pa.string())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: the quality rules over all documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_accepted(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Only the documents that quality_rules accepts, all columns unchanged; row-local, no shuffle."""

    @pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        packer = zstandard.ZstdCompressor(level=limits.level, write_content_size=False, write_checksum=False)
        out = []
        for block in blocks(pa.array(text, pa.string(), from_pandas=True)):
            n_words, _, _, _, n_repeat = _base(block)
            failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_percent * n_words)
            raw = block.data.tobytes()
            out += [not f and _measure(raw[a:b], limits, packer)[3] is None for f, a, b in zip(failed.tolist(), block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)]
        return pd.Series(out, dtype=bool)

    bound_arrow_batches(docs.sparkSession)
    return docs.where(accepted(F.col(text_col).cast("string")))


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    return keep_accepted(docs)
