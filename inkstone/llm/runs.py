"""Periodic runs: stretches of words that repeat with a period, found in every whole text and collapsed.

A run is a stretch of consecutive words in which words that lie `period` apart are equal, for no smaller period, of at least
max(MIN_WORDS, 2 * period) words, that no neighbouring word extends. All runs of a text are found on a harmonic grid:

1. For each period q, the grid points 0, q, 2q ... A run of two periods holds some grid point together with the next one, so it is
   found by extending the equality of those two points to both sides. There are n/1 + n/2 + ... = O(n log n) pairs (period, grid point).
2. Pairs whose words differ go first, then those with fewer than three equal words on each side; for a run has at least
   six equal pairs in a row. For all that are left the extensions are found at once by binary search over prefix hashes
   (NumPy, 64-bit polynomial hashes), in chunks of CHUNK pairs.
3. Each extension is verified word by word; where a hash deceived, its ends come from the comparison of the words.
4. A run is found at several grid points, and by multiples of its period; of each stretch the smallest period is kept, once.

Words are numbered exactly, so nothing rests on hashes in the end. Row-local, in Arrow batches: no shuffle, hot sources and groups of copies do
not matter, a lost executor costs its running tasks. Memory is that of the words of one text, besides chunks of a fixed size.

Defined cases: null text has no words and no runs; empty text likewise; a text of one word repeated is one run of period 1; equal
greatest runs go by start, then period; very long texts are searched whole; repeated rows give repeated results; an empty table gives no rows;
other columns are not read, whatever their names. Rows with a null id are handled like all others (and are not planted by the query).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import mix
from ._store import bound_arrow_batches

#: Shortest run, in words.
MIN_WORDS = 12
#: Pairs of a period and a grid point that are worked on at once.
CHUNK = 1 << 19
#: Verified runs of so many words spare their own multiples; so many are kept. The result is the same without.
COVER, COVERS = 4096, 16
#: The multiplier of the prefix hashes: any odd number with mixed bits.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def number_words(words: list[bytes]) -> np.ndarray:
    """For each word the number of its first kind, so that equal words, and no others, have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class Prefixes:
    """Prefix hashes of a sequence of numbers; tells whether stretches of it are equal (and, very rarely, says so wrongly)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def same(self, i: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths from i and from i + apart on are equal."""
        j = i + apart
        return (self.sums[i + length] - self.sums[i]) * self.power[apart] == self.sums[j + length] - self.sums[j]


def _furthest(most: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each item the greatest length up to its `most` that holds, if shorter ones than one that holds do too; binary search for all at once."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live] + 1) >> 1
        ok = holds(live, mid)
        low[live[ok]] = mid[ok]
        high[live[~ok]] = mid[~ok] - 1
        live = live[low[live] < high[live]]
    return low


def _grid(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid point, period) pairs whose words agree well enough to lie in a run, CHUNK pairs of the grid at a time."""
    n = len(codes)
    periods = np.arange(1, n // 2 + 1)
    ends = np.concatenate([[0], np.cumsum((n - 1) // periods)])
    a = 0
    while a < len(periods):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
        # a single small period may have more grid points than a chunk
        for lo in range(int(ends[a]), int(ends[b]), CHUNK):
            hi = min(lo + CHUNK, int(ends[b]))
            f = int(np.searchsorted(ends, lo, "right")) - 1
            t = int(np.searchsorted(ends, hi, "left"))
            cut = np.clip(ends[f : t + 1], lo, hi)
            q = np.repeat(periods[f:t], np.diff(cut))
            i = (np.arange(lo, hi) - np.repeat(ends[f:t], np.diff(cut))) * q
            keep = np.flatnonzero(codes[i] == codes[i + q])
            yield i[keep], q[keep]
        a = b


def find_runs(codes: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(codes)
    if n < least:
        return []
    # no number equals the ones beyond the ends
    padded = np.concatenate([[-1, -2, -3], codes, [-4, -5, -6]])
    prefixes, found, covers = None, [], []
    for i, q in _grid(codes):
        for s, m, r in covers:
            # inside a run, multiples of its period find the run again
            keep = (q % r > 0) | (i < s) | (i + q >= s + m)
            i, q = i[keep], q[keep]
        p = i + 3
        after = (padded[p + 1] == padded[np.minimum(p + q + 1, n + 5)]) & (padded[p + 2] == padded[np.minimum(p + q + 2, n + 5)])
        before = (padded[p - 1] == padded[p + q - 1]) & (padded[p - 2] == padded[p + q - 2]) & (padded[p - 3] == padded[p + q - 3])
        keep = after | before
        i, q = i[keep], q[keep]
        if not len(i):
            continue
        prefixes = prefixes or Prefixes(codes)
        right = _furthest(n - i - q, lambda k, m, i=i, q=q: prefixes.same(i[k], q[k], m))
        left = _furthest(i, lambda k, m, i=i, q=q: prefixes.same(i[k] - m, q[k], m))
        start, length = i - left, left + right + q
        keep = length >= np.maximum(least, 2 * q)
        if keep.any():
            found.append(np.unique(np.stack([start[keep], length[keep], q[keep], i[keep]]), axis=1))
            s, m, r, _ = found[-1][:, int(np.argmax(found[-1][1]))].tolist()
            if m >= COVER and len(covers) < COVERS and (codes[s : s + m - r] == codes[s + r : s + m]).all():
                covers.append((s, m, r))
    runs: dict[tuple[int, int], int] = {}
    last = None
    for start, length, q, i in sorted(map(tuple, np.concatenate(found, axis=1).T.tolist())) if found else ():
        if last == (start, length, q) or runs.get((start, length), q) < q:
            continue
        last = (start, length, q)
        equal = codes[start : start + length - q] == codes[start + q : start + length]
        if not equal.all():
            # a hash deceived: the words tell how far the equality reaches
            equal = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
            begin = i + 1 - int(np.argmin(equal[: i + 2][::-1]))
            stop = i + 1 + int(np.argmin(equal[i + 1 :]))
            start, length = begin, stop - 1 - begin + q
            if length < max(least, 2 * q):
                continue
        runs[start, length] = min(q, runs.get((start, length), q))
    return sorted((s, m, q) for (s, m), q in runs.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if of each run only the first period does."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(from, period) of the repetition that the query plants into a document of n words, if it does."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _each(docs: DataFrame, id_col: str, text_col: str, schema: str, row: Callable[[int | None, list[bytes], list[tuple[int, int, int]]], tuple], plant: Callable[[int | None, int], tuple[int, int] | None] | None, types: list[pa.DataType]) -> DataFrame:
    """row(id, words, runs) for each document, as a table of the schema."""
    bound_arrow_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.replace("array<struct<start:long,length:long,period:long>>", "array").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                # bytes.split() takes the six ASCII white spaces, and no other, as gaps
                words = (text.as_py() or "").encode().split()
                doc = doc.as_py()
                codes = number_words(words)
                if plant and (at := plant(doc, len(words))):
                    a, p = at
                    source = np.arange(len(words))
                    source[a:] = a + (source[a:] - a) % p
                    codes, words = codes[source], [words[k] for k in source.tolist()]
                rows.append(row(doc, words, find_runs(codes)))
            columns = zip(*rows, strict=True) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, all runs (start and length in words, period), and collapsed, the text whose runs keep their first period only.

    The collapsed text of a document without runs is the text as it is; else the kept words joined by single blanks.
    """
    out = _each(
        docs, id_col, text_col, "doc_id long, runs array<struct<start:long,length:long,period:long>>, words string",
        lambda doc, words, runs: (doc, [{"start": s, "length": m, "period": q} for s, m, q in runs], _collapsed(words, runs).decode() if runs else None),
        None, [pa.int64(), pa.list_(_RUN), pa.string()],
    )
    return out.withColumnRenamed("words", "collapsed")


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    return b" ".join(words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()) if runs else b" ".join(words)


def _digest(doc: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = _collapsed(words, runs)
    exponent = 1000 * best[1] // best[2] if runs else None
    dropped = len(words) - int(kept_words(len(words), runs).sum()) if runs else 0
    return doc, len(words), len(runs), *best, exponent, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), dropped


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """One row per document: counts of words and runs, the greatest run, and digests of all runs and of the collapsed words.

    `plant` may name a place and a period from which on the words are to repeat, to test with known runs.
    """
    ints = [pa.int64()]
    return _each(docs, id_col, text_col, SCHEMA, _digest, plant, [*ints * 7, pa.string(), pa.string(), pa.int64()])


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Query: periodic runs of all documents, a tenth of which get a planted one."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=planted)
