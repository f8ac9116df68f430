"""Best-fit packing of tokenised documents into fixed-length training sequences, by exact-complement hashing.

1. One pass tokenises the texts and cuts documents longer than a sequence into pieces; full pieces come last, so only the
   first piece of a document may be shorter. Each row keeps its write partition and its rank among the pieces of its length there.
2. The plan works on the counts of pieces by length, at most `capacity` numbers, so it costs the same for any number of
   documents. From the longest length down, the gap that a piece leaves is looked up in hash indexes of single, pair and
   triple sums of available lengths; a combination that fills it exactly is consumed as often as the counts of its members
   allow. Where no sum fits, the longest piece that fits takes its place (best fit) and the smaller gap is looked up again.
   Each step uses up a length or nearly so, so there are a few thousand steps.
3. A step is a few (length, first rank, last rank) ranges. Ranks within a length come from counts by (partition, length),
   summed over the partitions before; a piece looks up its range by (length, rank). Token ids are neither shuffled nor sorted.

Tokens come from the `tokenizers` library. Texts are cut at single blanks between two other visible characters, where the
byte-level pre-tokeniser always begins a new word, and each distinct part is encoded once per worker and kept by 64-bit hash.

Defined cases: null and empty text give the end token alone; a document of exactly `capacity` tokens is one full piece; repeated rows
are packed each; a very long text is tokenised whole; pieces of equal length are placed in the order of partition and row, and of combinations
that fit a gap alike the longest members win; an empty table gives no rows; other columns are not read, those named in `extra` are carried
along and must have names of their own.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ._bytes import SPACED, Block, blocks
from ._store import bound_arrow_batches, broadcast_if_small, materialise

CAPACITY = 2048
END_ID = 0
#: Parts that a worker keeps encoded before it starts anew.
KEPT_PARTS = 1_000_000
#: Parts, and bytes of text, that are encoded at once.
ENCODED_AT_ONCE, ENCODED_BYTES = 4096, 1 << 20
#: Parts that are encoded as one string.
JOINED = 64
#: Lead bytes in UTF-8 of white space outside ASCII.
_SPACE_LEADS = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PartEncoder:
    """Encodes blocks of text by their parts, remembering the ids of each part by its hash."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # a character of a byte-level token is a byte; added tokens are plain text and belong to no part
        self.n_bytes = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(token)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    @staticmethod
    def parts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and for each row the index of its first part, with the total last. Parts cover a row without gaps."""
        data = block.data
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            # outside ASCII, white space begins with one of four bytes and never follows a byte in C3-DF
            ends = SPACED[data] & (data < 0x80)
            ends[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
            begins = SPACED[data] & ~np.isin(data, _SPACE_LEADS)
            cut[1:-2] = (data[1:-1] == 0x20) & ends[:-2] & begins[2:]
        off = block.off
        # a blank at a row's end has its neighbour in the next row
        last = off[1:][off[1:] > off[:-1]] - 1
        cut[last] = False
        begin = off[:-1][off[1:] > off[:-1]]
        cut[begin] = True
        cut[len(block.data)] = False
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, off)
        ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
        return starts, ends, first

    def encode_parts(self, texts: list[str], n_bytes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these parts of so many bytes, one part after the other, how many each of them has, and in which order the parts come.

        Those cut out of the inside of a row (inner) may follow one another in a string without changing their ids. Such strings cost
        half as much; the tokens' bytes tell the parts apart, and where they don't, parts are encoded one by one.
        """
        ids, sizes, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own, joint = [np.flatnonzero(~inner)], np.flatnonzero(inner)
        groups = [joint[a : a + JOINED] for a in range(0, len(joint), JOINED)]
        # a few at a time, since encodings hold far more than their ids
        for a in range(0, len(groups), ENCODED_AT_ONCE // JOINED):
            some = groups[a : a + ENCODED_AT_ONCE // JOINED]
            for group, e in zip(some, self.tokenizer.encode_batch_fast(["".join([texts[i] for i in g.tolist()]) for g in some], add_special_tokens=False), strict=True):
                found = np.array(e.ids, np.int32)
                ends, upto = np.cumsum(n_bytes[group]), np.cumsum(self.n_bytes[found])
                if len(found) and upto[-1] == ends[-1] and (upto[at := np.searchsorted(upto, ends)] == ends).all():
                    ids.append(found)
                    sizes.append(np.diff(at, prepend=-1))
                    order.append(group)
                else:
                    own.append(group)
        own = np.concatenate(own)
        for a in range(0, len(own), ENCODED_AT_ONCE):
            some = own[a : a + ENCODED_AT_ONCE]
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in some.tolist()], add_special_tokens=False)]
            ids += found
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            order.append(some)
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate(order)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and for each row the index of its first id, with the total last."""
        starts, ends, first = self.parts(block)
        h = block.hashes(starts, ends)
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KEPT_PARTS:
            self.reset()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = block.data.tobytes()
            texts = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in where[new]]
            inner = np.ones(len(starts), bool)
            inner[first[:-1][first[:-1] < first[1:]]] = inner[first[1:][first[:-1] < first[1:]] - 1] = False
            fresh, sizes, order = self.encode_parts(texts, (ends - starts)[where[new]], inner[where[new]])
            slots = np.empty(len(new), np.int64)
            slots[order] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, fresh])
            place = np.searchsorted(self.keys, distinct[new])
            self.keys, self.slots = np.insert(self.keys, place, distinct[new]), np.insert(self.slots, place, slots)
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][inverse] if len(distinct) else np.zeros(0, np.int64)
        sizes = self.first[slot + 1] - self.first[slot]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(upto[-1]) + np.repeat(self.first[slot] - upto[:-1], sizes)
        return self.ids[take], upto[first]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> PartEncoder:
    return PartEncoder(vocabulary)


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, extra: list[str] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, the write partition `part` and the rank `nth` among its pieces of that length.

    Columns named in `extra` are carried along on each piece.
    """
    if own := {x.lower() for x in extra} & {"doc_id", "piece", "start", "length", "ids", "part", "nth", "sequence_id", "offset", "shift", "_at"}:
        raise ValueError(f"rename these extra columns: {sorted(own)}")
    schema = ", ".join(["doc_id long, piece int, start long, length long, ids array<int>, part int, nth long"] + [f"`{n}` {t}" for n, t in docs.select(*extra).dtypes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for block in blocks(batch.column(1), size=ENCODED_BYTES):
                ids, first = encoder.encode(block)
                n = np.diff(first)
                flat = np.full(len(ids) + block.rows, end_id, np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(block.rows), n)] = ids
                n = n + 1
                base = np.concatenate([[0], np.cumsum(n)])
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(block.rows), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                length = np.where(k == 0, head[row], capacity)
                start = np.where(k == 0, 0, head[row] + (k - 1) * capacity)
                # rank within equal lengths, in row order
                order = np.argsort(length, kind="stable")
                s = length[order]
                fresh = np.concatenate([[True], s[1:] != s[:-1]])
                at = np.flatnonzero(fresh)
                nth = np.empty(len(s), np.int64)
                nth[order] = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s)))) + seen[s]
                seen += np.bincount(length, minlength=capacity + 1)
                edges = np.append(base[row] + start, base[-1]).astype(np.int32)
                pick = pa.array(row + block.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), pa.array(k.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
                    + [batch.column(2 + i).take(pick) for i in range(len(extra))],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth", *extra],
                )

    return docs.mapInArrow(run, schema)


class Sums:
    """Hash indexes from a sum to what makes it: the lengths in stock, pairs of them and triples.

    Counts only fall, so a combination that they no longer allow is dropped from its index for good.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = np.asarray(counts).tolist()
        self.lengths = [i for i, n in enumerate(self.counts) if n and i]  # ascending
        self.singles = set(self.lengths)
        top = len(self.counts) - 1
        #: sum -> the longer members of its pairs, the longest last
        self.pairs: dict[int, list[int]] = defaultdict(list)
        for b in reversed(self.lengths):
            for a in self.lengths[bisect_left(self.lengths, b) : bisect_right(self.lengths, top - b)]:
                self.pairs[a + b].append(a)
        #: sum -> where the search for its triples has come to: the greatest longest member that is still possible
        self.triples: dict[int, int] = {}

    def take(self, length: int, times: int) -> None:
        self.counts[length] -= times
        if not self.counts[length]:
            self.singles.discard(length)
            del self.lengths[bisect_left(self.lengths, length)]

    def allowed(self, *members: int) -> bool:
        return all(self.counts[x] >= members.count(x) for x in members)

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair (a >= b) of that sum with the longest a."""
        found = self.pairs.get(total, [])
        while found:
            if self.allowed(found[-1], total - found[-1]):
                return found[-1], total - found[-1]
            found.pop()
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """The triple (a >= b >= c) of that sum with the longest a, then the longest b."""
        at = bisect_right(self.lengths, self.triples.get(total, total - 2)) - 1
        for a in reversed(self.lengths[: at + 1]):
            if 3 * a < total:
                break
            self.triples[total] = a
            others = self.pairs.get(total - a, [])
            for b in reversed(others[: bisect_right(others, a)]):
                if self.allowed(a, b, total - a - b):
                    return a, b, total - a - b
        self.triples[total] = 0
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that sum to the gap; fewer and longer ones first."""
        return (gap,) if gap in self.singles else self.pair(gap) or self.triple(gap)

    def longest(self, upto: int) -> int:
        at = bisect_right(self.lengths, upto)
        return self.lengths[at - 1] if at else 0


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths): sequences of these lengths, so many times over; uses up counts[length] pieces of each length."""
    stock, out = Sums(np.asarray(counts, np.int64)), []
    for length in range(capacity, 0, -1):
        while stock.counts[length]:
            chosen, gap = [length], capacity - length
            stock.take(length, 1)
            while gap and stock.singles:
                if more := stock.exact(gap):
                    chosen += more
                    gap = 0
                else:
                    more = (stock.longest(gap),)
                    if more[0] < 1:
                        break
                    chosen.append(more[0])
                    gap -= more[0]
                for x in more:
                    stock.take(x, 1)
            # the same again, as often as the counts allow
            times = min(stock.counts[x] // chosen.count(x) for x in set(chosen))
            for x in set(chosen) if times else ():
                stock.take(x, times * chosen.count(x))
            out.append((times + 1, tuple(chosen)))
    return out


def _ranges(steps: list[tuple[int, tuple[int, ...]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): length, first rank, first sequence and offset of each range of pieces."""
    used = [0] * (capacity + 1)
    rows, sequence = [], 0
    for times, lengths in steps:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, extra: list[str] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (the tokens), sequence_id and offset (its place there)."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    pieces = materialise(tokenise(base, vocabulary, capacity, end_id, extra), "pieces")
    counted = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    length, rank, sequence, offset = _ranges(plan(counts, capacity), capacity)
    ranges = spark.sparkContext.broadcast((length * (1 << 48) + rank, rank, sequence, offset))

    @pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, sequence, offset = ranges.value
        r = rank.to_numpy(np.int64)
        at = np.searchsorted(key, length.to_numpy(np.int64) * (1 << 48) + r, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + r - first[at], "offset": offset[at]})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    shifts = materialise(shifts, "shifts")
    ranked = pieces.join(broadcast_if_small(shifts, shifts.count(), 24), ["part", "length"])
    at = place("length", F.col("shift") + F.col("nth"))
    return ranked.withColumn("_at", at).select("doc_id", "piece", "start", "length", "ids", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"), *extra)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids; a sequence's pieces (at most `capacity`) meet in one row."""
    pieces = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return pieces.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


@pandas_udf(LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return pd.Series([zlib.crc32(np.asarray(x).astype("<u4").tobytes()) for x in ids], dtype="int64")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all documents packed into sequences of at most 2048 tokens."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
    return packed.select("doc_id", "piece", "start", "length", ids_crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def stage_pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the kept documents with their token ids and places."""
    return pack(docs, default_vocabulary())
