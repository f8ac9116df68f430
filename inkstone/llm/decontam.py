"""Benchmark decontamination as a prefix-filtered set join of item-sized word windows.

A window is `n` consecutive words of an item (an item of fewer words is one window). A document contains a window only if
it contains the window's rarest word, so that one word is the necessary prefix: words are ordered by how often the corpus
has them (counted over all documents), windows are indexed by their rarest word, and a document looks up its own words in
that index. A candidate has a fixed place, given by the word's position in the window; length and positional bounds
(inside the document) drop what cannot fit, and all words of the window are then compared.

The item side is a stated query set: it is read in blocks of at most BLOCK_TEXT bytes of text, as measured, and each block takes a pass
over the documents, so that memory does not grow with the benchmark; documents are never shuffled, only the hits of several blocks are
merged by document.

Defined cases: null text has no words and no hits; items with no words or a null id match nothing; equal windows of several
items count for each of them; repeated documents give repeated results, repeated items count once; a very long text is searched whole;
of equally rare words of a window, the first is its prefix; empty tables on either side give no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StructType

from ._bytes import ALNUM, blocks
from ._store import bound_arrow_batches, broadcast_if_small, fresh_name, materialise

WINDOW = 10
#: Bytes of item text that are indexed at once; an index takes about 20 times that.
BLOCK_TEXT = 8 << 20
_CANDIDATES = 1 << 20


def _words(column: pa.Array) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    for block in blocks(column, lower=True):
        starts, ends, first = block.spans(ALNUM)
        yield block, block.hashes(starts, ends), first


class WindowIndex:
    """Distinct windows of a block of items, found by their rarest word."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.n = n
        item_words: list[np.ndarray] = []
        for _, words, first in _words(pa.array(texts, pa.string())):
            item_words += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        owners: dict[bytes, set[int]] = {}
        for i, words in enumerate(item_words):
            if len(words):
                m = min(n, len(words))
                for a in range(len(words) - m + 1):
                    owners.setdefault(words[a : a + m].tobytes(), set()).add(i)
        self.ids = [str(x) for x in ids]
        self.owners = [sorted(x) for x in owners.values()]
        self.size = np.array([len(k) // 8 for k in owners], np.int64)
        self.words = np.zeros((len(owners), n), np.uint64)
        for w, k in enumerate(owners):
            self.words[w, : self.size[w]] = np.frombuffer(k, np.uint64)
        live = np.arange(n)[None, :] < self.size[:, None]
        self.vocabulary = np.unique(self.words[live])

    def rank(self, counts: np.ndarray) -> None:
        """Choose each window's rarest word, by the corpus counts of the vocabulary."""
        if not len(self.size):
            self.prefix = np.zeros(0, np.uint64)
            return
        live = np.arange(self.n)[None, :] < self.size[:, None]
        at = np.searchsorted(self.vocabulary, self.words)
        rarity = np.where(live, counts[np.minimum(at, len(counts) - 1)], np.iinfo(np.int64).max)
        place = rarity.argmin(axis=1)
        token = self.words[np.arange(len(place)), place]
        order = np.argsort(token, kind="stable")
        self.entry_window, self.entry_place = order, place[order]
        self.prefix, self.entry_first = np.unique(token[order], return_index=True)
        self.entry_count = np.diff(np.append(self.entry_first, len(order)))

    def matches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `words` where a window begins, and that window."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(words):
            return none, none
        slot = np.minimum(np.searchsorted(self.prefix, words), len(self.prefix) - 1)
        at = np.flatnonzero(self.prefix[slot] == words)
        slot = slot[at]
        row = np.searchsorted(first, at, "right") - 1
        found = []
        fan = self.entry_count[slot]
        cut = np.concatenate([[0], np.cumsum(fan)])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + _CANDIDATES, "right")) - 1)
            reps = fan[a:b]
            entry = np.repeat(self.entry_first[slot[a:b]], reps) + np.arange(reps.sum()) - np.repeat(cut[a:b] - cut[a], reps)
            window = self.entry_window[entry]
            start = np.repeat(at[a:b], reps) - self.entry_place[entry]
            r = np.repeat(row[a:b], reps)
            ok = (start >= first[r]) & (start + self.size[window] <= first[r + 1])
            start, window = start[ok], window[ok]
            for j in range(self.n):
                if not len(start):
                    break
                ok = (j >= self.size[window]) | (words[np.minimum(start + j, len(words) - 1)] == self.words[window, j])
                start, window = start[ok], window[ok]
            found.append((start, window))
            a = b
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (none, none)


def _item_blocks(items: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    """The distinct items in parts of at most BLOCK_TEXT bytes of text each, as measured; a larger item is a part of its own."""
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total, largest = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    n = max(1, -(-(total or 0) // BLOCK_TEXT))
    while n > 1:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        most = items.groupBy(block).agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.max("b")).first()[0]
        if (most or 0) <= max(BLOCK_TEXT, 2 * largest):
            return [items.where(block == k) for k in range(n)]
        n *= 2
    return [items]


def _index(docs: DataFrame, items: DataFrame, doc_text: str, n: int):
    """The ranked index of one block of items, as a Spark broadcast."""
    spark = docs.sparkSession
    rows = items.collect()  # _item_blocks bounds it
    index = WindowIndex([r.item_id for r in rows], [r.text for r in rows], n)
    shared = spark.sparkContext.broadcast(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, words, _ in _words(batch.column(0)):
                if len(vocabulary):
                    slot = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    counts += np.bincount(slot[vocabulary[slot] == words], minlength=len(vocabulary))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["word", "n"])

    counts = np.zeros(max(1, len(index.vocabulary)), np.int64)
    if len(index.vocabulary):
        seen = docs.select(F.col(doc_text).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for r in seen.collect():  # a count for each word of the block at most
            counts[r.word] = r.n
    index.rank(counts)
    return spark.sparkContext.broadcast(index)


_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def _found(base: DataFrame, shared) -> DataFrame:
    """doc_id, key, n_words, hits and items of each row of base (doc_id, key, text), by one block's index."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for block, words, first in _words(batch.column(2)):
                marks = np.zeros(len(words) + 1, np.int64)
                start, window = index.matches(words, first)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + index.size[window], -1)
                row = np.searchsorted(first, start, "right") - 1
                items_of: dict[int, set] = {}
                for r, w in set(zip(row.tolist(), window.tolist(), strict=True)):
                    items_of.setdefault(r, set()).update(index.ids[i] for i in index.owners[w])
                hit = np.cumsum(marks[:-1]) > 0
                spans: list[list] = [[] for _ in range(block.rows)]
                for r in items_of:
                    a, b = int(first[r]), int(first[r + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    spans[r] = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(block.first, block.rows) for i in (0, 1)] + [pa.array(np.diff(first).astype(np.int64)), pa.array(spans, pa.list_(span)), pa.array([sorted(items_of.get(r, ())) for r in range(block.rows)], pa.list_(pa.string()))],
                    names=["doc_id", "key", "n_words", "hits", "items"],
                )

    return base.mapInArrow(run, f"doc_id long, key long, {_FOUND}")


@pandas_udf(ArrayType(StructType().add("start", LongType()).add("end", LongType())))
def _joined_spans(spans: pd.Series) -> pd.Series:
    """Sorted spans with those that meet made one."""
    out = []
    for row in spans:
        merged: list[list[int]] = []
        for s, e in sorted((x["start"], x["end"]) for x in row):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out.append([{"start": s, "end": e} for s, e in merged])
    return pd.Series(out, dtype=object)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """One row per document: n_words, the hit word ranges [start, end) in order, and the sorted ids of the items found."""
    bound_arrow_batches(docs.sparkSession)
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    base = docs.select(id_.alias("doc_id"), F.xxhash64(id_, text).alias("key"), text.alias("text"))
    blocks_ = _item_blocks(items, item_id, item_text)
    if len(blocks_) == 1:
        return _found(base, _index(base, blocks_[0], "text", n)).drop("key")
    # a pass for each block, so that one index at a time is in memory
    tables = []
    for k, part in enumerate(blocks_):
        shared = _index(base, part, "text", n)
        found = _found(base, shared)
        tables.append(materialise(found if k == 0 else found.where("size(items) > 0").dropDuplicates(["doc_id", "key"]), "found"))
        shared.destroy()
    more = reduce(DataFrame.unionByName, tables[1:]).groupBy(F.col("doc_id").alias("id"), F.col("key").alias("other")).agg(F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("items")).alias("i"))
    first = tables[0]
    both = first.join(more, (first["key"] == more["other"]) & first["doc_id"].eqNullSafe(more["id"]), "left")
    hits = F.when(F.col("h").isNull(), F.col("hits")).otherwise(_joined_spans(F.concat("hits", F.coalesce("h", F.array().cast(more.schema["h"].dataType)))))
    found = F.when(F.col("i").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "i"))))
    return both.select("doc_id", "n_words", hits.alias("hits"), found.alias("items"))


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: benchmark passages in all documents."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """Only the documents with no benchmark window, all columns unchanged; row-local after the index is built, if the items are one block."""
    bound_arrow_batches(docs.sparkSession)
    blocks_ = _item_blocks(items, item_id, item_text)
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    if len(blocks_) > 1:
        id_name, key_name = fresh_name(docs, "_id"), fresh_name(docs, "_key")
        base = docs.select(id_.alias("doc_id"), F.xxhash64(id_, text).alias("key"), text.alias("text"))
        tables = []
        for part in blocks_:
            shared = _index(base, part, "text", n)
            tables.append(materialise(_found(base, shared).where("size(items) > 0").select("doc_id", "key"), "found"))
            shared.destroy()
        bad = materialise(reduce(DataFrame.unionByName, tables).distinct(), "found")
        bad = broadcast_if_small(bad, bad.count(), 24)
        rows = docs.withColumn(id_name, id_).withColumn(key_name, F.xxhash64(id_, text))
        return rows.join(bad, (rows[key_name] == bad["key"]) & rows[id_name].eqNullSafe(bad["doc_id"]), "left_anti").select(*docs.columns)
    shared = _index(docs, blocks_[0], text_col, n)

    @pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        out = []
        for block, words, first in _words(pa.array(text, pa.string(), from_pandas=True)):
            bad = np.zeros(block.rows, bool)
            start, _ = shared.value.matches(words, first)
            bad[np.searchsorted(first, start, "right") - 1] = True
            out += (~bad).tolist()
        return pd.Series(out, dtype=bool)

    return docs.where(clean(text))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = """
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM lowered, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM places),
found AS (SELECT g.doc_id, g.n, g.i, x.item_id FROM grams g JOIN windows x ON g.win = x.win AND g.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""
