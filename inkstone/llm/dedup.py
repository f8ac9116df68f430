"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. One pass over the texts gives each document's shingle count, a 128-bit key of its shingle set and a MinHash signature.
2. Documents with equal sets form a class; its smallest id stands for it.
3. Each representative has a label (DEPTH MinHash values) in each of TREES trees. The trees are sorted by label over range
   partitions that may cut anywhere, hot labels included. The longest common prefix of each label with the next one is computed; a
   document meets its NEIGHBOURS next ones with which it shares MIN_DEPTH values at least. In sparse regions that is the whole bucket; in
   dense ones the neighbours are those with the longest prefixes, so the depth follows the region. Candidates are ranked by the sum of their prefixes.
4. Each document's best smaller partner is confirmed on full sets, which already connects most of a group.
5. The rest: buckets larger than the neighbourhood that still hold several components are finished exactly, minority against all,
   in blocks, by an inverted index on full sets (see _finish). Members that are already connected need no more links, so
   a group of near copies never yields its pairs.
6. Candidates that still join different components are confirmed as well.

A pair at similarity 0.8 shares MIN_DEPTH values in at least one tree with probability 1 - (1 - 0.8**4)**16 = 0.9998.
Shingles are 64-bit hashes of the words' bytes.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; fewer words than a shingle
make one shingle; ties take the smaller id; rows that repeat a doc_id are one node of the graph and each keep their row;
rows with a null doc_id are linked with nothing and kept; a very long text is one set, whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SPACED, blocks, grams, mix
from ._graph import connected_components
from ._store import bound_arrow_batches, broadcast_if_small, join_hot, materialise

TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 16, 8, 4, 4
#: Sets that meet their common partner in one task.
GROUP = 128
#: Documents in a block of the exact comparison of large buckets.
BLOCK = 512
_SEEDS = np.random.default_rng(20240229)
_A = _SEEDS.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _SEEDS.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(column: pa.Array, words_per: int) -> Iterator[tuple[object, list[np.ndarray]]]:
    """For each block of rows, the sorted distinct shingle hashes of each row."""
    for block in blocks(column, lower=True):
        starts, ends, first = block.spans(SPACED)
        words = block.hashes(starts, ends)
        g, at = grams(words, first, words_per)
        begin = np.searchsorted(at, first)
        out = []
        for d in range(block.rows):
            n = first[d + 1] - first[d]
            if n >= words_per:
                s = np.sort(g[begin[d] : begin[d + 1]])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif n:
                h = words[first[d] : first[d + 1]]
                acc = h[:1].copy()
                for x in h[1:]:
                    acc = mix(acc + x)
                out.append(mix(acc + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield block, out


def minhash(s: np.ndarray) -> np.ndarray:
    """Multiply-shift MinHash values (32 bits each) of a set of hashes."""
    low = s & np.uint64(0xFFFFFFFF)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint64)
    for a in range(0, len(low), 2048):
        h = (low[None, a : a + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)
        np.minimum(out, h.min(axis=1), out=out)
    return out.astype(">u4")


def _signatures(docs: DataFrame, words_per: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sets in shingle_sets(batch.column(1), words_per):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _label_matrix(labels: pa.Array) -> np.ndarray:
    """Labels of DEPTH big-endian 32-bit values as rows of a matrix."""
    off = np.frombuffer(labels.buffers()[1], np.int32)[labels.offset : labels.offset + len(labels) + 1]
    return np.frombuffer(labels.buffers()[2], np.uint8)[off[0] : off[-1]].view(">u4").reshape(len(labels), DEPTH).astype(np.uint32)


def common_prefixes(trees: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many leading values each row shares with the next one of its tree (0 across trees)."""
    same = (labels[1:] == labels[:-1]) & (trees[1:] == trees[:-1])[:, None]
    return np.cumprod(same, axis=1).sum(axis=1)


def _forest(reps: DataFrame) -> DataFrame:
    """Candidate pairs (kind 0: u < v, prefix), and members (kind 1: u, with key) of buckets beyond the neighbourhood.

    In the sorted order, two documents share the least of the common prefixes of the neighbours between them. The neighbours of a
    document are thus those with the longest prefixes, as deep as its region is dense.
    """
    width = 4 * DEPTH
    labels = F.array(*(F.substring("sig", 1 + t * width, width) for t in range(TREES)))
    rows = reps.select("doc_id", F.posexplode(labels).alias("tree", "label"))
    ordered = rows.repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    schema = "kind int, u long, v long, prefix int, key binary"

    def emit(ids, trees, labels, shared, ends_here) -> pa.RecordBatch:
        """Of whole runs of rows that share MIN_DEPTH values. A run that may go on in another partition counts as large."""
        us, vs, depths = [], [], []
        depth = shared.copy()
        for s in range(1, NEIGHBOURS + 1):
            depth = shared if s == 1 else np.minimum(depth[:-1], shared[s - 1 :])
            at = np.flatnonzero(depth >= MIN_DEPTH)
            us.append(np.minimum(ids[at], ids[at + s]))
            vs.append(np.maximum(ids[at], ids[at + s]))
            depths.append(depth[at])
        us, vs, depths = (np.concatenate(x) for x in (us, vs, depths))
        run = np.concatenate([[0], np.cumsum(shared < MIN_DEPTH)])
        large = np.bincount(run) > NEIGHBOURS + 1
        large[[0] if ends_here[0] else []] = True
        large[[-1] if ends_here[1] else []] = True
        member = np.flatnonzero(large[run])
        n, m = len(us), len(member)
        keys = np.concatenate([trees[member, None].astype(np.uint8), labels[member, :MIN_DEPTH].astype(">u4").view(np.uint8).reshape(m, 4 * MIN_DEPTH)], axis=1)
        size = 1 + 4 * MIN_DEPTH
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), m, [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), pa.array(np.concatenate([us, ids[member]])), pa.concat_arrays([pa.array(vs), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(depths.astype(np.int32)), pa.nulls(m, pa.int32())]), pa.concat_arrays([pa.nulls(n, pa.binary()), fixed])],
            names=["kind", "u", "v", "prefix", "key"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        opening = True
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), _label_matrix(batch.column(2)))
            held = tuple(np.concatenate(x) for x in zip(held, part, strict=True)) if held else part
            # a run that goes on stays for the next batch, up to a bound beyond which it is cut and counts as large anyway
            shared = common_prefixes(held[1], held[2])
            change = np.flatnonzero(shared < MIN_DEPTH) + 1
            stop = int(change[-1]) if len(change) else 0
            cut = len(held[0]) - stop > 1 << 16
            if cut:
                stop = len(held[0]) - NEIGHBOURS
            if stop:
                yield emit(*(x[:stop] for x in held), shared[: stop - 1], (opening, cut))
                held, opening = tuple(x[stop:] for x in held), cut
        if held and len(held[0]):
            yield emit(*held, common_prefixes(held[1], held[2]), (opening, True))

    return ordered.mapInArrow(scan, schema)


def _sets_of(docs: DataFrame, by_doc: DataFrame, rows: int, row_bytes: int, words_per: int) -> DataFrame:
    """(doc_id, roles, items): the shingle sets, as bytes, of the documents in by_doc (doc_id, roles), made anew from their texts."""
    wanted = docs.join(broadcast_if_small(by_doc, rows, row_bytes), "doc_id").select("doc_id", "text", "roles")
    kind = by_doc.schema["roles"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sets in shingle_sets(batch.column(1), words_per):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), batch.column(2).slice(block.first, block.rows), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "roles", "items"],
                )

    return wanted.mapInArrow(make, f"doc_id long, roles {kind}, items binary")


def _confirm(docs: DataFrame, pairs: DataFrame, words_per: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union.

    Pairs meet by u, in groups of at most about GROUP partners, so a hub is spread over many tasks; the sets are made anew
    from the texts of the documents concerned. The roles are broadcast within a checked size, else joined by shuffle.
    """
    n = pairs.count()
    chunk = F.pmod(F.xxhash64("v"), F.greatest(F.lit(1), F.ceil(F.col("_fan") / GROUP))).cast("int")
    fans = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("_fan"))
    grouped = pairs.join(fans, "u").select("u", "v", chunk.alias("chunk"))
    roles = grouped.select(F.col("v").alias("doc_id"), "u", "chunk").unionByName(grouped.select(F.col("u").alias("doc_id"), "u", "chunk").distinct())
    roles = materialise(roles, "roles")
    # a document's groups as one array, so that its set is made once
    by_doc = roles.groupBy("doc_id").agg(F.collect_list(F.struct("u", "chunk")).alias("roles"))
    sets = _sets_of(docs, by_doc, 2 * n, 32, words_per)
    placed = sets.select(F.explode("roles").alias("g"), "doc_id", "items").select("g.u", "g.chunk", "doc_id", "items")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        u = int(frame["u"].iloc[0])
        sets_ = [np.frombuffer(x, np.uint64) for x in frame["items"]]
        hubs = [s for s, i in zip(sets_, frame["doc_id"], strict=True) if i == u]
        found = []
        for s, i in zip(sets_, frame["doc_id"], strict=True):
            if i == u or not len(s):
                continue
            for h in hubs:
                if 100 * min(len(h), len(s)) < percent * max(len(h), len(s)):
                    continue
                at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                common = int((h[at] == s).sum())
                if 100 * common >= percent * (len(h) + len(s) - common):
                    found.append(int(i))
                    break
        return pd.DataFrame({"u": [u] * len(found), "v": found}, columns=["u", "v"]).astype("int64")

    return placed.groupBy("u", "chunk").applyInPandas(compare, "u long, v long")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these as cu and cv."""
    a = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    out = pairs.join(a, "u", "left").join(b, "v", "left")
    out = out.withColumn("cu", F.coalesce("cu", "u")).withColumn("cv", F.coalesce("cv", "v"))
    return out.where("cu <> cv")


def _finish(docs: DataFrame, members: DataFrame, words_per: int, percent: int) -> DataFrame:
    """The rest: links (u, v) between members of different components in large buckets, decided exactly.

    Buckets (key) whose largest component is the same make one region, so a group of near copies is one region, whatever
    the number of trees. Members outside the largest component (the minority) are compared with all members, in blocks of both:
    a task holds an inverted index of one block of sets and looks up another block's. Of a document's links to one component
    it yields the first, so the links are at most one for each minority document and component.
    """
    sizes = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    region = materialise(members.join(main, "key").select("main", "u", "c").distinct(), "regions")
    count = region.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"), F.ceil(F.sum((F.col("c") != F.col("main")).cast("long")) / BLOCK).cast("int").alias("few")).where("few > 0")
    placed = region.join(count, "main")
    as_all = F.struct("main", "c", F.lit(1).alias("side"), F.pmod(F.xxhash64("u"), F.col("all")).cast("int").alias("own"), F.col("few").alias("others"))
    as_few = F.struct("main", "c", F.lit(0).alias("side"), F.pmod(F.xxhash64("u"), F.col("few")).cast("int").alias("own"), F.col("all").alias("others"))
    roles = placed.select(F.col("u").alias("doc_id"), F.explode(F.when(F.col("c") != F.col("main"), F.array(as_few, as_all)).otherwise(F.array(as_all))).alias("r"))
    roles = materialise(roles, "roles")
    by_doc = roles.groupBy("doc_id").agg(F.collect_list("r").alias("roles"))
    sets = _sets_of(docs, by_doc, roles.count(), 64, words_per)
    rows = sets.select("doc_id", "items", F.explode("roles").alias("r")).select("doc_id", "items", "r.*")
    rows = rows.select("main", "c", "side", "doc_id", "items", "own", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    rows = rows.select("main", "c", "side", "doc_id", "items", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out_u, out_v = [], []
        few, every = frame[frame["side"] == 0], frame[frame["side"] == 1]
        sets_ = [np.frombuffer(x, np.uint64) for x in every["items"]]
        if len(few) and len(every):
            size = np.array([len(x) for x in sets_])
            owner = np.repeat(np.arange(len(sets_)), size)
            flat = np.concatenate(sets_)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, comps = every["doc_id"].to_numpy(), every["c"].to_numpy()
            for i, c, x in zip(few["doc_id"], few["c"], few["items"], strict=True):
                own = np.frombuffer(x, np.uint64)
                a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sets_))
                hit = np.flatnonzero((100 * common >= percent * (len(own) + size - common)) & (comps != c) & (common > 0))
                _, one = np.unique(comps[hit], return_index=True)
                out_u += [i] * len(one)
                out_v += ids[hit[one]].tolist()
        pairs = pd.DataFrame({"u": out_u, "v": out_v}, columns=["u", "v"]).astype("int64")
        return pd.DataFrame({"u": pairs.min(axis=1), "v": pairs.max(axis=1)}).astype("int64")

    return rows.groupBy("main", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest reachable doc_id) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(_signatures(base, words_per), "signatures")
    total = signed.count()
    classes = materialise(signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    reps = signed.where("set_key is not null").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    found = materialise(_forest(reps), "forest")
    scored = materialise(found.where("kind = 0").where("u <> v").groupBy("u", "v").agg(F.sum("prefix").alias("score")), "candidates")
    best = scored.groupBy("v").agg(F.max_by("u", F.struct("score", -F.col("u"))).alias("u")).select("u", "v")
    tested = materialise(best, "tested")
    links = materialise(_confirm(base, tested, words_per, percent), "links")
    labels = materialise(connected_components(links), "labels")

    members = found.where("kind = 1").select("key", "u").distinct().join(labels.select(F.col("node").alias("u"), F.col("component").alias("c")), "u", "left").withColumn("c", F.coalesce("c", "u"))
    more = materialise(_finish(base, members, words_per, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = materialise(connected_components(links), "labels")
    left = materialise(_across(scored.join(tested, ["u", "v"], "left_anti"), labels).select("u", "v"), "tested")
    if not left.isEmpty():
        links = links.unionByName(materialise(_confirm(base, left, words_per, percent), "links"))
        labels = materialise(connected_components(links), "labels")

    # a class without links has its representative as component
    named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", "n", F.coalesce("component", "rep").alias("component_id"))
    plain = signed.select("doc_id", "n_shingles", "set_key")
    # classes of one document without links need no join by key
    marked = join_hot(plain, named, "set_key", "n", total)
    rows = marked.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate groups of all documents, on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_per=2)


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five-word shingles); of rows that repeat its doc_id, all stay."""
    dropped = materialise(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(broadcast_if_small(dropped, dropped.count(), 16), "doc_id", "left_anti").select(*docs.columns)


#: Quadratic in the documents that share a shingle: for small tables, as an oracle of op2.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
