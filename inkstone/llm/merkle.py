"""Merkle dataset manifest: a hash tree over the rows of each source, one over the sources, and a proof for every row.

Rows of a source are in order of id; nodes are joined in runs of FANOUT, the last run of a level being what is left (a single node as
well: nothing is padded). Subroots in order of source have a tree of the same kind, whose top is the root of the dataset.

1. Leaves are hashed in Catalyst. Rows are dealt into ranges of (source, id, leaf); a row's index in its source is its rank in its range and the
   number of rows of the source in earlier ranges (a table of ranges and sources). No source is sorted or held by one task.
2. Each task reads consecutive indices and keeps a mountain range: a stack of the open run of every level. A run that is complete (FANOUT
   nodes, or the last ones of its level) becomes a node one level up, a carry as in counting to the base of FANOUT. Completed nodes
   are emitted as records. Nodes of runs that begin before the task's rows or end after them are emitted as peaks.
3. Peaks are merged level by level: those of a run are grouped (FANOUT rows at most), hashed, and are peaks of the next level. A level has a
   FANOUT-th of the nodes of the one below.
4. A node's path is the list of its siblings to the left and right, level by level to the root. Paths are made from the top down to the nodes
   of level CHUNK_LEVEL; below, a group of at most FANOUT ** CHUNK_LEVEL rows makes those of its rows along with one path from above.

Defined cases: nulls count as `-` in the leaf, empty text as `0:`; a null id comes first and is never tampered; a null source is a
source, the first one; rows with the same id are ordered by their leaf, equal rows are leaves of their own; a very long text is hashed whole;
a source of one row has its leaf as subroot and a single source its subroot as root; an empty table gives no rows and no
root; other columns are not read, whatever their names. Tasks write tables to the shared folder, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import bound_arrow_batches, broadcast_if_small, join_hot, materialise

FANOUT = 16
#: Rows below one node of this level (FANOUT ** CHUNK_LEVEL) are handled together when proofs are made.
CHUNK_LEVEL = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row: each field as its length in bytes, a colon and its value, or `-`."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def with_index(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, the place in the group's order from 0, and n, the rows of the group; ranges of the order instead of one sort.

    Rows that are alike in all of group and order may come in any order.
    """
    spread = rows.withColumn("_spread", F.rand(FANOUT))
    ranged = materialise(spread.repartitionByRange(group, *(F.col(c).asc_nulls_first() for c in order), "_spread").drop("_spread").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = materialise(ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows")), "range-sizes")
    # a row for each range of a group
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1
    ranked = ranged.withColumn("_rank", rank).join(broadcast_if_small(shifts, sizes.count(), 48), [group, "_range"])
    return ranked.withColumn("idx", (F.col("_rank") + F.col("_shift")).cast("long")).drop("_range", "_rank", "_shift")


class Mountains:
    """The open runs of all levels over consecutive nodes of one tree of n leaves."""

    def __init__(self, key: bytes, n: int):
        self.key, self.n = key, n
        self.open: list[tuple[int, list[str]]] = []  # for each level the first index and the hashes of the open run
        self.records: list[tuple] = []  # key, n, level, index, hash, peak

    def add(self, index: int, node: str, level: int = 0) -> None:
        """A node takes its place; a run that it completes is a node one level up."""
        size = self.size(level)
        while len(self.open) <= level:
            self.open.append((0, []))
        at, run = self.open[level]
        if size == 1 or (not run and index % FANOUT):
            # the top of the tree, or the run began elsewhere
            self.records.append((self.key, self.n, level, index, node, size > 1))
            return
        if not run:
            at = index
        run.append(node)
        if len(run) == FANOUT or index == size - 1:
            self.open[level] = (0, [])
            if level:
                self.records += [(self.key, self.n, level, at + k, x, False) for k, x in enumerate(run)]
            self.add(index // FANOUT, _hash(run), level + 1)
        else:
            self.open[level] = (at, run)

    def size(self, level: int) -> int:
        size = self.n
        for _ in range(level):
            size = -(-size // FANOUT)
        return size

    def close(self) -> list[tuple]:
        """All records; nodes of runs that are still open are peaks."""
        for level, (at, run) in enumerate(self.open):
            self.records += [(self.key, self.n, level, at + k, node, True) for k, node in enumerate(run)]
        self.open = []
        out, self.records = self.records, []
        return out


_RECORDS = "key binary, n long, level int, idx long, hash string, peak boolean"


def _mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, due = None, -1

    def table(records: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in records], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _RECORDS.split(", ")])

    for batch in batches:
        out = []
        for key, n, index, leaf in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now is None or key != now.key or index != due:
                out += now.close() if now else []
                now = Mountains(key, n)
            now.add(index, leaf)
            due = index + 1
        out += now.records if now else []
        if now:
            now.records = []
        yield table(out)
    if now:
        yield table(now.close())


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """key, n, level, idx and hash of all nodes above the leaves (key, n, idx, leaf)."""
    bound_arrow_batches(leaves.sparkSession)
    # files are read in order, so most rows of a task follow each other; where they do not, the runs are cut and merged as at any edge
    records = materialise(leaves.select("key", "n", "idx", "leaf").mapInArrow(_mountains, _RECORDS), "mountains")
    most = leaves.agg(F.max("n")).first()[0] or 0
    # peaks above the leaves are nodes as well
    done, carried, level, size = [records.where("level > 0").drop("peak")], None, 0, most
    while size > 1:
        peaks = records.where(F.col("peak") & (F.col("level") == level)).drop("peak")
        peaks = peaks.unionByName(carried) if carried is not None else peaks
        runs = peaks.groupBy("key", "n", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("run"))
        hashed = runs.select("key", "n", F.lit(level + 1).alias("level"), "idx", F.sha2(F.array_join(F.transform("run", lambda x: x["hash"]), ""), 256).alias("hash"))
        merged = materialise(hashed, "merged")
        done.append(merged)
        level, size = level + 1, -(-size // FANOUT)
        # the top of a tree has nothing to be merged with
        carried = merged.where(_size(F.col("n"), level) > 1)
    return reduce(DataFrame.unionByName, done)


def _size(n: Column, level: int) -> Column:
    """Nodes of a level of a tree of n leaves."""
    for _ in range(level):
        n = F.ceil(n / FANOUT)
    return n


def _height(n: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


_SIBLINGS = "array<struct<left:string,right:string>>"


def node_paths(nodes: DataFrame, most: int, lowest: int) -> DataFrame:
    """key, level, idx and path (siblings, upwards) of the nodes of level `lowest`, and of the tops of lower trees. most: leaves of the largest tree."""
    level = max(_height(most), lowest)
    nothing = F.array().cast(_SIBLINGS)
    tops = nodes.where(_size_at(F.col("n"), F.col("level")) == 1).select("key", "level", "idx", nothing.alias("path"))
    paths = tops.where(F.col("level") == level)
    while level > lowest:
        level -= 1
        runs = nodes.where((F.col("level") == level) & (_size(F.col("n"), level) > 1)).groupBy("key", F.floor(F.col("idx") / FANOUT).alias("above")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("run"))

        def told(run: Column) -> Column:
            def hashes(some: Column) -> Column:
                return F.array_join(F.transform(some, lambda x: x["hash"]), "")

            return F.transform(run, lambda x, i: F.struct(x["idx"].alias("idx"), hashes(F.slice(run, F.lit(1), i)).alias("left"), hashes(F.slice(run, i + 2, F.lit(FANOUT))).alias("right")))

        joined = runs.join(paths.select("key", F.col("idx").alias("above"), F.col("path").alias("up")), ["key", "above"]).select("key", F.explode(told(F.col("run"))).alias("x"), "up")
        below = joined.select("key", F.lit(level).alias("level"), "x.idx", F.concat(F.array(F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right"))), "up").cast(_SIBLINGS).alias("path"))
        paths = materialise(below.unionByName(tops.where(F.col("level") == level)), "paths")
    return paths.unionByName(tops.where(F.col("level") < lowest))


def _size_at(n: Column, level: Column) -> Column:
    """Nodes of a level, given as a column."""
    return F.ceil(n / F.pow(F.lit(float(FANOUT)), level))


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _hash([left, leaf, right])
    return leaf


_PROOFS = "doc_id long, key binary, leaf string, proof_sha256 string, folded_root string"


def _proved(key: bytes, n: int, path: list[tuple[str, str]], rows: list[tuple[int, str, str | None]]) -> pa.RecordBatch:
    """The rows below one node with their proofs and the roots that they give. path: the siblings from that node up."""
    levels = [[leaf for _, leaf, _ in rows]]
    while len(levels) <= CHUNK_LEVEL and n > 1:
        levels.append([_hash(levels[-1][k : k + FANOUT]) for k in range(0, len(levels[-1]), FANOUT)])
        n = -(-n // FANOUT)
    tail = "".join(a + b for a, b in path)
    proofs, roots = [], []
    for k, (_, leaf, tampered) in enumerate(rows):
        siblings = []
        for nodes in levels[:-1]:
            a = k // FANOUT * FANOUT
            siblings.append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + FANOUT])))
            k //= FANOUT
        proofs.append(_hash([x for s in siblings for x in s] + [tail]))
        roots.append(fold(leaf if tampered is None else tampered, siblings + path))
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([key] * len(rows), pa.binary()), pa.array(levels[0], pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PROOFS.split(", ")])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of node and index, each node's path (index -1) before its rows."""
    now, n, path, rows = (b"", -1), 0, [], []
    for batch in batches:
        for key, chunk, idx, size, doc, leaf, tampered, above in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, chunk) != now:
                if rows:
                    yield _proved(now[0], n, path, rows)
                now, path, rows = (key, chunk), [], []
            if idx < 0:
                path = [(x["left"], x["right"]) for x in above]
            else:
                n = size
                rows.append((doc, leaf, tampered))
    if rows:
        yield _proved(now[0], n, path, rows)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified.

    columns: id, source, other columns of the leaf, text last. tampered: the text that a row is verified with (null: its own).
    """
    id_, source, *_ = columns
    fields = [F.col(f"`{c}`") for c in columns]
    key = F.coalesce(F.concat(F.lit(b"="), F.encode(fields[1].cast("string"), "UTF-8")), F.lit(b""))
    changed = F.when(tampered.isNotNull() & ~tampered.eqNullSafe(fields[-1].cast("string")), leaf_hash(*fields[:-1], tampered)) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(fields[0].cast("long").alias("doc_id"), key.alias("key"), leaf_hash(*fields).alias("leaf"), changed.alias("tampered"))
    # written first, since ranges read their input twice; rows with one id and leaf have the same text, so the tampered leaf does not tell them apart
    leaves = materialise(with_index(materialise(rows, "hashed"), "key", ["doc_id", "leaf"]), "leaves")
    nodes = tree_nodes(leaves)
    singles = leaves.where("n = 1").select("key", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"))
    nodes = materialise(nodes.unionByName(singles), "nodes")
    most = leaves.agg(F.max("n")).first()[0]
    if not most:
        return leaves.select("doc_id", F.lit("").alias("source"), "leaf", *(F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    subroots = materialise(nodes.where(_size_at(F.col("n"), F.col("level")) == 1).select("key", F.col("n").alias("rows"), F.col("hash").alias("subroot")), "subroots")

    # the tree over the sources
    tops = materialise(with_index(subroots.select(F.lit(b"").alias("key"), F.col("key").alias("source"), F.col("subroot").alias("leaf")), "key", ["source"]), "tops")
    many = tops.first()["n"]
    upper = tree_nodes(tops).unionByName(tops.select("key", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash")))
    upper = materialise(upper, "upper")
    root = upper.where(_size_at(F.col("n"), F.col("level")) == 1).first()["hash"]
    over = node_paths(upper, many, 0).where("level = 0").select("idx", F.col("path").alias("over"))
    over = materialise(tops.join(over, "idx").select(F.col("source").alias("key"), "over", F.col("leaf").alias("subroot")).join(subroots.select("key", "rows"), "key"), "source-paths")

    # one path for each group of rows below a node of CHUNK_LEVEL, or a whole lower tree
    chunk = FANOUT**CHUNK_LEVEL
    inner = node_paths(nodes, most, CHUNK_LEVEL).select("key", F.when(F.col("level") == CHUNK_LEVEL, F.col("idx")).otherwise(0).alias("chunk"), "path")
    inner = materialise(inner, "chunk-paths")
    inner = join_hot(inner, over.select("key", "over", "rows"), "key", "rows", leaves.count() // chunk).select("key", "chunk", F.concat("path", "over").alias("path"))
    below = leaves.select("key", F.floor(F.col("idx") / chunk).alias("chunk"), "idx", "n", "doc_id", "leaf", "tampered", F.lit(None).cast(_SIBLINGS).alias("path"))
    nothing = (F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("doc_id", "long"), ("leaf", "string"), ("tampered", "string")))
    both = below.unionByName(inner.select("key", F.col("chunk").cast("long").alias("chunk"), F.lit(-1).cast("long").alias("idx"), *nothing, "path"))
    made = both.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "idx").mapInArrow(_prove, _PROOFS)
    named = join_hot(made, over.select("key", "subroot", "rows"), "key", "rows", leaves.count())
    name = F.when(F.col("key") != F.lit(b""), F.decode(F.substring("key", 2, 1 << 30), "UTF-8"))
    return named.select("doc_id", name.alias("source"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def _sql_tree(rows: str, group: str, level: int, name: str) -> str:
    """CTEs of one level of a tree: runs of the nodes, the nodes above, and the rows with siblings and fold carried up. Tables {name}n{level} and {rows}."""
    n, r = f"{name}n{level}", f"{rows}{level}"
    at = f"r.pos % {FANOUT}"
    return f""",
{name}g{level} AS (SELECT {group}, idx // {FANOUT} AS up, list(h ORDER BY idx) AS run FROM {n} GROUP BY {group}, idx // {FANOUT}),
{name}n{level + 1} AS (SELECT {group}, up AS idx, CASE WHEN c = 1 AND len(run) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS c FROM {name}g{level})),
{rows}{level + 1} AS (SELECT r.* REPLACE (r.pos // {FANOUT} AS pos, r.sib || CASE WHEN c = 1 AND len(run) = 1 THEN '' ELSE array_to_string(run[:{at}] || run[{at} + 2:], '') END AS sib,
    CASE WHEN c = 1 AND len(run) = 1 THEN r.fold ELSE sha256(array_to_string(run[:{at}], '') || r.fold || array_to_string(run[{at} + 2:], '')) END AS fold)
  FROM {r} r JOIN (SELECT *, count(*) OVER (PARTITION BY {group}) AS c FROM {name}g{level}) g ON r.{group} IS NOT DISTINCT FROM g.{group} AND r.pos // {FANOUT} = g.up)"""


def _sql(levels: int = 5) -> str:
    """The query in DuckDB's words, for sources of up to FANOUT ** levels rows."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, (*COLUMNS[:-1], text))) + ")"
    # the table of the checksum by its rule, then a fold over the digits
    table = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, d: xor(c >> 8, tab[(xor(c, d) & 255) + 1])))"
    out = f"""WITH d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, {table} AS tab FROM documents),
leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf("low")} ELSE {leaf("text")} END AS fold FROM d),
r0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS sib FROM leaves),
sn0 AS (SELECT source, pos AS idx, leaf AS h FROM r0)"""
    for k in range(levels):
        out += _sql_tree("r", "source", k, "s")
    out += f""",
tops AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, 0 AS one FROM sn{levels}),
tn0 AS (SELECT one, idx, h FROM tops),
t0 AS (SELECT r.* REPLACE (tops.idx AS pos), tops.h AS subroot, 0 AS one FROM r{levels} r JOIN tops ON r.source IS NOT DISTINCT FROM tops.source)"""
    for k in range(levels):
        out += _sql_tree("t", "one", k, "t")
    return out + f"""
SELECT doc_id, leaf, subroot, n.h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = n.h AS verified FROM t{levels} CROSS JOIN tn{levels} n"""


ORACLE_SQL = _sql()


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Query: the manifest of all documents; those whose id has a checksum that 5 divides are verified with a lower-cased text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered(F.col("text")))
    return manifest(docs, tampered=tampered).drop("source")
