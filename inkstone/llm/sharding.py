"""Sharding by a minimax contiguous partition of atomic groups (equal texts), with DataFrame functions only.

Groups are ordered by their total size, largest first, and cut into consecutive shards. The least capacity that fits the
groups into the shards that are left is found by binary search with a greedy check, the next shard is cut there, and the
search goes on with the rest; so a group above the fair share takes one shard and does not widen the others.
In this order, groups of one size are a run, so the search needs only (size, groups) pairs: their number is at most
sqrt(2 * total bytes), about the length range of the texts, whatever the number of documents. Runs that a cut divides (fewer
than shards) are divided by rank of the text's digest.

A group's rows find its shard by digest: groups with over 1/1024 of the rows by broadcast (1024 at most), the others by a shuffle.
Slots are ranks in two levels, so that no task sorts a shard.

Defined cases: null text has size `overhead` and the null checksum 0, and all nulls are one group; empty text is a group of its
own; equal sizes are ordered by digest, rows of a group by id; repeated rows share a shard and have slots of their own;
a very long text is
one group, whole; an empty table gives no rows; more shards than groups leaves shards empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import broadcast_if_small, join_hot, materialise, two_level_rank

SHARDS = 40
OVERHEAD = 16
#: Rows that one task ranks, about.
PART_ROWS = 4096


def _fits(runs: list[tuple[int, int]], at: int, done: int, shards: int, capacity: int) -> bool:
    """Whether the groups from (run at, group done) on fit greedily into so many shards of the capacity."""
    free, left = 0, shards
    for size, count in _from(runs, at, done):
        if size > capacity:
            return False
        take = min(count, free // size)
        count -= take
        free -= take * size
        if count:
            per = capacity // size
            need = -(-count // per)
            left -= need
            if left < 0:
                return False
            free = capacity - (count - (need - 1) * per) * size
    return True


def _from(runs: list[tuple[int, int]], at: int, done: int):
    for i in range(at, len(runs)):
        size, count = runs[i]
        yield size, count - (done if i == at else 0)


def minimax_cuts(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, first group, end group, shard): where the runs of (size, groups), in order, go; contiguous and least in the largest shard, then in the next."""
    runs = [(s, n) for s, n in runs if n]
    out, at, done = [], 0, 0
    left = sum(s * n for s, n in runs)
    for shard in range(shards):
        if at == len(runs):
            break
        k = shards - shard
        low, high = max(runs[at][0], -(-left // k)), left
        while low < high:
            mid = (low + high) // 2
            if _fits(runs, at, done, k, mid):
                high = mid
            else:
                low = mid + 1
        free = low
        while at < len(runs):
            size, count = runs[at]
            take = min(count - done, free // size)
            if take:
                out.append((size, done, done + take, shard))
                free -= take * size
                left -= take * size
                done += take
            if done < count:
                break
            at, done = at + 1, 0
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot (its place in the shard)."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null")).alias("digest"),
    )
    base = materialise(base, "sizes")
    groups = materialise(base.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "groups")
    total = base.count()
    runs = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).collect()]
    cuts = minimax_cuts(runs, shards)
    counts = dict(runs)
    fits = [(c[0], c[3]) for c in cuts if (c[1], c[2]) == (0, counts[c[0]])]
    split_sizes = {c[0] for c in cuts} - {size for size, _ in fits}
    whole = spark.createDataFrame(fits, "bytes long, shard int")
    split = spark.createDataFrame([(c[0], c[1], c[2] - 1, c[3]) for c in cuts if c[0] in split_sizes], "bytes long, low long, high long, shard int")
    # at most one row for each distinct size, and two for each cut
    plain = groups.join(broadcast_if_small(whole, len(fits), 16), "bytes")
    inner = groups.where(F.col("bytes").isin(sorted(split_sizes)))
    parts = max(1, total // PART_ROWS)
    ranked = two_level_rank(inner, ["bytes"], [F.col("digest")], F.pmod(F.xxhash64("digest"), F.lit(parts)), "place")
    divided = ranked.join(F.broadcast(split), "bytes").where("place between low and high")
    placed = plain.select("digest", "n", "shard").unionByName(divided.select("digest", "n", "shard"))
    rows = join_hot(base, placed, "digest", "n", total)
    parts = max(1, -(-total // (shards * PART_ROWS))) * 16
    slotted = two_level_rank(rows, ["shard"], [F.col("doc_id"), F.col("digest")], F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)), "slot")
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot")


def op4_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    """Query: all documents in 40 shards of nearly equal bytes."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
