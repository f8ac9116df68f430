"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target number of words; a document is to be taken target / (words of its source) times, which is a whole number of
copies and a fraction that is the same for the source. The fractions are rounded so that the words taken stay what they are to be:

1. Documents of a source are dealt into classes by size (half octaves) and, by hash, into leaves of about LEAF documents. In a leaf the
   documents are paired one after the other: of the pair, a random one hands words to the other until one of the two is whole
   (taken or not), the other goes on. The chances are such that each document's expectation stays what it was; the words of the
   pair stay the same exactly, whatever the sizes. One document of a leaf is left with a fraction.
2. What is left of LEAF leaves is rounded together in the same way, and so on: a reduction tree of a few levels, of a LEAF-th of the rows each.
3. Of each class of a source one document is left, a few dozen. They are settled from the largest down: a document is taken or
   not by chance, as long as the smaller ones can make up for the words too many or too few, else as they can. What remains is
   about half of the smallest such document: the words taken of a source come that near to its target.

All draws are hashes of the document's key and a seed, so reruns agree, however the rows are partitioned.

Targets: sources by code point (null last) weigh `weights` in turn and share the words of all documents; no target exceeds `most` times
its source's words, and what is over goes to the others by weight. That is one level for all weights, found in a few rounds
over the table of sources. A document's copies never exceed `most`, rounded up.

No group is gathered but leaves, which have LEAF documents on average (the hash is of the row's key and its number among equal rows) and
residuals of LEAF leaves, or the classes of a source. A hot source is split into leaves like all others; its numbers reach its rows by
join_hot. Tables of sources are shuffled or, within the checked size, broadcast.

Defined cases: null and empty texts have size 0, are taken 0 words and (copies) by chance; a null source is a source, the last one; rows that
repeat are rounded each on its own; a source without words has target 0; very long texts are counted whole; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import broadcast_if_small, join_hot, materialise

WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents of a leaf, on average, and residuals that are rounded together.
LEAF = 64
SEED = 12


def count_words(text: Column) -> Column:
    """Number of words between ASCII white space: each word with the white space after it becomes one character."""
    lead = F.ltrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.length(F.regexp_replace(lead, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (key, n, words) with weight and target. Keys are in order; ranks over ranges of them, so that no task sorts them all."""
    ranged = materialise(sources.repartitionByRange(F.col("key")).withColumn("range", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    # a row for each partition
    before = sizes.withColumn("shift", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    ranked = ranged.withColumn("place", rank).join(F.broadcast(before), "range").withColumn("place", F.col("place") + F.col("shift"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    out = materialise(ranked.select("key", "n", "words", pick.cast("double").alias("weight"), (F.lit(float(most)) * F.col("words")).alias("cap")), "weights")
    total = out.agg(F.sum("words")).first()[0] or 0
    level, capped = 0.0, -1
    # whoever is above its cap at a level stays so at the next, higher one
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        now = out.agg(F.count_if(over).alias("c"), F.sum(F.when(over, F.col("cap"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if now.c == capped or not now.w:
            break
        capped, level = now.c, (total - (now.held or 0.0)) / now.w
    return out.select("key", "n", "words", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _draw(*salt: Column | int) -> Column:
    """A number from 0 to below 1, the same for the same salt."""
    hashed = F.xxhash64(*(x if isinstance(x, Column) else F.lit(x) for x in salt))
    return hashed.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


_STATE = "struct<taken:array<int>,at:int,mass:double>"


def _pivot(items: Column, level: int) -> Column:
    """(taken, at, mass): places (from 1) of the items that end up taken, and the item that is left with its words. Items have size a, words m and hash h."""

    def step(acc: Column, k: Column) -> Column:
        x, y = F.get(items, acc["at"] - 1), F.get(items, k - 1)
        return F.transform(F.array(F.struct(acc["mass"].alias("m1"), (x["a"] - acc["mass"]).alias("r1"), y["m"].alias("m2"), (y["a"] - y["m"]).alias("r2"))), lambda v: move(acc, k, y["h"], v))[0]

    def move(acc: Column, k: Column, h: Column, v: Column) -> Column:
        up, down = F.least(v["r1"], v["m2"]), F.least(v["m1"], v["r2"])
        # up: the first gains and the second loses; chances in inverse proportion to the words, so that expectations stay
        gains = F.when(up + down <= 0, v["r1"] <= 0).otherwise(_draw(h, SEED, level) * (up + down) < down)
        first_in, first_out = gains & (v["r1"] <= v["m2"]), ~gains & (v["m1"] <= v["r2"])
        second_in = ~gains & ~first_out
        taken = F.when(first_in, F.concat(acc["taken"], F.array(acc["at"]))).when(second_in, F.concat(acc["taken"], F.array(k))).otherwise(acc["taken"])
        mass = F.when(first_in, v["m2"] - v["r1"]).when(first_out, v["m2"] + v["m1"]).when(second_in, v["m1"] - v["r2"]).otherwise(v["m1"] + v["m2"])
        return F.struct(taken.alias("taken"), F.when(first_in | first_out, k).otherwise(acc["at"]).alias("at"), mass.alias("mass")).cast(_STATE)

    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(1).alias("at"), F.get(items, F.lit(0))["m"].alias("mass")).cast(_STATE)
    return F.aggregate(F.slice(F.sequence(F.lit(1), F.size(items)), 2, F.size(items)), start, step)


_ITEM = ("a", "m", "h", "doc_id", "base")


def _rounded(rows: DataFrame, level: int) -> DataFrame:
    """The leaves of rows (key, class, part and an item): items, which are whole and which is left."""
    leaves = rows.groupBy("key", "class", "part").agg(F.array_sort(F.collect_list(F.struct(*_ITEM))).alias("items"))
    # a table on its own step, so that the fold is made once
    return leaves.withColumn("end", _pivot(F.col("items"), level))


def _settled(leaves: DataFrame) -> DataFrame:
    """doc_id, key, size and copies of all items that are whole."""
    rows = leaves.select("key", "end", F.posexplode("items").alias("k", "x")).where("k + 1 <> end.at")
    return rows.select("key", "x.doc_id", F.col("x.a").cast("long").alias("size"), (F.col("x.base") + F.array_contains("end.taken", F.col("k") + 1).cast("int")).alias("copies"))


def _left(leaves: DataFrame) -> DataFrame:
    """The items that are left, with their words, for the next level."""
    x = F.get("items", F.col("end.at") - 1)
    return leaves.select("key", "class", F.floor(F.col("part") / LEAF).alias("part"), x["a"].alias("a"), F.col("end.mass").alias("m"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["base"].alias("base"))


_LANDING = "struct<taken:array<int>,over:double,rest:double,room:double>"


def _landed(rows: DataFrame) -> DataFrame:
    """doc_id, key, size and copies of what is left of the classes of each source, settled from the largest down."""
    groups = rows.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list(F.struct(*_ITEM)))).alias("items"))
    items = F.col("items")

    def step(acc: Column, k: Column) -> Column:
        return F.transform(F.array(F.get(items, k - 1)), lambda x: settle(acc, k, x))[0]

    def settle(acc: Column, k: Column, x: Column) -> Column:
        # over: words taken too many so far; rest and room: words that smaller ones can still lose and gain
        rest, room = acc["rest"] - x["m"], acc["room"] - (x["a"] - x["m"])
        if_taken, if_not = acc["over"] + x["a"] - x["m"], acc["over"] - x["m"]
        short, long_ = F.greatest(-if_not - room, F.lit(0.0)), F.greatest(if_taken - rest, F.lit(0.0))
        chance = _draw(x["h"], SEED, -1) * x["a"] < x["m"] - acc["over"]
        take = F.when((short <= 0) & (long_ <= 0), chance).otherwise(long_ < short)
        return F.struct(F.when(take, F.concat(acc["taken"], F.array(k))).otherwise(acc["taken"]).alias("taken"), F.when(take, if_taken).otherwise(if_not).alias("over"), rest.alias("rest"), room.alias("room")).cast(_LANDING)

    zero = F.lit(0.0)
    start = F.struct(F.array().cast("array<int>").alias("taken"), zero.alias("over"), F.aggregate(items, zero, lambda s, x: s + x["m"]).alias("rest"), F.aggregate(items, zero, lambda s, x: s + x["a"] - x["m"]).alias("room")).cast(_LANDING)
    done = groups.select("key", "items", F.aggregate(F.sequence(F.lit(1), F.size(items)), start, step)["taken"].alias("taken"))
    rows = done.select("key", "taken", F.posexplode("items").alias("k", "x"))
    return rows.select("key", "x.doc_id", F.col("x.a").cast("long").alias("size"), (F.col("x.base") + F.array_contains("taken", F.col("k") + 1).cast("int")).alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (of its source), copies and taken (words)."""
    source = F.col(f"`{source_col}`").cast("string")
    # null is the last one by code point: no text begins with a byte of all ones
    key = F.coalesce(F.concat(F.lit(b"="), F.encode(source, "UTF-8")), F.lit(b"\xff"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key.alias("key"), count_words(F.col(f"`{text_col}`").cast("string")).alias("size"))
    # rows that repeat are told apart by number
    rows = materialise(rows.groupBy("doc_id", "key", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    octave = F.when(F.col("size") > 0, F.floor(2 * F.log2(F.col("size").cast("double"))).cast("int")).otherwise(-1)
    rows = rows.withColumn("class", octave)
    classes = materialise(rows.groupBy("key", "class").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("size")).alias("words")), "classes")
    sources = materialise(classes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("classes")), "source-sizes")
    targets = materialise(source_targets(sources.select("key", "n", "words"), weights, most), "targets")
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    base = F.floor(rate).cast("int")
    told = targets.join(sources.select("key", "classes"), "key").select("key", "n", "words", "target", base.alias("base"), (rate - base).alias("fraction"), "classes")
    dealt = join_hot(rows, materialise(told, "rates"), "key", "n", sources.agg(F.sum("n")).first()[0] or 0)
    h = F.xxhash64("doc_id", "key", "size", "number", F.lit(SEED))
    dealt = dealt.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).withColumn("h", h)
    parts = F.ceil(F.element_at("classes", F.col("class")) / LEAF)
    dealt = dealt.withColumn("part", F.pmod("h", parts))
    chance = (F.col("size") > 0) & (F.col("fraction") > 0)
    # documents without words are taken by chance, and none is where the source's copies are whole
    whole = dealt.where(~chance).select("key", "doc_id", "size", (F.col("base") + (_draw(F.col("h"), SEED, -2) < F.col("fraction")).cast("int")).alias("copies"))
    a = F.col("size").cast("double")
    items = dealt.where(chance).select("key", "class", "part", a.alias("a"), (a * F.col("fraction")).alias("m"), "h", "doc_id", "base")
    done, level = [whole], 0
    leaves_left = math.ceil((classes.agg(F.max("n")).first()[0] or 0) / LEAF)
    while True:
        leaves = materialise(_rounded(items, level), "leaves")
        done.append(_settled(leaves))
        items = _left(leaves)
        if leaves_left <= 1:
            break
        leaves_left, level = math.ceil(leaves_left / LEAF), level + 1
    done.append(_landed(items))
    out = reduce(DataFrame.unionByName, done)
    mixed = join_hot(out, targets, "key", "n", sources.agg(F.sum("n")).first()[0] or 0)
    name = F.when(F.col("key") != F.lit(b"\xff"), F.decode(F.substring("key", 2, 1 << 30), "UTF-8"))
    return mixed.select("doc_id", name.alias("source"), "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns unchanged. Rows that repeat (id, source and size) share what is taken of them."""
    source = F.col(f"`{source_col}`").cast("string")
    copies = mix_sources(docs, id_col, text_col, source_col, weights, most).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    copies = materialise(copies.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"), F.col("rows").alias("_mix_rows")), "copies")
    found = docs.join(copies, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_mix_id")) & source.eqNullSafe(F.col("_mix_source")) & (count_words(F.col(f"`{text_col}`").cast("string")) == F.col("_mix_size")))
    # of rows that repeat the first ones get one copy more, where the copies do not divide
    number = F.row_number().over(Window.partitionBy("_mix_id", "_mix_source", "_mix_size").orderBy(F.lit(1)))
    found = found.withColumn("_mix_n", number)
    times = F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + (F.col("_mix_n") <= F.col("_mix_copies") % F.col("_mix_rows")).cast("int")
    return found.withColumn("_mix_k", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    """Query: all documents mixed, sources by weights 1, 2, 3 in turn."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
