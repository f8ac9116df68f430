"""Quotation linking: messages find what they answer by the passages they quote; conversations come out in reply order.

1. Each line's quote level is the number of `>` marks before it. A maximal run of lines of one level is a passage; its
   normalised text (white space collapsed, lower case) is hashed. Unmarked runs are the message's own passages.
2. Quoted passages are joined by (conversation, hash) to own passages of earlier messages: whole passages, their paragraphs (blank
   lines apart) and their single lines, on both sides. Of a passage's units the largest kind that is found decides; of the earlier
   messages found (for each unit the latest that has it), the one with most characters of that kind is quoted, then the latest. Of a
   message's passages, the least nested ones decide what it answers, then the largest kind, then the latest message.
3. Messages that answer nothing start a thread. A thread's root is found by pointer doubling over the messages that answer.
   The order is by root, then by turn: every message comes after the one that it answers. Positions are ranks in two
   levels over turn ranges, so a conversation of any length is never gathered in one task.

DataFrame functions only. The join of quoted and own passages is an as-of join in two levels, so a passage that many messages
have and quote makes no pairs.

Defined cases: null text is an empty message that quotes nothing; a message of quotes only has empty text; a quote that no
earlier message has is counted but links nothing; equal passages link to the latest earlier turn; rows that repeat (conversation,
turn) are kept, with positions of their own, and answer the same message; very long messages, lines and runs of marks are parsed whole; an
empty table gives no rows; rows with a null conversation or turn are kept with null position; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import join_hot, materialise, two_level_rank

#: Turns that one task ranks together.
TURN_RANGE = 1024
_MARK = "\x01"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _parsed(text: Column) -> Column:
    """For each line its level, the marks among the marks and blanks that it begins with, and what follows the last mark and one blank."""

    def line(raw: Column) -> Column:
        marks = F.regexp_replace(F.regexp_extract(raw, r"^[\x20\x09>]*", 0), r"[\x20\x09]+", "")
        return F.struct(F.length(marks).alias("level"), F.regexp_replace(raw, r"^[\x20\x09>]*>[\x20\x09]?", "").alias("body"))

    return F.transform(F.split(text, r"\r?\n", -1), line)


def _passages(lines: Column) -> Column:
    """Maximal runs of one level as (level, text), with line feeds kept; blank texts dropped. Linear in the lines."""

    def runs(x: Column, starts: Column) -> Column:
        def run(s: Column, k: Column) -> Column:
            after = F.coalesce(F.get(starts, k + 1), F.size(x) + 1)
            return F.struct(F.get(x, s - 1)["level"].alias("level"), F.array_join(F.transform(F.slice(x, s, after - s), lambda y: y["body"]), "\n").alias("text"))

        return F.transform(starts, run)

    def begins(x: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.get(x, i - 1)["level"] != F.get(x, i - 2)["level"]))

    # lines and starts are bound by lambdas, so that they are made once
    whole = F.transform(F.array(lines), lambda x: F.transform(F.array(begins(x)), lambda starts: runs(x, starts))[0])[0]
    return F.filter(whole, lambda p: _normal(p["text"]) != "")


def _units(passage: Column) -> Column:
    """A passage, its paragraphs and its lines as (kind, text): 2, 1 and 0."""
    # each blank line becomes a mark, and paragraphs are what lies between marks: no pattern that repeats a group
    lines = F.transform(F.split(F.translate(passage, _MARK, " "), "\n", -1), lambda x: F.when(F.trim(x, F.lit(" \t\r")) == "", F.lit(_MARK)).otherwise(x))
    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), _MARK, -1), lambda x: F.trim(x, F.lit("\n")) != "")
    parts = [F.array(passage), paragraphs, F.split(passage, r"\r?\n", -1)]

    def of(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), _normal(t).alias("text")))

    return F.concat(*(of(kind, x) for kind, x in zip((2, 1, 0), parts, strict=True)))


def _latest_before(quotes: DataFrame, own: DataFrame) -> DataFrame:
    """quotes with `source`, the latest turn before theirs in which the conversation has the passage; those without one are dropped.

    An as-of join in two levels: within ranges of turns by a window over both sides, across ranges by the ranges' last turns.
    """
    keys = ["conv", "hash"]
    both = quotes.select(*keys, "turn", "level").unionByName(own.select(*keys, "turn", F.lit(None).cast("int").alias("level")))
    both = both.withColumn("range", F.floor(F.col("turn") / TURN_RANGE)).withColumn("has", F.when(F.col("level").isNull(), F.col("turn")))
    ends = both.groupBy(*keys, "range").agg(F.max("has").alias("end"))
    carried = ends.withColumn("carry", F.max("end").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    # at one turn the quotes come first: a passage is quoted from an earlier turn only
    near = F.max("has").over(Window.partitionBy(*keys, "range").orderBy("turn", F.col("level").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("near", near).where("level is not null").join(carried, [*keys, "range"])
    return rows.withColumn("source", F.coalesce("near", "carry")).where("source is not null").select("conv", "turn", "level", "hash", "source")


def link_quotations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text_col: str = "text", extra: tuple[str, ...] = ("role",)) -> DataFrame:
    """One row per message: conversation, turn, extra columns, text without quotes, n_quotes, max_level, n_linked, reply_to, root and position."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = messages.select(F.col(conversation).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *(F.col(c).alias(f"x_{c}") for c in extra), text.alias("raw"))
    base = base.withColumn("lines", F.when(F.col("raw").rlike(r"(?m)^[\x20\x09]*>"), _parsed(F.col("raw"))))
    # most messages quote nothing and are one passage
    base = base.withColumn("passages", F.when(F.col("lines").isNotNull(), _passages(F.col("lines"))).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("level"), F.col("raw").alias("text"))), lambda p: _normal(p["text"]) != "")))
    base = base.withColumn("clean", F.when(F.col("lines").isNotNull(), F.trim(F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n"), F.lit(" \t\r\n"))).otherwise(F.col("raw")))
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    base = base.withColumn("n_quotes", F.size(quoted)).withColumn("max_level", F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)))
    base = materialise(base.drop("lines"), "messages")

    quotes = base.where("n_quotes > 0 and conv is not null and turn is not null").select("conv", "turn", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p")).select("conv", "turn", F.col("p.level").alias("level"), F.xxhash64(_normal(F.col("p.text"))).alias("passage"), F.col("p.text").alias("text")).dropDuplicates(["conv", "turn", "level", "passage"])
    units = quotes.select("conv", "turn", "level", "passage", F.explode(_units(F.col("text"))).alias("u")).where("u.text <> ''").groupBy("conv", "turn", "level", "passage", F.xxhash64("u.text").alias("hash")).agg(F.max("u.kind").alias("kind"), F.max(F.length("u.text")).alias("chars"))
    units = materialise(units, "quoted")
    wanted = units.select("conv", "hash").distinct()
    texts = F.array_distinct(F.transform(F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: _units(p["text"]))), lambda u: u["text"]))
    own = base.where("conv is not null and turn is not null").select("conv", "turn", F.explode(texts).alias("n")).where("n <> ''").select("conv", F.xxhash64("n").alias("hash"), "turn").distinct()
    own = own.join(wanted, ["conv", "hash"], "left_semi")
    linked = _latest_before(units.select("conv", "turn", "level", "hash").distinct(), own).join(units, ["conv", "turn", "level", "hash"])
    shares = linked.groupBy("conv", "turn", "level", "passage", "kind", "source").agg(F.sum("chars").alias("chars"))
    linked = shares.groupBy("conv", "turn", "level", "passage").agg(F.max(F.struct("kind", "chars", "source")).alias("m")).select("conv", "turn", "level", "m.kind", "m.source")
    answers = linked.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "kind", "source"))["source"].alias("reply_to"), F.count(F.lit(1)).alias("n_linked"))
    answers = materialise(answers, "answers")

    # pointer doubling: each message that answers points at an ancestor, at first at what it answers
    up, total = answers.select("conv", "turn", F.col("reply_to").alias("root")), answers.count()
    while total:
        # a message that many answer is one key
        keyed = up.withColumn("place", F.struct("conv", "root"))
        fans = keyed.groupBy("place").agg(F.count(F.lit(1)).alias("fan"))
        above = up.select(F.struct("conv", F.col("turn").alias("root")).alias("place"), F.col("root").alias("higher")).join(fans, "place")
        moved = materialise(join_hot(keyed, above, "place", "fan", total).select("conv", "turn", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "threads")
        up = moved.select("conv", "turn", "root")
        if moved.where("moved").isEmpty():
            break

    rows = base.select("conv", "turn", *(f"x_{c}" for c in extra), "clean", "n_quotes", "max_level").join(answers.join(up, ["conv", "turn"]), ["conv", "turn"], "left")
    rows = rows.withColumn("root", F.coalesce("root", "turn")).withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    order = [F.col("root"), F.col("turn"), F.col("clean"), *(F.col(f"x_{c}") for c in extra)]
    # parts are ranges of the order of the rows, written so that a part stays what it is
    whole = rows.where("conv is not null and turn is not null").repartitionByRange("conv", "root", "turn").withColumn("range", F.spark_partition_id())
    ranked = two_level_rank(materialise(whole, "ordered"), ["conv"], order, F.col("range"), "position").drop("range")
    rest = rows.where("conv is null or turn is null").withColumn("position", F.lit(None).cast("long"))
    out = ranked.unionByName(rest.select(*ranked.columns))
    return out.select(F.col("conv").alias("conv_id"), "position", "turn", *(F.col(f"x_{c}").alias(c) for c in extra), F.col("clean").alias("text"), "n_quotes", "max_level", "n_linked", "reply_to", "root")


def build_conversations(linked: DataFrame, per_part: int = 256) -> DataFrame:
    """Conversations in reply order, in parts of at most per_part messages: conv_id, part, messages (position, turn, role, text)."""
    message = F.struct("position", "turn", "role", "text")
    parts = linked.where("position is not null").groupBy("conv_id", F.floor(F.col("position") / per_part).alias("part"))
    return parts.agg(F.array_sort(F.collect_list(message)).alias("messages"))


def op5_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """Query: all conversations in reply order, without quotes."""
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
