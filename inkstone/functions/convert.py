"""Script conversion: configurations, options, labels, punctuation, and staged dictionary conversion.

Dictionaries are input data: rows (config, stage, key, value). Each stage replaces, from left to right, the longest key
that matches, within Catalyst: keys are found by a pattern made from their tree, values looked up by hash. No dictionaries are shipped;
`icu_char_tables` builds simplified/traditional character tables from the ICU library that comes with Spark, as a fallback.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charsets as cs
from . import text as tx

_IDS = {name: i + 1 for i, name in enumerate(cs.CONFIGS)}


def config_id(name: Column) -> Column:
    """The id of a configuration name, whatever its ASCII case; s2t for unknown names."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in _IDS.items() for x in kv))[F.lower(name)], F.lit(1))


def config_name(number: Column) -> Column:
    return F.when(is_config_id(number), F.element_at(F.array(*map(F.lit, cs.CONFIGS)), F.when(is_config_id(number), number).otherwise(1))).otherwise(F.lit("s2t"))


def is_config_id(number: Column) -> Column:
    return F.coalesce(number.between(1, len(cs.CONFIGS)), F.lit(False))


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for n, i in _IDS.items()], "id int, name string")


@dataclass(frozen=True)
class Options:
    """Interactive choices; `resolve` gives the configuration."""

    direction: str = "s2t"
    region: str = "std"  # std, hk or tw
    idioms: bool | None = None  # None: as the region has them
    manual: str | None = None

    def resolve(self) -> str:
        if self.manual:
            return self.manual if self.manual in _IDS else "s2t"
        # asking for idioms selects Taiwan
        region = "tw" if self.idioms else self.region
        if region == "std":
            return self.direction
        idioms = "p" if region == "tw" and self.idioms is not False else ""
        return f"s2{region}{idioms}" if self.direction == "s2t" else f"{region}2s{idioms}"


def resolve_config(direction: Column, region: Column, idioms: Column) -> Column:
    """The configuration name for columns of options, as Options.resolve has it: asking for idioms selects Taiwan, NULL is as the region has them."""
    where = F.when(F.coalesce(idioms, F.lit(False)), F.lit("tw")).otherwise(region)
    p = F.when((where == "tw") & F.coalesce(idioms, F.lit(True)), F.lit("p")).otherwise(F.lit(""))
    named = F.when(direction == "s2t", F.concat(F.lit("s2"), where, p)).otherwise(F.concat(where, F.lit("2s"), p))
    return F.when(where == "std", direction).otherwise(named)


def convert_punctuation(t: Column, config: str) -> Column:
    """Quotation marks for a configuration: corner brackets from simplified, curly quotes otherwise."""
    return F.translate(t, "“”‘’", "「」『』") if config.startswith("s") else F.translate(t, "「」『』", "“”‘’")


def convert_chars(t: Column, source: str, target: str) -> Column:
    return F.translate(t, source, target)


def script_code(t: Column, simplified: str, traditional: str) -> Column:
    """1 if the text has characters that only traditional script has, else 2 if it has such of simplified, else 0; NULL gives -1.

    The two strings are a one-to-one character table.
    """
    to_s, to_t = F.translate(t, traditional, simplified), F.translate(t, simplified, traditional)
    return F.when(t.isNull(), F.lit(-1)).when(to_s != t, F.lit(1)).when(to_t != t, F.lit(2)).otherwise(F.lit(0))


def script_label(code: Column) -> Column:
    return F.when(code == 2, F.lit("zh-Hans (简体)")).when(code == 1, F.lit("zh-Hant (繁体)")).when(code == -1, F.lit("unknown (未知)")).otherwise(F.lit("non-zho （其它）"))


def auto_direction(code: Column) -> Column:
    """The direction that a detected script suggests; NULL leaves the choice as it is."""
    return F.when(code == 2, F.lit("s2t")).when(code == 1, F.lit("t2s"))


def destination_label(source_label: Column, direction: Column, manual: Column) -> Column:
    return F.when(manual.isNotNull(), manual).when(F.contains(source_label, F.lit("non")), F.lit("non-zho")).when(direction == "s2t", F.lit("zh-Hant (繁体)")).otherwise(F.lit("zh-Hans (简体)"))


def char_count_label(t: Column) -> Column:
    return F.format_number(tx.utf16_length(t), 0)


# --- dictionaries ----------------------------------------------------------------------------------------------------


def _plain(c: str) -> str:
    """A character as a pattern. Spark compares a pattern as a whole for every row, so it is kept short."""
    return c if c.isalnum() else rf"\x{{{ord(c):X}}}"


def _among(chars: list[str]) -> str:
    """The inside of a class for a stretch of sorted characters."""
    return f"{_plain(chars[0])}-{_plain(chars[-1])}"


def _fork(branches: dict[str, str]) -> str:
    """A pattern that goes on by the first character: halves of the sorted characters are told apart by looking ahead, so that thousands take a dozen steps."""
    chars = sorted(branches)
    if len(chars) <= 3:
        return "|".join(_plain(c) + branches[c] for c in chars)
    half = len(chars) // 2
    low, high = chars[:half], chars[half:]
    return rf"(?=[{_among(low)}])(?:{_fork({c: branches[c] for c in low})})|(?=[{_among(high)}])(?:{_fork({c: branches[c] for c in high})})"


def longest_match(keys: Iterable[str]) -> str:
    """A pattern that matches the longest of the keys at a place: their tree, in which branches exclude each other and longer keys come first."""
    tree: dict = {}
    for key in keys:
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[""] = True

    def pattern(node: dict) -> str:
        branches = {c: pattern(child) for c, child in node.items() if c}
        if not branches:
            return ""
        return f"(?:{_fork(branches)})" + ("?" if "" in node else "")

    return pattern({c: n for c, n in tree.items() if c})


@dataclass
class Stages:
    """The stages of a configuration: for each its keys and their values."""

    entries: list[dict[str, str]]


def load_dictionary(dictionary: DataFrame, config: str) -> Stages:
    """The stages of one configuration. Rows: config, stage, key, value; of a key's values in a stage the greatest one counts, empty keys do nothing.

    A dictionary becomes part of the plan, as a pattern and a table, so the driver reads it; a hundred thousand entries are a few MB.
    """
    rows = dictionary.where((F.col("config") == config) & (F.col("key") != "")).groupBy("stage", "key").agg(F.max("value").alias("value"))
    stages: dict[int, dict[str, str]] = {}
    for stage, key, value in zip(*rows.toArrow().to_pydict().values(), strict=True):
        stages.setdefault(stage, {})[key] = value or ""
    return Stages([stages[s] for s in sorted(stages)])


#: Around keys that are found; texts that hold one of them take the slower way.
_BEGIN, _END = "\uf8fe", "\uf8ff"


def _hash(key: str) -> int:
    return zlib.crc32(key.encode())


def _lookup(table: dict[str, str]) -> tuple[Column, Callable[[Column, Column], Column]]:
    """A constant array and a function of it and of keys of the table, which gives their values: the array that has at the place of a key's checksum the few entries with it, so that a look-up takes one step."""
    many = 1 << max(4, (len(table) - 1).bit_length())
    used = set("".join(table)) | set("".join(table.values()))
    # characters for private use, of which no text of the table has any, part buckets, entries, and keys from values
    marks = [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used][:3]
    buckets: list[list[str]] = [[] for _ in range(many)]
    for k, v in table.items():
        buckets[_hash(k) % many].append(marks[1] + k + marks[2] + v)
    # a split of a literal is folded into an array literal
    constant = F.split(F.lit(marks[0].join(map("".join, buckets))), marks[0], -1)

    def value(buckets: Column, key: Column) -> Column:
        # what stands behind the key, up to the next entry
        bucket = F.get(buckets, F.pmod(F.crc32(key), F.lit(many)).cast("int"))
        behind = F.call_function("substring_index", bucket, F.concat(F.lit(marks[1]), key, F.lit(marks[2])), F.lit(-1))
        return F.substring_index(behind, marks[1], 1)

    return constant, value


def converter(stages: Stages, config: str, punctuation: bool = False) -> Callable[[Column], Column]:
    """A Column function that converts text by the stages, and the quotation marks if asked for. Empty text stays empty, NULL stays NULL.

    A stage finds its keys by one pattern; what lies between them stays. Keys of one character with values of one are a translation.
    """

    def staged(table: dict[str, str]) -> Callable[[Column], Column]:
        if all(len(k) == len(v) == 1 for k, v in table.items()):
            return lambda t: F.translate(t, "".join(table), "".join(table.values()))
        constant, look_up = _lookup(table)
        # bound, since the plan, of which the driver writes several copies, would have both again at each place that uses them
        tools = F.struct(F.lit(longest_match(table)).alias("pattern"), constant.alias("buckets"))

        def replaced(parts: Column, x: Column) -> Column:
            def one(part: Column, i: Column) -> Column:
                key = F.substring_index(part, _END, 1)
                return F.when(i == 0, part).otherwise(F.concat(look_up(x["buckets"], key), F.substring(part, F.length(key) + 2, F.length(part))))

            return F.array_join(F.transform(parts, one), "")

        def slowly(t: Column, x: Column) -> Column:
            parts = F.struct(F.regexp_extract_all(t, x["pattern"], F.lit(0)).alias("found"), F.split(t, x["pattern"], -1).alias("gaps"))
            return tx.bound(parts, lambda p: F.concat(F.array_join(F.transform(p["found"], lambda m, i: F.concat(F.get(p["gaps"], i), look_up(x["buckets"], m))), ""), F.get(p["gaps"], F.size(p["found"]))))

        def quickly(t: Column, x: Column) -> Column:
            # a split by a pattern makes the pattern anew for each row, so marks are put around what is found
            parts = F.split(F.regexp_replace(t, x["pattern"], F.lit(f"{_BEGIN}$0{_END}")), _BEGIN, -1)
            return F.when(t.isNotNull(), tx.bound(parts, lambda p: replaced(p, x)))

        def convert(t: Column) -> Column:
            return tx.bound(tools, lambda x: F.when(F.contains(t, F.lit(_BEGIN)) | F.contains(t, F.lit(_END)), slowly(t, x)).otherwise(quickly(t, x)))

        return convert

    steps = [staged(table) for table in stages.entries]

    def convert(t: Column) -> Column:
        for step in steps:
            t = step(t)
        return convert_punctuation(t, config) if punctuation else t

    return convert


def lines_converter(stages: Stages, config: str, punctuation: bool = False) -> Callable[[Column], Column]:
    """The same for arrays of texts, each of them converted on its own.

    Spark compares a stage's pattern as a whole for each text that it is applied to, which costs more than a line as soon as a dictionary has thousands
    of keys; so the texts of an array are joined by a mark that the dictionary does not have. Arrays with a text that has the mark take the slower way.
    """
    convert = converter(stages, config, punctuation)
    used = {c for table in stages.entries for k, v in table.items() for c in k + v} | {_BEGIN, _END}
    mark = next(c for c in map(chr, range(0xF8FF, 0xDFFF, -1)) if c not in used)

    def convert_all(texts: Column) -> Column:
        alone = F.coalesce(F.exists(texts, lambda t: F.contains(t, F.lit(mark))), F.lit(False))
        units = F.when(alone, texts).otherwise(F.array(F.array_join(texts, mark, "")))
        # one place that converts, since the plan holds the dictionary at each
        return tx.bound(F.transform(units, convert), lambda x: F.zip_with(texts, F.when(alone, x).otherwise(F.split(x[0], mark, -1)), lambda t, c: F.when(t.isNotNull(), c)))

    def checked(texts: Column) -> Column:
        return F.when(F.size(texts) == 0, texts).otherwise(convert_all(texts))

    return lambda texts: tx.bound(texts, checked)


def icu_char_tables(spark: SparkSession) -> tuple[str, str, str, str]:
    """(simplified, its traditional, traditional, its simplified): one-to-one tables from Spark's own ICU library."""
    jvm = spark._jvm.com.ibm.icu.text.Transliterator
    chars = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]))
    out = []
    for name in ("Simplified-Traditional", "Traditional-Simplified"):
        pairs = [(a, b) for a, b in zip(chars, jvm.getInstance(name).transliterate(chars), strict=True) if a != b]
        out += ["".join(a for a, _ in pairs), "".join(b for _, b in pairs)]
    return tuple(out)
