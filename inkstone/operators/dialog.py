"""Open quotes along the lines of a text, as a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx

#: Lines of a text that are scanned together.
RANGE = 4096


def dialog_depths(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """id columns, line_no from 0 and depths: how many quotes of each kind are open after the line, by counters that stop at zero.

    A counter that does not go below zero is a running sum less its running minimum. The sums are made in ranges of lines, then over
    the ranges, so a text of any length is dealt out and the work is linear in its lines. NULL text has no lines; rows that repeat an
    id are one text to the scan, so ids are to be unique.
    """
    kinds = range(len(cs.DIALOG_PAIRS))
    lines = df.select(*id_cols, F.posexplode(tx.split_lines(F.col(text_col))).alias("line_no", "line"))
    moves = lines.select(*id_cols, "line_no", F.floor(F.col("line_no") / RANGE).alias("_range"), tx.dialog_moves(F.col("line")).alias("_m"))
    moves = moves.select(*id_cols, "line_no", "_range", *(F.col("_m")[k][c].alias(f"_{c}{k}") for k in kinds for c in ("sum", "low")))

    def scanned(rows: DataFrame, window) -> DataFrame:
        """With the running sums, and the lowest running sum so far."""
        rows = rows.select("*", *(F.sum(f"_sum{k}").over(window).alias(f"_s{k}") for k in kinds))
        return rows.select("*", *(F.min(F.col(f"_s{k}") - F.col(f"_sum{k}") + F.col(f"_low{k}")).over(window).alias(f"_l{k}") for k in kinds))

    inner = scanned(moves, Window.partitionBy(*id_cols, "_range").orderBy("line_no"))
    ends = inner.groupBy(*id_cols, "_range").agg(*(F.max_by(f"_s{k}", "line_no").alias(f"_sum{k}") for k in kinds), *(F.min(f"_l{k}").alias(f"_low{k}") for k in kinds))
    ranges = Window.partitionBy(*id_cols).orderBy("_range")
    outer = scanned(ends, ranges)
    starts = outer.select(*id_cols, "_range", *(F.coalesce(F.lag(F.col(f"_s{k}") - F.least(F.lit(0), f"_l{k}")).over(ranges), F.lit(0)).alias(f"_d{k}") for k in kinds))

    def depth(k: int) -> Column:
        return F.greatest(F.col(f"_d{k}") + F.col(f"_s{k}"), F.col(f"_s{k}") - F.least(F.lit(0), f"_l{k}")).cast("int")

    named = [starts[c].alias(f"_{i}") for i, c in enumerate(id_cols)]
    joined = inner.join(starts.select(*named, F.col("_range").alias("_r"), *(f"_d{k}" for k in kinds)), [*(inner[c].eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(id_cols)), inner["_range"] == F.col("_r")])
    return joined.select(*(inner[c] for c in id_cols), "line_no", F.array(*map(depth, kinds)).alias("depths"))
