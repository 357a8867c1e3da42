"""Ordered per-key computations that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to
one task; a key with a third of the table would then run on one core. The
helpers here cut each key into segments ``seq div rows`` instead. ``seq`` is an
integer that is unique within a key, so a segment holds at most ``rows`` rows -
a bound that needs no pass over the data, and a pure function of the row, so a
recomputed task always produces the same segments.

The pattern is always the same:

1. window or aggregate inside ``(key, segment)``;
2. one summary row per segment, combined along the key by a window over
   summaries (``rows_of_key / rows`` rows at most);
3. carry joined back on ``(key, segment)`` - again at most ``rows`` rows per
   join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clipledger.functions.keys import as_list, join_on, restore, solid

SEG = "__seg"
SEGMENT_ROWS = 1 << 22


def with_segment(df: DataFrame, seq: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    return df.withColumn(SEG, F.floor(F.col(seq) / F.lit(rows)).cast("long"))


def inside(key, seq: str | Column, descending: bool = False) -> WindowSpec:
    order = F.col(seq) if isinstance(seq, str) else seq
    return Window.partitionBy(*as_list(key), SEG).orderBy(order.desc() if descending else order)


def along(key, descending: bool = False) -> WindowSpec:
    """Window over segment summaries of a key, in segment order."""
    return Window.partitionBy(*as_list(key)).orderBy(F.col(SEG).desc() if descending else F.col(SEG))


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def summarise(df: DataFrame, key, *aggs: Column) -> DataFrame:
    """One row per (key, segment); combined map-side before the shuffle."""
    return df.groupBy(*as_list(key), SEG).agg(*aggs)


def attach(df: DataFrame, carried: DataFrame, key, how: str = "left") -> DataFrame:
    return join_on(df, carried, [*as_list(key), SEG], how)


def with_rank(
    df: DataFrame, key, seq: str, out: str = "rank", rows: int = SEGMENT_ROWS
) -> DataFrame:
    """1-based position of each row within its key, ordered by ``seq``."""
    df, full = solid(df, key)
    cut = with_segment(df, seq, rows)
    sizes = summarise(cut.select(*full, SEG), full, F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        *full,
        SEG,
        F.coalesce(F.sum("__n").over(before(along(full))), F.lit(0)).alias("__offset"),
    )
    ranked = (
        attach(cut, offsets, full)
        .withColumn(out, F.row_number().over(inside(full, seq)) + F.col("__offset"))
        .drop("__offset", SEG)
    )
    return restore(ranked, key)
