"""Joining a fact table to one row per key when a key may be very hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.keys import as_list, join_on

ROWS_PER_TASK = 1 << 22
_SALT = "__salt"


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    key,
    spread: Column,
    count: str | None = None,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``rows`` to ``per_key`` (unique per key), splitting only hot keys.

    A key with ``n`` rows is spread over ``ceil(n / rows_per_task)`` salts and
    its ``per_key`` row is repeated that often; all other keys keep one salt.
    ``spread`` is any well-distributed value of a row. ``count`` names a column
    of ``per_key`` that already holds ``n``; without it the rows are counted
    (a key-only scan combined map-side).

    The hot-key table holds at most ``total_rows / rows_per_task`` rows by
    construction; how it is joined is left to Spark, which knows its size.
    """
    key = as_list(key)
    if count is None:
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    else:
        sizes = per_key.select(*key, F.col(count).alias("__n"))
    hot = sizes.where(F.col("__n") > rows_per_task).select(
        *key, F.ceil(F.col("__n") / F.lit(rows_per_task)).cast("int").alias("__salts")
    )
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    spread_rows = (
        join_on(rows, hot, key, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("__salts")
    )
    repeated = (
        join_on(per_key, hot, key, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("__salts")
    )
    return join_on(spread_rows, repeated, [*key, _SALT], how).drop(_SALT)
