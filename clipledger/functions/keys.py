"""Key handling shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(cols: str | Iterable[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join by column names. A NULL key is an unknown identity: it matches nothing."""
    return left.join(right, on, how)


NULLS = "__key_nulls"
# fixed values: stand-ins for NULL, told apart from real values by the mask
_STAND_INS = {
    T.StringType: "", T.BooleanType: False, T.BinaryType: b"",
    T.DateType: "1970-01-01", T.TimestampType: "1970-01-01 00:00:00",
    T.TimestampNTZType: "1970-01-01 00:00:00",
}


def solid(df: DataFrame, key) -> tuple[DataFrame, list[str]]:
    """Key columns without NULLs, plus a mask column that tells which were NULL.

    Grouping, windows and joins on the result treat NULL as a key of its own
    with plain equality, so one hash partitioning serves all of them; null-safe
    joins would hash other expressions and shuffle again. ``restore`` undoes it.
    Both leave a key that is solid already as it is.
    """
    key = as_list(key)
    if NULLS in key:
        return df, key
    mask = F.lit(0)
    filled = {}
    for i, k in enumerate(key):
        field = df.schema[k]
        if not field.nullable:
            continue
        mask = mask + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
        filled[k] = F.coalesce(
            F.col(k), F.lit(_STAND_INS.get(type(field.dataType), 0)).cast(field.dataType)
        )
    return df.withColumns({NULLS: mask, **filled}), [*key, NULLS]


def restore(df: DataFrame, key) -> DataFrame:
    key = as_list(key)
    if NULLS in key:
        return df
    back = {k: F.when(F.col(NULLS).bitwiseAND(1 << i) == 0, F.col(k)) for i, k in enumerate(key)}
    return df.withColumns(back).drop(NULLS)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch for a timestamp column, else the column.

    Zone-less timestamps are subtracted from a zone-less epoch, so the session
    time zone cannot shift differences.
    """
    col = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        span = col - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (
            F.extract(F.lit("DAY"), span).cast("long") * 86_400_000_000
            + F.extract(F.lit("HOUR"), span).cast("long") * 3_600_000_000
            + F.extract(F.lit("MINUTE"), span).cast("long") * 60_000_000
            + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long")
        )
    return col
