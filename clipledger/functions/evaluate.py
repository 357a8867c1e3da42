"""Keeping costly expressions from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions later steps refer to but never repeat.

    A projected expression is copied into every filter pushed below it. A
    one-row ``inline`` is a boundary for that: filters on its output stay
    above it, filters on other columns still move down.
    """
    keep = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*keep, F.inline(packed))
