"""Ordering and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.keys import as_list, join_on


def ordered_inputs(files: DataFrame, root_idx: str = "root_idx", path: str = "path") -> DataFrame:
    """Roots in argument order, names ascending within each root."""
    return files.orderBy(root_idx, path)


def in_input_order(results: DataFrame, idx: str = "idx") -> DataFrame:
    """Results in the order of their inputs, by an explicit index column."""
    return results.orderBy(idx)


def slots_in_order(candidates: DataFrame, key, slot: str = "slot") -> DataFrame:
    """Candidates of each key ascending by slot."""
    return candidates.orderBy(*as_list(key), slot)


def empty_created(created: DataFrame, produced: DataFrame, key) -> DataFrame:
    """Created places that hold nothing; the produced side is made distinct first."""
    key = as_list(key)
    return join_on(created, produced.select(*key).distinct(), key, "left_anti")


def merge_taken(scanned: DataFrame, raced: DataFrame, key, slot: str = "slot") -> DataFrame:
    """Slots seen or lost to another writer; lost ones are never reusable."""
    cols = [*as_list(key), slot]
    both = scanned.select(*cols, F.lit(True).alias("reusable")).unionByName(
        raced.select(*cols, F.lit(False).alias("reusable"))
    )
    return both.groupBy(*cols).agg(F.bool_and("reusable").alias("reusable"))
