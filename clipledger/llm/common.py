"""Helpers shared by the training-data operators.

Rows of a document table are identified by their id *and* their text. Rows that
repeat both are one document that occurs several times; every operator returns
as many rows for it as it was given. A NULL text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.functions.shared import written

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A table in the shared checkpoint folder, removed when the application ends."""
    return written(df, purpose)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as a struct ``row`` beside new columns, so that names cannot clash.

    ``select("row.*")`` gives the rows back as they were.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[c.alias(name) for name, c in columns.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched.

    ``lower`` is much faster than ``translate`` but also changes other letters, so
    it serves only texts in which bytes and characters are the same number.
    """
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def with_running_starts(df: DataFrame, lengths: dict[str, str], chunk: int = 256) -> DataFrame:
    """Adds exclusive prefix sums of integer arrays: ``lengths`` maps their columns to new ones.

    Summing each prefix afresh would take quadratic time, so sums are kept per
    chunk; the work per element is bounded by the chunk and the number of chunks.
    Each step is a projection of its own and is used twice in the next one, which
    keeps the optimizer from evaluating it anew for every element.
    """
    for c, out in lengths.items():
        sums = (
            f"transform(sequence(0, (size({c}) - 1) div {chunk}), "
            f"k -> aggregate(slice({c}, k * {chunk} + 1, {chunk}), 0L, (a, x) -> a + x))"
        )
        df = df.withColumn(f"{out}_s", F.expr(sums))
        df = df.withColumn(f"{out}_o", F.expr(f"transform({out}_s, (x, k) -> aggregate(slice({out}_s, 1, k), 0L, (a, y) -> a + y))"))
        inside = f"aggregate(slice({c}, (i div {chunk}) * {chunk} + 1, i % {chunk}), 0L, (a, y) -> a + y)"
        starts = f"IF(size({out}_o) = 0, array(), transform({c}, (x, i) -> {out}_o[i div {chunk}] + {inside}))"
        df = df.withColumn(out, F.expr(starts)).drop(f"{out}_s", f"{out}_o")
    return df
