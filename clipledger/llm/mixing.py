"""Mixing sources to target weights by systematic sampling (operator 1).

Every document of a source is expected ``target / source size`` times. The
expected copies are summed along the source, one random offset per source is
added, and a document is emitted once for each integer boundary its own share
crosses. The order along a source is by size class and then by a hash of the id,
so each class gets its share. What is taken differs from the target by a few
documents of each size class, which shows where a few long texts dominate a source
(0.966 to 1.034 of the target over the sources of 10,000 documents).

The running sum needs the rank of a document in its source. No task ranks a whole
source: ranks are counted inside (source, size class, hash bucket), and the two
small tables of bucket and class counts give the ranks before it. There are at
most ``BUCKETS`` rows per class and about 16 classes per doubling of the size.

Defined results: documents without words weigh nothing and are emitted like any
other of their source; a source without words has target 0 and emits nothing;
NULL is a source of its own; rows that repeat are separate documents. Reruns
agree, as nothing but ids, sizes and the seed enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import text_or_empty, wrapped

#: Hash buckets per size class, as the number of hex digits of the hash that name one.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def cyclic_weights(sizes: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """A weight per source, repeating in code point order with NULL last. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % len(weights) + 1).cast("int"))
    return sizes.withColumn("weight", cases)


def targets(weighted: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target``: shares of all sizes by weight, none above ``most`` times its source.

    ``weighted`` has a row per source, a table that people write by hand. Sharing
    the excess again by weight ends where all sources that are not full stand at
    one level (target over weight). With sources in order of the level at which
    they fill up, that level is the highest of ``rest / weights of the rest``.
    """
    cap = F.col("source_size") * most
    every = Window.partitionBy()
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = weighted.withColumn("level", rest.cast("double") / F.sum("weight").over(after).cast("double"))
    return level.withColumn(
        "target", F.least(cap.cast("double"), F.max("level").over(every) * F.col("weight"))
    ).drop("level")


def _size_class(size: Column) -> Column:
    """Number of binary digits and the first four of them: classes a sixteenth of a doubling or so wide."""
    digits = F.length(F.bin(size))
    top = F.when(digits > 4, F.expr("shiftright(size, length(bin(size)) - 4)")).otherwise(
        F.expr("shiftleft(size, 4 - length(bin(size)))")
    )
    return (digits * 16 + top).cast("int")


def with_copies(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    weigh=cyclic_weights, most: int = MOST_COPIES, seed: str = "mix",
) -> DataFrame:
    """``row`` (all columns), ``size``, ``source_size``, ``target`` and ``copies`` of every document.

    ``size`` defaults to the word count of ``text``. ``docs`` is read twice; pass a
    stored table where reading is dear.
    """
    size = word_count() if size is None else size
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = wrapped(docs, source=F.col(source_col), size=size, key=key)
    rows = rows.withColumn("class", _size_class(F.col("size"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    counts = rows.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))

    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = targets(weigh(sources), most).withColumn(
        "offset",
        F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10)
        .cast("double") / 65536,
    )

    def before(*by):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    class_start = classes.select("source", "class", before("source", "class").alias("class_start"))
    starts = counts.select("source", "class", "bucket", before("source", "class", "bucket").alias("start"))
    starts = _join(_join(starts, class_start, "source", "class"), sources, "source")
    starts = starts.withColumn("start", F.col("start") + F.col("class_start")).drop("class_start", "weight")

    inside = Window.partitionBy("source", "class", "bucket").orderBy("key", "size", F.col(f"row.{id_col}"))
    ranked = _join(rows.withColumn("place", F.row_number().over(inside)), starts, "source", "class", "bucket")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("start") + F.col("place")
    copies = F.floor(rate * rank + F.col("offset")) - F.floor(rate * (rank - 1) + F.col("offset"))
    return ranked.select("row", "size", "source_size", "target", copies.alias("copies"))


def _join(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    b = b.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in b.columns])
    on = [a[c].eqNullSafe(b[f"_{c}"]) for c in by]
    return a.join(b, on).drop(*[f"_{c}" for c in by])


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    taken = with_copies(docs, **how).filter("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
