"""Exact deduplication by deterministic block naming (operator 3).

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted
and numbered, so that two blocks have the same number exactly when they are
equal. Then adjacent numbers of a document are paired and the distinct pairs are
sorted and numbered in turn, until one number is left. Documents with as many
blocks and the same last number are equal: no hash decides.

Blocks are sorted by (hash, content). Content beyond the hash matters only where
different blocks share a hash, so only the hash travels back to the documents
unless such blocks are found; then those, and only those, are told apart by
content. Text is shuffled once, map-side deduplicated; all else is a few integers
per block. A block held by a third of all documents is one row after map-side
aggregation, and a skewed partition of a plain equi join afterwards.

Defined results: a NULL text is the empty text, whose only block is empty; all
empty texts are equal. Of equal texts the largest id stays (NULL only if there is
no other id). Of rows that repeat id and text one stays. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import stored, text_or_empty

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int, hashed) -> DataFrame:
    text = text_or_empty(text_col)
    cut = F.expr(
        "flatten(transform(array(cast(t as binary)), b -> transform("
        f"sequence(0, (octet_length(b) - 1) div {block}), i -> substring(b, i * {block} + 1, {block}))))"
    )
    one = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("t"))
    many = F.expr(f"greatest(1, (octet_length(t) + {block - 1}) div {block})").cast("long").alias("blocks")
    rows = one.select("id", "sha", many, F.posexplode(cut).alias("pos", "block"))
    return rows.withColumn("h", hashed(F.col("block")))


def _numbered(keys: DataFrame, order: list[str], purpose: str) -> DataFrame:
    """Distinct sorted keys with an integer each; stored, as the integer is not a function of the key."""
    return stored(keys.orderBy(*order).withColumn("name", F.monotonically_increasing_id()), purpose)


def _block_names(blocks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Names by hash, and names by (hash, content) for hashes that several blocks share."""
    counted = stored(blocks.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("n")), "block-hashes")
    shared = counted.filter("n > 1").select("h")
    if not shared.take(1):
        return _numbered(counted.select("h"), ["h"], "block-names"), None
    contents = blocks.join(shared, "h", "left_semi").select("h", "block").distinct()
    keys = counted.filter("n = 1").select("h", F.lit(None).cast("binary").alias("block")).unionByName(contents)
    named = _numbered(keys, ["h", "block"], "block-names")
    return named.filter("block IS NULL").drop("block"), named.filter("block IS NOT NULL")


def _named(rows: DataFrame, by_hash: DataFrame, by_content: DataFrame | None) -> DataFrame:
    if by_content is None:
        return rows.drop("block").join(by_hash, "h")
    told = by_content.withColumnRenamed("name", "exact")
    return (
        rows.join(by_hash, "h", "left")
        .join(told, ["h", "block"], "left")
        .withColumn("name", F.coalesce("exact", "name"))
        .drop("block", "exact")
    )


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES, hashed=None
) -> DataFrame:
    """``id, sha, times, level, name``: equal texts have equal ``(level, name)``, others do not.

    ``times`` counts rows that repeat id and text. ``hashed`` maps a block to its
    sort prefix and defaults to a 64-bit hash.
    """
    def default(c: Column) -> Column:
        return F.xxhash64(c)

    hashed = hashed or default
    rows = _blocks(docs, id_col, text_col, block, hashed)
    level, out = 0, None
    current = _named(rows, *_block_names(rows)).withColumn("times", F.lit(1).cast("long"))
    while current is not None:
        level += 1
        even = F.col("pos") % 2 == 0
        halved = F.expr("(blocks + 1) div 2").alias("blocks")
        pairs = stored(
            current.groupBy("id", "sha", halved, F.expr("pos div 2").alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
                F.sum(F.when(even, F.col("times")).otherwise(0)).alias("times"),
            ),
            "block-pairs",
        )
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        named = stored(pairs.join(names, ["a", "b"]).drop("a", "b"), "named-pairs")
        # Documents down to one name leave; the others go on to the next level.
        left = named.filter("blocks = 1").select("id", "sha", "times", F.lit(level).alias("level"), "name")
        out = left if out is None else out.unionByName(left)
        current = named.filter("blocks > 1")
        if not current.take(1):
            current = None
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **naming) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    ids = stored(identities(docs, id_col, text_col, **naming), "identities")
    groups = ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("times").alias("group_size"))
    rows = ids.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    return rows.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
