"""Benchmark decontamination by scanning token windows against a broadcast set (operator 2).

Texts are lower-cased (A-Z) and cut into words. A window is ``n`` consecutive words
of a benchmark item, or a whole item that is shorter. Windows of documents are
looked up in the set of benchmark windows by their words, not by a hash, so a hit
is an occurrence. Words of a document inside any occurrence are hit.

The set of windows is broadcast while its measured bytes stay below
``max_broadcast_bytes``; a larger one is joined by shuffling the windows. A
document's words are cut into overlapping pieces first, so that a row holds a
bounded number of windows. Beside the hits only one marker row per document is
shuffled, and no text.

Defined results: a NULL or wordless text has no words, no hits and is not
contaminated; wordless items have no windows; equal items are separate items; a
NULL item id is the empty string in lists; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import ascii_lower, stored, text_or_empty, wrapped

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words where letters are not lower-cased yet, each with what stands before it.
WITH_GAP = r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x7F]+$"
PIECE = 1024
MAX_BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``window, length, items``: each distinct window with the ids of the items that have it."""
    w = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(text_or_empty(text_col)).alias("w")
    ).filter("size(w) > 0")
    starts = f"sequence(0, greatest(size(w) - {n}, 0))"
    cut = F.expr(f"transform({starts}, i -> slice(w, i + 1, {n}))")
    return (
        w.select("item", F.explode(cut).alias("g"))
        .groupBy(F.array_join("g", " ").alias("window"), F.size("g").alias("length"))
        .agg(F.collect_set("item").alias("items"))
    )


def _document_windows(docs: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """A row per window of the given lengths, and one with an empty window per document."""
    text = text_or_empty(text_col)
    w = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), words(text).alias("w"))
    overlap = max([1, *lengths]) - 1
    pieces = F.expr(
        f"transform(sequence(0, greatest(size(w) - 1, 0) div {PIECE}), "
        f"k -> slice(w, k * {PIECE} + 1, {PIECE + overlap}))"
    )
    rows = w.select("id", "h", F.size("w").cast("long").alias("n_words"), F.posexplode(pieces).alias("k", "p"))
    found = [
        F.expr(
            f"transform(filter(sequence(0, greatest(least(size(p) - {n}, {PIECE - 1}), 0)), i -> i + {n} <= size(p)), "
            f"i -> struct(k * {PIECE} + i AS at, array_join(slice(p, i + 1, {n}), ' ') AS window))"
        )
        for n in lengths
    ]
    marker = F.expr("IF(k = 0, array(struct(-1 AS at, '' AS window)), array())")
    return rows.select("id", "h", "n_words", F.explode(F.concat(marker, *found)).alias("x")).select(
        "id", "h", "n_words", "x.at", "x.window"
    )


def scan(
    docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``id, h, times, n_words, hits, items``: per distinct id and text.

    ``h`` is a hash of the text; ``hits`` are hit word positions in order;
    ``items`` are ids of the items found, sorted as strings.
    """
    grams = stored(benchmark_windows(items, n, item_id, item_text), "benchmark-windows")
    size = grams.agg(
        F.sum(F.octet_length("window") + 16 * F.size("items") + 64).alias("bytes"), F.collect_set("length").alias("lengths")
    ).first()  # at most n lengths
    marker = docs.sparkSession.sql("SELECT '' AS window, 0 AS length, CAST(array() AS array<string>) AS items")
    known = grams.unionByName(marker)
    if (size["bytes"] or 0) <= max_broadcast_bytes:
        known = F.broadcast(known)
    hits = _document_windows(docs, sorted(size["lengths"]), id_col, text_col).join(known, "window")
    real = F.col("length") > 0
    per_doc = hits.groupBy("id", "h").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(~real, 1)).alias("times"),
        F.collect_list(F.when(real, F.struct("at", "length"))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.expr("array_sort(array_distinct(flatten(transform(found, f -> sequence(f.at, f.at + f.length - 1)))))")
    return per_doc.select("id", "h", "times", "n_words", covered.alias("hits"), "items")


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    n = F.size("hits")
    return (n > 0) & (20 * n >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``."""
    found = scan(docs, items, id_col=id_col, **how).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without contaminated documents."""
    bad = scan(docs, items, id_col=id_col, text_col=text_col, **how).filter(contaminated())
    rows, on = _keyed(docs, bad, id_col, text_col)
    return rows.join(bad, on, "left_anti").select("row.*")


def _keyed(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    rows = wrapped(docs, own_id=F.col(id_col), own_h=F.xxhash64(text_or_empty(text_col)))
    return rows, rows["own_id"].eqNullSafe(found["id"]) & (rows["own_h"] == found["h"])


def drop_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with hit words, and what stands before each of them, taken out of the text."""
    bad = scan(docs, items, id_col=id_col, text_col=text_col, **how).filter("size(hits) > 0")
    rows, on = _keyed(docs, bad, id_col, text_col)
    text = F.col(f"row.{text_col}")
    tokens = F.regexp_extract_all(text, F.lit(WITH_GAP), F.lit(0))
    # Runs of hit words, so that a token is held against few runs rather than against all hits.
    starts = F.filter("hits", lambda x, i: (i == 0) | (F.element_at("hits", F.greatest(i, F.lit(1))) != x - 1))
    ends = F.filter(
        "hits", lambda x, i: (i == F.size("hits") - 1) | (F.element_at("hits", F.least(i + 2, F.size("hits"))) != x + 1)
    )
    runs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    kept = F.filter(tokens, lambda t, i: ~F.exists("runs", lambda r: i.between(r["a"], r["b"])))
    joined = rows.join(bad, on, "left").withColumn("runs", runs)
    text = F.when(F.col("hits").isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
