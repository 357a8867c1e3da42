"""N-gram Jaccard self-join with MinHash LSH in bands (operator 8).

Texts are lower-cased and cut at white space; a text's set holds its runs of five
words, or all its words as one run if they are fewer. Two texts are linked if the
Jaccard similarity of their sets is at least the threshold.

* Equal texts are one text with a number of copies.
* Texts are candidates where they share a prefix in some tree. All prefixes have one
  length, found from the threshold alone: the longest, up to ``DEEPEST`` hashes, at
  which texts at the threshold itself meet with ``RECALL``. So the trees are bands
  of fixed length, each with one key, not the tries of a forest. At length 1 the
  recall may be less.
* Texts that share prefixes are put into blocks of bounded rows and bytes; every
  text is in one block. Candidates in different blocks name a pair of blocks. All
  pairs of texts of a block, and of a pair of blocks, are verified exactly, in one
  task each, and only counts and a spanning forest of the links come out of it. So
  each link is counted once, no pair is a row, and a prefix that a third of all
  texts share is many blocks.
* Linked texts form classes: connected components, named by their smallest id.

Defined results: a NULL or white-space text has no runs and is linked to none but
equal texts; rows that repeat id and text are copies; NULL ids count as larger than
any other for a class's name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import stored, text_or_empty, wrapped
from clipledger.llm.components import components

RUN = 5
THRESHOLD = 0.8
TREES = 20
DEEPEST = 8
RECALL = 0.9999
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20
MAX_BROADCAST_BYTES = 32 << 20
#: Rounds in which texts take over the smallest name among those they share prefixes with.
NAMING_ROUNDS = 2
#: Characters whose words are held as Python strings at a time.
CHUNK_CHARS = 1 << 20


def prefix_length(threshold: float, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which texts at the threshold meet in some tree with the target recall."""
    length = deepest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def runs(text: str, n: int = RUN) -> set[str]:
    w = text.lower().split()
    if not w:
        return set()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, count, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def signatures(texts: list[str], length: int, trees: int = TREES, n: int = RUN) -> list[np.ndarray | None]:
    """Per text a key per tree, standing for the first ``length`` min-hashes of that tree; None without words."""
    odd, add = _hash_functions(length * trees)
    step = np.uint64(0x100000001B3)
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words])
    if not counts.sum():
        return [None] * len(texts)
    hashed = pd.util.hash_array(np.array([v for w in words for v in w], dtype=object), categorize=False)
    ends = np.cumsum(counts)
    parts, sizes = [], []
    for end, count in zip(ends, counts, strict=True):
        w = hashed[end - count : end]
        if count:
            k = min(n, count)
            h = np.zeros(count - k + 1, dtype=np.uint64)
            for j in range(k):
                h = h * step + _mixed(w[j : count - k + 1 + j])
            parts.append(h)
            sizes.append(len(h))
    h = _mixed(np.concatenate(parts))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = np.zeros((len(sizes), trees), dtype=np.uint64)
    for t in range(trees):
        for j in range(t * length, (t + 1) * length):
            least = np.minimum.reduceat((h * odd[j] + add[j]) >> np.uint64(32), starts)
            keys[:, t] = _mixed(keys[:, t] * step + least + np.uint64(t + 1))
    out: list[np.ndarray | None] = [None] * len(texts)
    for i, k in zip(np.flatnonzero(counts), keys.view(np.int64), strict=True):
        out[i] = k
    return out


def _signed(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``id, tid, size, keys``; ``tid`` names the text, ``keys`` has an element per tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = []
            texts: list[str] = []
            chars = 0
            for t in b.column(3):
                texts.append(t.as_py())
                chars += len(texts[-1])
                if chars >= CHUNK_CHARS:
                    keys += signatures(texts, length)
                    texts, chars = [], 0
            keys += signatures(texts, length)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["id", "tid", "size", "keys"]
            )

    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("tid"),
        F.octet_length(text).cast("long").alias("size"), text.alias("t"),
    )
    return rows.mapInArrow(sign, "id long, tid binary, size long, keys array<bigint>")


def _blocks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tid, block`` of all texts that share a prefix, and ``one, two``: pairs of blocks to verify."""
    met = texts.select("tid", F.explode("keys").alias("key"))
    heads = met.groupBy("key").agg(F.count("*").alias("n"), F.min("tid").alias("head")).filter("n > 1")
    shared = stored(met.join(heads.select("key", "head"), "key"), "shared-prefixes")
    names = shared.groupBy("tid").agg(F.min("head").alias("name"))
    for _ in range(NAMING_ROUNDS - 1):
        best = shared.select("key", "tid").join(names, "tid").groupBy("key").agg(F.min("name").alias("name"))
        names = shared.select("key", "tid").join(best, "key").groupBy("tid").agg(F.min("name").alias("name"))
    names = stored(names, "names")
    sized = names.join(texts.select("tid", "size"), "tid")
    parts = sized.groupBy("name").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("parts")
    )
    part = F.pmod(F.xxhash64("tid"), F.col("parts"))
    blocks = stored(
        names.join(parts, "name").select("tid", F.xxhash64("name", part).alias("block")), "blocks"
    )
    where = shared.join(blocks, "tid").select("key", "block").distinct()
    # A prefix within one block adds nothing to that block's own pairs.
    wide = where.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    where = where.join(wide, "key")
    pairs = (
        where.select("key", F.col("block").alias("one"))
        .join(where.select("key", F.col("block").alias("two")), "key")
        .filter("one < two")
        .select("one", "two")
        .distinct()
    )
    own = blocks.select(F.col("block").alias("one"), F.col("block").alias("two")).distinct()
    return blocks, stored(pairs.unionByName(own), "block-pairs")


def _links(sets: list[set[str]], first: list[int], second: list[int] | None, threshold: float) -> np.ndarray:
    """Which texts of ``first`` are linked to which of ``second`` (or among themselves), exactly."""
    rows, cols = first, first if second is None else second
    number: dict[str, int] = {}
    held = [np.fromiter((number.setdefault(s, len(number)) for s in x), dtype=np.int64, count=len(x)) for x in sets]
    seen = np.bincount(np.concatenate(held), minlength=len(number)) if number else np.zeros(0, dtype=int)
    place = np.cumsum(seen > 1) - 1  # runs that one text alone has are in no intersection
    common = int((seen > 1).sum())
    held = [np.sort(place[h[seen[h] > 1]]) for h in held]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = np.zeros((len(rows), len(cols)))
    for low in range(0, common, 4096):

        def part(which, low=low):
            m = np.zeros((len(which), min(4096, common - low)), dtype=np.float32)
            for k, i in enumerate(which):
                h = held[i]
                m[k, h[np.searchsorted(h, low) : np.searchsorted(h, low + 4096)] - low] = 1
            return m

        a = part(rows)
        both += a @ (a if second is None else part(cols)).T
    union = size[rows][:, None] + size[cols][None, :] - both
    linked = (both > 0) & (both >= threshold * union - 1e-9)
    if second is None:
        np.fill_diagonal(linked, False)
    return linked


def _verify(unit: list[tuple], threshold: float) -> list[tuple]:
    """``tid, root, texts, documents`` for every linked text of a unit.

    A unit's rows are (block, tid, copies, text). ``root`` ties the texts linked in
    this unit together; the counts are of linked texts and of their copies.
    """
    sets = [runs(t) for *_, t in unit]
    names = sorted({r[0] for r in unit})
    first = [i for i, r in enumerate(unit) if r[0] == names[0]]
    second = [i for i, r in enumerate(unit) if r[0] != names[0]] or None
    if len(unit) < 2:
        return []
    linked = _links(sets, first, second, threshold)
    cols = first if second is None else second
    copies = np.array([r[2] for r in unit], dtype=np.int64)
    texts = np.zeros(len(unit), dtype=np.int64)
    documents = np.zeros(len(unit), dtype=np.int64)
    texts[first] += linked.sum(axis=1)
    documents[first] += linked @ copies[cols]
    if second is not None:
        texts[cols] += linked.sum(axis=0)
        documents[cols] += copies[first] @ linked
    root = list(range(len(unit)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in np.argwhere(linked):
        x, y = top(first[a]), top(cols[b])
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(unit[i][1], unit[top(i)][1], int(texts[i]), int(documents[i])) for i in np.flatnonzero(texts)]


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """Counts and ties per unit and text; rows of a unit come one after the other in one task."""
    rows = members.repartition("one", "two").sortWithinPartitions("one", "two", "block", "tid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, found = None, [], []

        def batch(found):
            cols = list(zip(*found, strict=True))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tid", "root", "texts", "documents"]
            )

        for b in batches:
            one, two, block, tid, copies = (b.column(k).to_pylist() for k in range(5))
            for i in range(b.num_rows):
                if (one[i], two[i]) != key:
                    found += _verify(unit, threshold) if unit else []
                    key, unit = (one[i], two[i]), []
                    if len(found) >= 4096:
                        yield batch(found)
                        found = []
                unit.append((block[i], tid[i], copies[i], b.column(5)[i].as_py()))
        found += _verify(unit, threshold) if unit else []
        if found:
            yield batch(found)

    return rows.mapInArrow(verify, "tid binary, root binary, texts long, documents long")


def linked_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``id, tid`` of every row, and ``tid, copies, class_id, text_links, links`` of every text."""
    rows = stored(_signed(docs, prefix_length(threshold), id_col, text_col), "signatures")
    texts = stored(
        rows.groupBy("tid").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"),
            F.first("keys").alias("keys"),
        ),
        "texts",
    )
    blocks, pairs = _blocks(texts)
    units = pairs.select(F.col("one").alias("block"), "one", "two").unionByName(
        pairs.filter("one <> two").select(F.col("two").alias("block"), "one", "two")
    )
    chosen = blocks.join(texts.select("tid", "rep", "copies"), "tid").join(units, "block")
    chosen = stored(chosen.select("one", "two", "block", "tid", "copies", "rep"), "units")
    if chosen.count() * 96 <= max_broadcast_bytes:
        chosen = F.broadcast(chosen)
    whole = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("t"))
    whole = whole.withColumn("_tid", F.unhex(F.md5("t")))
    members = whole.join(chosen, (F.col("_tid") == F.col("tid")) & F.col("_id").eqNullSafe(F.col("rep")))
    members = members.select("one", "two", "block", "tid", "copies", "t")
    if rows.count() > rows.select("id", "tid").distinct().count():  # rows that repeat id and text
        members = members.dropDuplicates(["one", "two", "tid"])
    found = stored(_verified(members, threshold), "links")
    links = found.groupBy("tid").agg(F.sum("texts").alias("text_links"), F.sum("documents").alias("documents"))
    tree = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    linked = links.join(tree.withColumnRenamed("node", "tid"), "tid", "left").select(
        "tid", "text_links", "documents", F.coalesce("root", "tid").alias("root")
    )
    linked = stored(linked.join(texts.select("tid", "rep"), "tid"), "linked")
    head = F.struct(F.col("rep").isNull(), "rep", "tid")  # NULL ids last; texts that share an id are told apart
    classes = linked.groupBy("root").agg(F.min(head).alias("head"))
    linked = linked.join(classes, "root").select("tid", "text_links", "documents", "head")
    out = texts.select("tid", "rep", "copies").join(linked, "tid", "left").select(
        "tid", "copies", F.when(F.col("head").isNull(), F.col("rep")).otherwise(F.col("head.rep")).alias("class_id"),
        F.coalesce("head.tid", "tid").alias("class_tid"),
        F.coalesce("text_links", F.lit(0)).cast("long").alias("text_links"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"),
    )
    return rows.select("id", "tid"), out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every row with its class, its links to other documents and to different texts."""
    rows, texts = linked_texts(docs, id_col, text_col, **how)
    return rows.join(texts, "tid").select(
        F.col("id").alias(id_col), "class_id", F.col("links").alias("n_links"), F.col("text_links").alias("n_text_links"),
        "copies", F.lower(F.hex("tid")).alias("text_md5"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES, **how
) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id."""
    rows, texts = linked_texts(docs, id_col, text_col, **how)
    per_row = rows.groupBy("id", "tid").agg(F.count("*").alias("times")).join(texts.drop("copies"), "tid")
    stays = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("class_tid"))
    per_row = stored(per_row.select("id", "tid", "times", stays.alias("stays")), "decisions")
    told = per_row.agg(
        F.max(F.when(F.col("stays"), F.col("times"))).alias("times"), F.count(F.when(~F.col("stays"), 1)).alias("gone")
    ).first()
    gone = per_row.filter(~F.col("stays")).select("id", "tid")
    if told["gone"] * 64 <= max_broadcast_bytes:
        gone = F.broadcast(gone)
    own = wrapped(docs, own_id=F.col(id_col).cast("long"), own_tid=F.unhex(F.md5(text_or_empty(text_col))))
    kept = own.join(gone, own["own_id"].eqNullSafe(gone["id"]) & (own["own_tid"] == gone["tid"]), "left_anti")
    if (told["times"] or 0) > 1:
        kept = kept.dropDuplicates(["own_id", "own_tid"])
    return kept.select("row.*")
