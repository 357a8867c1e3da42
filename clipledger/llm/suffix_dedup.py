"""Removal of repeated byte strings (operator 5).

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too is
removed. Whether strings repeat is read off a Burrows-Wheeler transform: intervals
of rows with a common prefix are extended backwards breadth-first, which yields the
common prefix of neighbouring rows by increasing value, and stops at ``LENGTH``. Rows
still undivided then share that many bytes.

A transform needs the strings it compares in one place, so texts are dealt to many:

1. Each window of ``LENGTH`` bytes has an anchor, the ``GRAM`` bytes in it with the least
   hash (the first of equal ones). Equal windows have equal anchors. Windows in a row
   with one anchor form a segment, at most ``2 * LENGTH - GRAM`` bytes.
2. Anchors that occur once have no repeated window; that is most of the text, and only
   hashes were shuffled. Segments that occur twice as a whole repeat in all windows.
3. The rest, one copy of each different segment beside an equal anchor, is dealt to
   shards of bounded bytes by anchor, and a shard gets a transform of its own.
4. An anchor with more segments than a shard should hold is not sent to one task: its
   windows are told apart by a 128-bit hash and counted.

A segment is named by 64 bits of its anchor's hash and 64 bits of its own. Runs of
removed bytes are merged per document.

Defined results: a NULL text is empty; texts shorter than ``LENGTH`` lose nothing; of
repeated rows all are judged, so each loses whatever it shares with the others; the
result of ``remove`` is text only if removal does not cut characters, so bytes that
are no UTF-8 any more are replaced; the report hashes the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import stored, text_or_empty, wrapped

LENGTH = 200
GRAM = 64
#: Bytes of segments that share one transform, on average, and the most of one anchor.
SHARD_BYTES = 1 << 20
HOT_BYTES = 4 << 20
MAX_BROADCAST_BYTES = 32 << 20
#: Bytes whose anchors are looked for at a time.
CHUNK_BYTES = 1 << 18
#: Grams compared at a time, as a power of two; one more low bit of a hash gives way to the position.
PIECE_BITS = 20
_ONE = np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position, by doubling."""
    h, width = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _ONE, 1
    while width < gram:
        step = min(width, gram - width)
        h = (h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93)) ^ h[step:]
        h ^= h >> np.uint64(32)
        width += step
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _least_grams(h: np.ndarray, windows: int) -> np.ndarray:
    """For each run of ``windows`` grams the position of the least hash, the first one of equal ones.

    Positions take the place of the same low bits everywhere, so a run's answer depends
    on its own hashes alone, not on the length of what stands around it.
    """
    bits = np.uint64(PIECE_BITS + 1)
    at = []
    for low in range(0, max(0, len(h) - windows + 1), 1 << PIECE_BITS):
        part = h[low : low + (1 << PIECE_BITS) + windows - 1]
        least, width = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64), 1
        while width < windows:
            step = min(width, windows - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        at.append((least & ((_ONE << bits) - _ONE)).astype(np.int64) + low)
    return np.concatenate(at) if at else np.zeros(0, np.int64)


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple]:
    """Per text (anchor hashes, segment hashes, first windows, numbers of windows)."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    if not len(joined) >= length:
        return [empty] * len(texts)
    h = _gram_hashes(np.frombuffer(joined, np.uint8), gram)
    at = _least_grams(h, length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= ends[owner]
    start = np.flatnonzero(inside)
    if not len(start):
        return [empty] * len(texts)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at[start]) != 0) | (np.diff(owner[start]) != 0)]))
    first, count = start[new], np.diff(np.append(new, len(start)))
    anchor = h[at[first]].view(np.int64)
    view = memoryview(joined)
    own = np.fromiter(
        (xxhash.xxh3_64_intdigest(view[s : s + n + length - 1]) for s, n in zip(first.tolist(), count.tolist(), strict=True)),
        dtype=np.uint64, count=len(first),
    ).view(np.int64)
    cut = np.searchsorted(owner[first], np.arange(len(texts) + 1))
    base = ends - sizes
    return [
        (anchor[a:b], own[a:b], (first[a:b] - base[i]).astype(np.int32), count[a:b].astype(np.int32))
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))
    ]


def _suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of at least ``length`` symbols from each; ties in any order."""
    n, width = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(width, np.int64)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(9)) | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if width >= length or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        width *= 2


def undivided(symbols: np.ndarray, length: int) -> np.ndarray:
    """Marks the positions whose first ``length`` symbols start at another position too.

    ``symbols`` are positive, 0 separates strings. Interval expansion on the
    transform: an interval of rows that share a prefix of ``k`` symbols gives, per
    symbol before them, an interval that shares ``k + 1``. The row after it has a
    common prefix of ``k`` with it if no shorter one is known. Only intervals that
    tell such a row are extended further.
    """
    n = len(symbols)
    order = _suffix_order(symbols, length)
    before = symbols[order - 1]  # the transform; the text is cyclic
    first = np.sort(before)
    step = np.empty(n, np.int64)  # from a row to that of the suffix one symbol longer
    step[np.argsort(before, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        rows = np.repeat(low - (ends - sizes), sizes) + np.arange(total)
        key = (step[rows] << 32) | np.repeat(np.arange(len(low)), sizes)
        key.sort()
        to, owner = key >> 32, key & 0xFFFFFFFF
        symbol = first[to]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(symbol) != 0)]))
        low, high = to[new], to[np.append(new[1:], total) - 1] + 1
        tells = ~known[high]
        low, high = low[tells], high[tells]
        known[high] = True
    joined = ~known  # row i shares the length with row i - 1
    joined[[0, n]] = False
    out = np.zeros(n, bool)
    out[order] = joined[:-1] | joined[1:]
    return out


def _spans(mask: np.ndarray) -> list[int]:
    """Starts and exclusive ends of the true runs, alternating."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def _shard_spans(rows: list[tuple], length: int) -> list[tuple]:
    """(anchor, segment, spans of repeated windows) of the segments of one shard."""
    rows = list({(a, s): (a, s, d) for a, s, d in rows}.values())
    parts, at, place = [], 0, []
    for _, _, data in rows:
        parts += [np.frombuffer(data, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
        place.append(at)
        at += len(data) + 1
    again = undivided(np.concatenate(parts), length)
    out = []
    for (a, s, data), p in zip(rows, place, strict=True):
        found = _spans(again[p : p + len(data) - length + 1])
        if found:
            out.append((a, s, found))
    return out


def _segment_table(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """``k, id, tid, n_bytes`` and arrays ``anchor, own, lo, n`` of each row's segments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            texts: list[bytes] = []
            size = 0
            for t in b.column(3):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    found += segments(texts, length, gram)
                    texts, size = [], 0
            if texts:
                found += segments(texts, length, gram)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            lists = []
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            for k, kind in enumerate(kinds):
                flat = np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *lists], names=["id", "tid", "n_bytes", "anchor", "own", "lo", "n"]
            )

    data = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(data)).alias("tid"),
        F.octet_length(data).cast("long").alias("n_bytes"), data.alias("data"),
    )
    schema = "id long, tid binary, n_bytes long, anchor array<long>, own array<long>, lo array<int>, n array<int>"
    return stored(rows.mapInArrow(cut, schema).withColumn("k", F.monotonically_increasing_id()), "segments")


def _with_texts(docs: DataFrame, narrow: DataFrame, id_col: str, text_col: str, how: str, row_bytes: int, limit: int):
    """Rows of ``docs`` as ``id, data`` with what ``narrow`` has for their id and text."""
    if narrow.count() * row_bytes <= limit:
        narrow = F.broadcast(narrow)
    narrow = narrow.withColumnRenamed("id", "_id").withColumnRenamed("tid", "_tid")
    data = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), data.alias("data"))
    return rows.join(narrow, F.col("id").eqNullSafe(F.col("_id")) & (F.unhex(F.md5("data")) == F.col("_tid")), how)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``id, tid, spans``: byte runs to remove, as alternating starts and ends, of texts that have any."""
    table = _segment_table(docs, id_col, text_col, length, gram)
    each = table.select("k", F.explode(F.arrays_zip("anchor", "own", "lo", "n")).alias("s")).select("k", "s.*")
    again = stored(each.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "anchors")
    if again.count() * 32 <= max_broadcast_bytes:
        again = F.broadcast(again)
    each = stored(each.join(again, "anchor"), "repeated-anchors")

    kinds = each.groupBy("anchor", "own").agg(F.count("*").alias("times"), F.min(F.struct("k", "lo", "n")).alias("one"))
    kinds = stored(kinds, "kinds")
    groups = kinds.groupBy("anchor").agg(
        F.min("times").alias("least"), F.sum(F.col("one.n") + length).alias("bytes")
    )
    # A group all of whose segments occur twice is settled.
    open_kinds = kinds.join(groups.filter("least = 1"), "anchor").select(
        "anchor", "own", "bytes", F.col("one.k").alias("k"), F.col("one.lo").alias("lo"), F.col("one.n").alias("n")
    )
    wanted = open_kinds.groupBy("k").agg(F.collect_list(F.struct("anchor", "own", "bytes", "lo", "n")).alias("want"))
    wanted = stored(wanted.join(table.select("k", "id", "tid"), "k").select("id", "tid", "want"), "wanted")
    size = wanted.agg(F.coalesce(F.sum(F.expr("aggregate(want, 0L, (a, w) -> a + w.n + 200)")), F.lit(0)), F.avg(F.size("want"))).first()
    shards = max(1, size[0] // shard_bytes)
    per_row = 64 + 40 * int(size[1] or 0)
    texts = _with_texts(docs, wanted, id_col, text_col, "inner", per_row, max_broadcast_bytes)
    pieces = texts.select("data", F.explode("want").alias("w")).select(
        F.pmod("w.anchor", F.lit(shards)).alias("shard"), "w.anchor", "w.own", "w.bytes",
        F.expr(f"substring(data, w.lo + 1, w.n + {length - 1})").alias("piece"),
    )
    pieces = stored(pieces, "pieces")

    def by_transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            found = _shard_spans(rows, length)
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "own", "found"]
            )

        shard, rows = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for number, *row in zip(*columns, strict=True):
                if number != shard and rows:
                    yield batch(rows)
                    rows = []
                shard = number
                rows.append(tuple(row))
        if rows:
            yield batch(rows)

    def by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, own, piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                digests = [xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(len(piece) - length + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([own] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array(digests, pa.binary())],
                    names=["anchor", "own", "at", "window"],
                )

    cold = pieces.filter(F.col("bytes") <= hot_bytes).select("shard", "anchor", "own", "piece")
    cold = cold.repartition("shard").sortWithinPartitions("shard", "anchor", "own")
    found = cold.mapInArrow(by_transform, "anchor long, own long, found array<int>")
    hot = pieces.filter(F.col("bytes") > hot_bytes).select("anchor", "own", "piece").dropDuplicates(["anchor", "own"])
    windows = hot.mapInArrow(by_window, "anchor long, own long, at int, window binary")
    twice = windows.groupBy("window").agg(F.count("*").alias("times")).filter("times > 1").select("window")
    hot_found = windows.join(twice, "window").groupBy("anchor", "own").agg(
        F.flatten(F.sort_array(F.collect_list(F.array("at", F.col("at") + 1)))).alias("found")
    )
    found = stored(found.unionByName(hot_found), "found")

    whole = kinds.filter("times > 1").select("anchor", "own", F.lit(None).cast("array<int>").alias("found"))
    told = found.join(whole.select("anchor", "own"), ["anchor", "own"], "left_anti").unionByName(whole)
    # Windows of a segment that repeat, as byte runs of the document.
    mine = F.when(F.col("found").isNull(), F.array(F.lit(0), F.col("n"))).otherwise(F.col("found"))
    runs = F.expr(
        f"transform(sequence(0, size(f) - 1, 2), i -> array(lo + f[i], lo + f[i + 1] - 1 + {length}))"
    )
    covered = each.join(told, ["anchor", "own"]).withColumn("f", mine).select("k", runs.alias("runs"))
    per_row = covered.groupBy("k").agg(F.flatten(F.array_sort(F.flatten(F.collect_list("runs")))).alias("runs"))

    @F.pandas_udf("array<int>")
    def merged(all_runs: pd.Series) -> pd.Series:
        return all_runs.map(_merge)

    return (
        per_row.join(table.select("k", "id", "tid"), "k")
        .select("id", "tid", merged("runs").alias("spans"))
        .groupBy("id", "tid")  # rows that repeat id and text have the same runs
        .agg(F.max("spans").alias("spans"))
    )


def _merge(flat) -> np.ndarray:
    """Sorted runs, as alternating starts and ends, with those that touch made one."""
    runs = np.asarray(flat, dtype=np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)
    return np.stack([runs[new, 0], ends[last]], axis=1).ravel()


def _kept(data: bytes, spans) -> bytes:
    if spans is None:
        return data
    at, out = 0, []
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    rows = _spanned(docs, id_col, text_col, **how)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = data.as_py()
                kept = _kept(data, spans)
                out.append((len(data), len(data) - len(kept), len(spans or ()) // 2, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    out = rows.mapInArrow(digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _spanned(docs: DataFrame, id_col: str, text_col: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, **how) -> DataFrame:
    spans = stored(repeated_spans(docs, id_col, text_col, max_broadcast_bytes=max_broadcast_bytes, **how), "spans")
    mean = spans.agg(F.avg(F.size("spans"))).first()[0] or 0
    rows = _with_texts(docs, spans, id_col, text_col, "left", 64 + 4 * int(mean), max_broadcast_bytes)
    return rows.select("id", "data", "spans")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES, **how) -> DataFrame:
    """``docs`` without the repeated bytes in their texts."""
    spans = stored(repeated_spans(docs, id_col, text_col, max_broadcast_bytes=max_broadcast_bytes, **how), "spans")
    rows = wrapped(docs, own_id=F.col(id_col).cast("long"), own_tid=F.unhex(F.md5(text_or_empty(text_col))))
    on = rows["own_id"].eqNullSafe(spans["id"]) & (rows["own_tid"] == spans["tid"])

    @F.pandas_udf("string")
    def cut(texts, all_spans):
        return texts.combine(all_spans, lambda t, s: None if t is None else _kept(t.encode(), s).decode("utf-8", "replace"))

    text = F.col(f"row.{text_col}")
    text = F.when(F.col("spans").isNull(), text).otherwise(cut(text, F.col("spans")))
    return rows.join(spans, on, "left").select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
