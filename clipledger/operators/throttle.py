"""Progress throttling: each decision depends on the last emitted row.

A row is emitted if the stage changed, progress is complete, progress grew by
a step, or a second passed - all since the last *emitted* row of its key. That
is a fold along a key, not a window. It is cut into chunks of bounded rows:

* All rows are put into the order (key, time, sequence) by range partitioning,
  so a key with a third of all rows is many partitions, and numbered. A chunk is
  a stretch of consecutive numbers, whatever keys it holds.
* A row after a gap of a second, with a new stage, complete, or first of its key
  is *sure*: emitted whatever the state. (The last emitted stage always equals
  the previous row's stage.) Between two sure rows the fold is independent of
  everything else, so only a chunk that opens with a row that is not sure needs
  to know what was emitted before it.
* An emission matters for one second. Such a chunk is walked for every row of the
  second before it, which gives a map from the last emitted row before the chunk
  to the last one within. If the chunk has a sure row the map is constant.
* Maps that are not constant are composed along the chunks by doubling: after
  round ``k`` a map leads over ``2^k`` chunks, so rounds grow with the logarithm
  of the longest stretch without a sure row. No task sees a whole key.
* With what was emitted before it known, each chunk emits its rows.

Results equal the sequential fold exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger import constants as C
from clipledger.functions.keys import as_list, micros, restore, solid
from clipledger.functions.shared import written

_SECOND = int(C.PROGRESS_SECONDS * 1_000_000)
#: A chunk has at most two to this power rows.
CHUNK_BITS = 18
_NARROW = ["__id", "__t", "__p", "__stage"]


class Cell:
    """Consecutive rows as arrays. ``sure`` is true at the first row of a key; times rise within a key."""

    def __init__(self, t: np.ndarray, p: np.ndarray, sure: np.ndarray):
        n = len(t)
        self.real, self.p, self.sure = t, p, sure
        # Where time falls a new key begins; its times are moved behind those of the keys before it.
        fall = np.minimum(np.diff(t, prepend=t[:1]), 0)
        self.t = t - np.cumsum(np.where(fall < 0, fall - 2 * _SECOND, 0))
        at = np.where(sure, np.arange(n), n)
        self.next_sure = np.append(np.minimum.accumulate(at[::-1])[::-1], n)

    def following(self, start: int, last_t: float, last_p: float) -> int:
        """First row from ``start`` on that is emitted after the given state."""
        end = int(self.next_sure[start]) if start < len(self.t) else start
        end = max(start, min(end, int(np.searchsorted(self.t, last_t + _SECOND, "left"))))
        grown = self.p[start:end] - last_p >= C.PROGRESS_STEP
        first = int(grown.argmax()) if end > start else 0
        return start + first if end > start and grown[first] else end

    def emitted(self, last_t: float, last_p: float) -> np.ndarray:
        """Which rows are emitted after the given state."""
        n = len(self.t)
        out = self.sure.copy()
        open_ends = np.flatnonzero(self.sure[:-1] & ~self.sure[1:])
        starts = [*([self.following(0, last_t, last_p)] if n and not self.sure[0] else []),
                  *(self.following(i + 1, self.t[i], self.p[i]) for i in open_ends)]
        for i in starts:
            while i < n and not self.sure[i]:
                out[i] = True
                i = self.following(i + 1, self.t[i], self.p[i])
        return out

    def exits(self, first: list[int]) -> dict[int, int]:
        """Last emitted row for each first emitted row; shared tails are walked once."""
        end: dict[int, int] = {}
        for f in first:
            path, i = [], f
            while i < len(self.t) and i not in end:
                path.append(i)
                i = self.following(i + 1, self.t[i], self.p[i])
            last = end[i] if i in end else path[-1]
            end.update((j, last) for j in path)
        return end


def _cell(rows: pa.Table, opens_sure: bool) -> Cell:
    """``rows`` have ``__id, __t, __p, __stage`` and whether the key is that of the row before, ``__again``."""
    t, p = rows["__t"].to_numpy(), rows["__p"].to_numpy()
    stage = rows["__stage"].combine_chunks().dictionary_encode().indices.to_numpy()
    sure = (p >= C.PROGRESS_DONE) | ~rows["__again"].to_numpy(zero_copy_only=False)
    sure[1:] |= (stage[1:] != stage[:-1]) | (t[1:] - t[:-1] >= _SECOND)
    sure[:1] = opens_sure
    return Cell(t, p, sure)


def throttle(df: DataFrame, key, ts: str, seq: str, stage: str, pct: str, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rows that a throttled printer would show, in the columns of ``df``.

    Rows of a key are taken by ``(ts, seq)``; ``seq`` is an integer, unique
    within the key. ``pct`` is a fraction. A NULL time counts as the epoch, NULL
    progress as none.
    """
    names = as_list(key)
    df, key = solid(df, names)
    rows = df.withColumns(
        {
            "__s": F.col(seq).cast("long"), "__t": F.coalesce(micros(df, ts).cast("long"), F.lit(0)),
            "__p": F.coalesce(F.col(pct).cast("double"), F.lit(0.0)), "__stage": F.coalesce(F.col(stage), F.lit("")),
        }
    )
    order = [*key, "__t", "__s"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__s")
    placed = written(placed.withColumn("__id", F.monotonically_increasing_id()), "throttle-order")
    placed = placed.withColumn("__chunk", F.shiftright("__id", chunk_bits))
    chunks = written(_chunks(placed, key), "throttle-chunks")
    entries = _entries(placed, chunks, key, chunk_bits)

    known = chunks.select("__chunk", "__opens_sure").join(entries, "__chunk", "left")
    work = placed.join(known, "__chunk").withColumn("__key", F.xxhash64(*key))
    columns = df.columns

    def emit(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        t, p = table["__last_t"][0].as_py(), table["__last_p"][0].as_py()
        cell = _cell(table, table["__opens_sure"][0].as_py())
        return table.filter(pa.array(cell.emitted(-np.inf if t is None else t, p or 0.0))).select(columns)

    shown = work.groupBy("__chunk").applyInArrow(emit, T.StructType([df.schema[c] for c in columns]))
    return restore(shown, names)


def _in_order(table: pa.Table) -> pa.Table:
    """Rows by number, with ``__again``: the key is that of the row before."""
    table = table.sort_by("__id")
    key = table["__key"].to_numpy()
    return table.append_column("__again", pa.array(np.append(False, key[1:] == key[:-1])[: len(key)]))


def _chunks(placed: DataFrame, key: list[str]) -> DataFrame:
    """A row per chunk: its first row, whether that is sure, and the chunk after it."""
    ends = placed.groupBy("__chunk").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    at = ends.select("__chunk", F.explode(F.array("__first", "__last")).alias("__id"), "__first").distinct()
    rows = placed.select("__id", F.struct(*key).alias("k"), "__t", "__p", "__stage").join(at, "__id")
    here = F.struct("k", "__t", "__p", "__stage")
    edges = rows.groupBy("__chunk").agg(
        F.min("__id").alias("__first"), F.min_by(here, "__id").alias("one"), F.max_by(here, "__id").alias("end")
    )
    # One row per chunk of rows goes to this task.
    along = Window.orderBy("__chunk")
    edges = edges.withColumn("was", F.lag("end").over(along)).withColumn("__next", F.lead("__chunk").over(along))
    sure = (
        F.col("was").isNull() | (F.col("was.k") != F.col("one.k")) | (F.col("was.__stage") != F.col("one.__stage"))
        | (F.col("one.__p") >= C.PROGRESS_DONE) | (F.col("one.__t") - F.col("was.__t") >= _SECOND)
    )
    edges = edges.withColumn("__opens_sure", sure).withColumn(
        "__next_asks", F.coalesce(~F.lead("__opens_sure").over(along), F.lit(False))
    )
    return edges.select(
        "__chunk", "__first", "one.k.*", F.col("one.__t").alias("__first_t"), "__opens_sure", "__next", "__next_asks"
    )


def _entries(placed: DataFrame, chunks: DataFrame, key: list[str], chunk_bits: int) -> DataFrame:
    """``__chunk, __last_t, __last_p``: the last emission before each chunk that has to know it."""
    spark = placed.sparkSession
    asks = chunks.where("NOT __opens_sure")
    if asks.isEmpty():
        return spark.createDataFrame([], "__chunk long, __last_t long, __last_p double")
    maps = written(_maps(placed, chunks, asks, key), "throttle-maps")
    # What leaves a chunk enters the next one, as nothing where it is older than a second there.
    nodes = maps.select(F.col("__chunk").alias("c"), F.col("__entry").alias("e"))
    steps = maps.where("__next_asks").join(
        nodes.where("e IS NOT NULL"), (F.col("__next") == F.col("c")) & (F.col("__exit") == F.col("e")), "left"
    ).select("__chunk", "__entry", "__fixed", F.col("__next").alias("c"), F.col("e").alias("e"), "__exit_t", "__exit_p")
    steps = written(steps, "throttle-steps")
    known = steps.where("__fixed").select("c", "e").distinct()
    jumps = steps.where("NOT __fixed").select(F.col("__chunk").alias("fc"), F.col("__entry").alias("fe"), "c", "e")
    while not jumps.isEmpty():
        onward = known.join(jumps.withColumnsRenamed({"c": "tc", "e": "te"}), (F.col("c") == F.col("fc")) & F.col("e").eqNullSafe(F.col("fe")))
        known = written(known.unionByName(onward.select(F.col("tc").alias("c"), F.col("te").alias("e"))), "throttle-known")
        first, second = jumps.alias("a"), jumps.alias("b")
        twice = first.join(second, (F.col("a.c") == F.col("b.fc")) & F.col("a.e").eqNullSafe(F.col("b.fe")))
        jumps = written(twice.select("a.fc", "a.fe", "b.c", "b.e"), "throttle-jumps")
    # The state that enters is what the step before it left; without one among the rows of the last second, none.
    left = steps.select(F.col("c"), "e", F.col("__exit_t").alias("t"), F.col("__exit_p").alias("p")).where("e IS NOT NULL").distinct()
    got = known.where("e IS NOT NULL").join(left, ["c", "e"])
    return got.select(F.col("c").alias("__chunk"), F.col("t").alias("__last_t"), F.col("p").alias("__last_p"))


def _maps(placed: DataFrame, chunks: DataFrame, asks: DataFrame, key: list[str]) -> DataFrame:
    """``__chunk, __entry, __exit, __exit_t, __exit_p, __fixed`` and what follows the chunk.

    Chunks that ask, and those before them. ``__entry`` is the last row emitted
    before the chunk, NULL if that was more than a second ago.
    """
    bucket = lambda t: F.floor(t / F.lit(_SECOND)).cast("long")
    wanted = asks.select(
        *key, F.col("__chunk").alias("c"), "__first", "__first_t",
        F.explode(F.array(bucket(F.col("__first_t")), bucket(F.col("__first_t")) - 1)).alias("__second"),
    )
    narrow = placed.select(*key, "__chunk", *_NARROW)
    leads = narrow.withColumn("__second", bucket(F.col("__t"))).join(wanted, [*key, "__second"])
    leads = leads.where((F.col("__id") < F.col("__first")) & (F.col("__t") > F.col("__first_t") - _SECOND))
    leads = leads.select(F.col("c").alias("__chunk"), *_NARROW, F.lit(0).cast("long").alias("__key"), F.lit(True).alias("__lead"))
    own = chunks.where("NOT __opens_sure OR __next_asks").select("__chunk", "__opens_sure")
    rows = narrow.select("__chunk", *_NARROW, F.xxhash64(*key).alias("__key"), F.lit(False).alias("__lead")).unionByName(leads)
    schema = "__chunk long, __entry long, __exit long, __exit_t long, __exit_p double, __fixed boolean"

    def walk(table: pa.Table) -> pa.Table:
        chunk, opens_sure = table["__chunk"][0].as_py(), table["__opens_sure"][0].as_py()
        lead = table.filter(table["__lead"]).sort_by("__id")
        mine = _in_order(table.filter(pc.invert(table["__lead"])))
        cell, ids = _cell(mine, opens_sure), mine["__id"].to_numpy()
        state = lambda i: (int(ids[i]), int(cell.real[i]), float(cell.p[i]))
        sure = np.flatnonzero(cell.sure)
        if len(sure):
            last = int(sure[-1])
            out = [(chunk, None, *state(cell.exits([last])[last]), True)]
            # Entries are listed so that what enters can be told; they all leave alike.
            out += [(chunk, e, *out[0][2:]) for e in lead["__id"].to_pylist()]
        else:
            entries = [(None, -np.inf, 0.0), *zip(*(lead[c].to_pylist() for c in ("__id", "__t", "__p")), strict=True)]
            first = [cell.following(0, t, p) for _, t, p in entries]
            end = cell.exits(sorted({f for f in first if f < len(ids)}))
            out = [
                (chunk, e, *(state(end[f]) if f in end else (e, t, p)), False)
                for (e, t, p), f in zip(entries, first, strict=True)
            ]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        names = ["__chunk", "__entry", "__exit", "__exit_t", "__exit_p", "__fixed"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    found = rows.join(own, "__chunk").groupBy("__chunk").applyInArrow(walk, schema)
    return found.join(chunks.select("__chunk", "__next", "__next_asks"), "__chunk")
