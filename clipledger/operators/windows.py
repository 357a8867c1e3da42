"""Ordered per-key operators.

Every operator works on keys of any size: ranks, carries and byte budgets are
computed inside bounded segments and combined on segment summaries (see
``functions.segments``), per-key heads and tails use Spark's window group
limit, which trims each map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions.keys import as_list, join_on, micros, restore, solid
from clipledger.functions.segments import (
    SEG, SEGMENT_ROWS, along, attach, before, inside, summarise, upto, with_rank, with_segment,
)
from clipledger.functions.skew import ROWS_PER_TASK, salted_join


# ------------------------------------------------------------------ retime

def retime(
    df: DataFrame, key, seq: str, rate_num: str, rate_den: str, out: str = "t",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Frame *i* of a key gets the timestamp ``i * den / num`` seconds.

    The product is an exact integer; only the last division is floating.
    """
    ranked = with_rank(df, key, seq, "__rank", segment_rows)
    return ranked.withColumn("frame", F.col("__rank") - 1).withColumn(
        out,
        (F.col("frame") * F.col(rate_den)).cast("double") / F.col(rate_num).cast("double"),
    ).drop("__rank")


# --------------------------------------------------------- heads and tails

def dedupe_keep_first(df: DataFrame, key, order) -> DataFrame:
    """First row per key in ``order``, which must be unique within a key.

    ``row_number() = 1`` becomes a group limit: each map task forwards at most
    one row per key, so a hot key cannot fill a task.
    """
    w = Window.partitionBy(*as_list(key)).orderBy(*as_list(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def head_rows(df: DataFrame, key, seq, n: int = C.HEAD_LINES, marker: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    With ``marker`` one row more is kept when a key has further rows, flagged
    in a boolean column of that name (the place of the ``...`` line).
    """
    w = Window.partitionBy(*as_list(key)).orderBy(*as_list(seq))
    limit = n + (1 if marker else 0)
    ranked = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    return ranked.withColumn(marker, F.col("rn") > n) if marker else ranked


def tail_rows(df: DataFrame, key, seq, n: int = C.TAIL_LINES) -> DataFrame:
    """Last ``n`` rows per key; ``rn`` counts from the end."""
    w = Window.partitionBy(*as_list(key)).orderBy(*[F.col(c).desc() for c in as_list(seq)])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def tail_bytes(
    df: DataFrame, key, seq: str, text: str, limit: int = C.TAIL_BYTES,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rows (boundary row cut) that make up the last ``limit`` bytes per key.

    Byte totals per segment decide which segments can hold tail bytes; only
    their rows are windowed. Adds ``tail`` (binary).
    """
    names = as_list(key)
    df, key = solid(df, names)
    data = F.col(text).cast("binary")
    cut = with_segment(df, seq, segment_rows)
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    sizes = summarise(cut.select(*key, SEG, size.alias("__b")), key, F.sum("__b").alias("__seg_b"))
    after = F.coalesce(F.sum("__seg_b").over(before(along(key, descending=True))), F.lit(0))
    alive = (
        sizes.withColumn("__after", after).where(F.col("__after") < limit).drop("__seg_b")
    )
    rows = attach(cut, alive, key, "inner").withColumn("__b", size)
    w = before(inside(key, seq, descending=True))
    rows = rows.withColumn(
        "__later", F.col("__after") + F.coalesce(F.sum("__b").over(w), F.lit(0))
    ).where((F.col("__later") < limit) & (F.col("__b") > 0))
    room = (F.lit(limit) - F.col("__later")).cast("int")
    start = F.greatest(F.octet_length(data) - room, F.lit(0)) + 1
    rows = rows.withColumn("tail", F.substring(data, start, room)).drop(
        "__after", "__later", "__b", SEG
    )
    return restore(rows, names)


# --------------------------------------------------------------- allocation

def allocate_slots(
    requests: DataFrame,
    taken: DataFrame,
    key,
    order: str,
    slot: str = "slot",
    max_slot: int = C.MAX_SLOT,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Lowest free positive slots for new requests, around sparse taken ones.

    Request number *r* of a key gets the *r*-th free slot. With the taken slots
    sorted as ``t1 < t2 < …``, the free slots below ``ti`` number ``ti - i``;
    hence request *r* lands on ``r + i`` for the largest *i* with
    ``ti - i < r``. That is one running maximum over taken slots and requests
    merged by position - no grid of numbers.

    Only requests ranked up to ``max_slot`` can be served, so the merge window
    holds at most ``2 * max_slot`` rows per key whatever the key's size; later
    requests get a NULL slot and a reason.
    """
    names = as_list(key)
    requests, key = solid(requests, names)
    taken, _ = solid(taken, names)
    ranked = with_rank(requests, key, order, "__rank", segment_rows)
    used = (
        taken.where(F.col(slot).between(1, max_slot)).select(*key, F.col(slot).alias("__t")).distinct()
    )
    # At most max_slot distinct slots per key reach this window.
    w = Window.partitionBy(*key).orderBy("__t")
    steps = (
        used.withColumn("__i", F.row_number().over(w))
        .groupBy(*key, (F.col("__t") - F.col("__i")).alias("__pos"))
        .agg(F.max("__i").alias("__i"))
    )
    servable = ranked.where(F.col("__rank") <= max_slot).select(
        *key, F.col("__rank").alias("__pos"), F.lit(None).cast("int").alias("__i"),
        F.col(order).alias("__o"),
    )
    merged = servable.unionByName(
        steps.select(*key, (F.col("__pos") + 1).alias("__pos"), F.col("__i").cast("int").alias("__i"),
                     F.lit(None).cast(requests.schema[order].dataType).alias("__o"))
    )
    m = upto(Window.partitionBy(*key).orderBy("__pos", F.col("__o").asc_nulls_first()))
    slots = (
        merged.withColumn("__skip", F.coalesce(F.max("__i").over(m), F.lit(0)))
        .where(F.col("__o").isNotNull())
        .select(*key, F.col("__o").alias(order), (F.col("__pos") + F.col("__skip")).alias(slot))
        .where(F.col(slot) <= max_slot)
    )
    served = join_on(ranked.drop("__rank"), slots, [*key, order], "left").withColumn(
        "slot_error", F.when(F.col(slot).isNull(), F.lit("no unused slot"))
    )
    return restore(served, names)


def slot_of_name(name: Column, prefix: Column, ext: str) -> Column:
    """Slot of an output file name: bare is 1, ``_N`` is N from 2; else NULL."""
    low, want = F.lower(name), F.lower(prefix)
    rest = F.when(low.startswith(want), F.substring(low, F.length(want) + 1, F.length(low)))
    digits = F.regexp_extract(rest, rf"^_([0-9]+)\.{ext}\z", 1)
    n = digits.try_cast("int")
    return F.when(rest == f".{ext}", F.lit(1)).when(
        n.between(2, C.MAX_SLOT), n
    )


def slot_name(prefix: Column, slot: Column, ext: str) -> Column:
    """File name of a slot; slot 1 is the bare name."""
    return F.when(slot == 1, F.concat(prefix, F.lit(f".{ext}"))).when(
        slot > 1, F.concat(prefix, F.lit("_"), slot.cast("string"), F.lit(f".{ext}"))
    )


# ----------------------------------------------------------------- progress

def progress_metrics(
    df: DataFrame, key, ts: str, done: str, total: str, spread: str,
    reported: str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Fraction, remaining seconds and rate of progress rows.

    The start of a key is its smallest ``ts``. It is one grouped value, joined
    back with hot keys split by the row count the same grouping provides.
    """
    names = as_list(key)
    rows, key = solid(df.withColumn("__t", micros(df, ts)), names)
    starts = rows.groupBy(*key).agg(
        F.min("__t").alias("__start"), F.count(F.lit(1)).alias("__rows")
    )
    rows = salted_join(
        rows, starts, key, F.col(spread), count="__rows", how="left", rows_per_task=rows_per_task
    )
    elapsed = (F.col("__t") - F.col("__start")) / 1e6
    rows = rows.withColumn("elapsed", elapsed).drop("__t", "__start", "__rows")
    return progress_columns(restore(rows, names), done, total, reported)


def progress_columns(df: DataFrame, done: str, total: str, reported: str | None = None) -> DataFrame:
    """``fraction``, ``eta`` and ``rate`` from ``elapsed`` and the counters."""
    d, t, e = F.col(done), F.col(total), F.col("elapsed")
    usable = (d > 0) & (t > 0)
    p = F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / t)))
    df = df.withColumn("fraction", p)
    p = F.col("fraction")
    shown = (p < 1) & (p >= C.ETA_MIN_FRACTION) & (e >= C.ETA_MIN_SECONDS)
    measured = F.when(usable & (e > 0), d / e)
    if reported is not None:
        measured = F.when(F.col(reported) > 0, F.col(reported).cast("double")).otherwise(measured)
    return df.withColumns({"eta": F.when(shown, e * (1 - p) / p), "rate": measured})


def fill_snapshots(
    lines: DataFrame,
    key,
    seq: str,
    field: str,
    value: str,
    fields: Sequence[str],
    emit_on: Sequence[str],
    end_field: str = "progress",
    end_value: str = "end",
    unterminated: str | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Key/value lines to snapshots holding the latest value of every field.

    A snapshot is emitted on a line of ``emit_on``, on the end line, and for
    the last line of a key if ``unterminated`` flags it. Latest values are
    carried over segment borders on the segment summaries.
    """
    key_names = as_list(key)
    lines, key = solid(lines, key_names)
    cut = with_segment(lines, seq, segment_rows)
    names = [f"f_{f}" for f in fields]
    s = F.col(seq)

    def of(f):
        return F.when(F.col(field) == f, F.col(value))

    per_seg = summarise(
        cut,
        key,
        F.max(s).alias("__max"),
        *[F.max_by(F.col(value), F.when((F.col(field) == f) & F.col(value).isNotNull(), s)).alias(n)
          for f, n in zip(fields, names)],
    )
    a = along(key)
    carried = per_seg.select(
        *key,
        SEG,
        F.max("__max").over(Window.partitionBy(*key)).alias("__last"),
        *[F.last(n, ignorenulls=True).over(before(a)).alias(f"__{n}") for n in names],
    )
    w = upto(inside(key, seq))
    rows = attach(
        cut.withColumns(
            {n: F.last(of(f), ignorenulls=True).over(w) for f, n in zip(fields, names)}
        ),
        carried,
        key,
    )
    emit = F.col(field).isin(list(emit_on)) | (
        (F.col(field) == end_field) & (F.col(value) == end_value)
    )
    if unterminated is not None:
        emit = emit | ((s == F.col("__last")) & F.col(unterminated))
    snapshots = rows.where(emit).select(
        *key,
        seq,
        *[F.coalesce(F.col(n), F.col(f"__{n}")).alias(f) for f, n in zip(fields, names)],
        ((F.col(field) == end_field) & (F.col(value) == end_value)).alias("ended"),
    )
    return restore(snapshots, key_names)


# ----------------------------------------------------------------- attempts

def first_verified_attempt(
    attempts: DataFrame, item, order: str, ok: Column, keep: Sequence[str], backend: str | None = None
) -> DataFrame:
    """First attempt that verified, else the last failure, with the outcome.

    ``order`` must be unique per item. If ``backend`` is given, a repeated
    attempt on a backend already tried does not count.
    """
    item = as_list(item)
    if backend is not None:
        attempts = attempts.groupBy(*item, backend).agg(
            F.min_by(F.struct(*[c for c in attempts.columns if c not in (*item, backend)]), order).alias("__a")
        ).select(*item, backend, "__a.*")
    good = F.coalesce(ok, F.lit(False))
    payload = F.struct(order, *keep)
    pick = attempts.groupBy(*item).agg(
        F.min_by(payload, F.when(good, F.col(order))).alias("__ok"),
        F.max_by(payload, order).alias("__last"),
        F.count(F.lit(1)).alias("attempts"),
    )
    chosen = F.coalesce(F.col("__ok"), F.col("__last"))
    return pick.select(
        *item,
        "attempts",
        F.col("__ok").isNotNull().alias("verified"),
        *[chosen[c].alias(c) for c in [order, *keep]],
    )
