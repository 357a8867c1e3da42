"""Keyed log operators on unbounded input.

Each operator keeps a bounded state per key and handles one micro-batch of a
bucket of keys at a time; batch size is set by the source's admission options
(``maxFilesPerTrigger`` and the like). Rows of a key are taken in ``seq`` order
within a batch, batches in arrival order. All outputs are append-only and carry
``seq``, so readers get the newest state of a key with ``latest``.

How a key ends:

* ``idle`` with an event-time column ``ts`` (throughout ``timestamp``): when the
  watermark, ``delay`` behind the newest row, passes a key's last row by that much,
  a timer gives out what is unfinished and drops the state. Rows later than
  ``delay`` are dropped, as Structured Streaming does; the default is later than
  any log.
* ``run_to_end`` closes a stream whose input has ended, so that all timers go off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clipledger import constants as C
from clipledger.functions.keys import as_list, micros
from clipledger.functions.shared import shared_dir
from clipledger.operators.throttle import Cell

_L, _D, _S, _B, _Y = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.BooleanType()
#: Nothing is late against so long a delay.
NEVER_LATE = "36500 days"
#: Keys are dealt to so many buckets, each with the states of its keys; fixed for a checkpoint.
BUCKETS = 1024
def _struct(pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


def _batch(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """The rows of a bucket's micro-batch; rows without a number only move the watermark."""
    pdf = pd.concat(list(parts), ignore_index=True)
    return pdf[pdf["x_s"].notna()].sort_values(list(order), kind="stable").reset_index(drop=True)


class _Operator:
    """A keyed operator, called with the keys of a bucket together.

    ``step`` takes a key's rows and its state, if any, and gives a frame without the
    key and the new state; ``end`` gives the frame of a key that ended. The last part
    of a state is when its key ends, in milliseconds. A call of its own for each key
    costs some milliseconds in Spark; the timer of a bucket is that of its first key.
    """

    state: list = []
    idle_ms: int | None = None

    def end(self, known: tuple) -> pd.DataFrame | None:
        return None

    def ends(self, ended: dict) -> list[pd.DataFrame]:
        """Frames of keys that ended, with their keys."""
        return [out.assign(x_key=k) for k, known in ended.items() if (out := self.end(known)) is not None]

    def __call__(self, parts, state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: tuple(known) for k, *known in state.get[0]} if state.exists else {}
        outs, fresh = [], set()
        if not state.hasTimedOut:
            for key, pdf in _batch(parts, *self.order).groupby("x_key", sort=False):
                pdf = pdf.reset_index(drop=True)
                out, known = self.step(pdf, held.get(key))
                if self.idle_ms is not None:
                    known = (*known[:-1], max(known[-1] or 0, int(pdf["x_ms"].max()) + self.idle_ms))
                held[key] = known
                fresh.add(key)
                if out is not None and len(out):
                    outs.append(out.assign(x_key=key))
        if self.idle_ms is not None:
            now = state.getCurrentWatermarkMs()
            ended = {k: held.pop(k) for k, known in list(held.items()) if k not in fresh and known[-1] < now}
            outs += self.ends(ended)
        if held:
            state.update(([(k, *known) for k, known in held.items()],))
            if self.idle_ms is not None:
                # Past the watermark already if a key was late; it then ends with the next batch.
                state.setTimeoutTimestamp(max(min(known[-1] for known in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if outs:
            out = pd.concat(outs, ignore_index=True)
            for c in self.texts:  # a column without any text would be one of numbers
                out[c] = pd.Series([None if pd.isna(v) else v for v in out[c]], index=out.index, dtype=object)
            yield out[self.columns]


def _apply(df: DataFrame, key, op: _Operator, out_fields) -> DataFrame:
    """``op`` over the rows of each key; a key is one text inside, so that NULLs and types survive the way to Python."""
    key = as_list(key)
    fields = T.StructType([df.schema[k] for k in key])
    out = _struct([("x_key", _S), *out_fields])
    op.columns, op.texts = out.names, [f.name for f in out.fields if f.dataType == _S]
    rows = df.select(F.to_json(F.struct(*key)).alias("x_key"), *[c for c in df.columns if c.startswith("x_")])
    rows = rows.withColumn("x_bucket", F.pmod(F.xxhash64("x_key"), F.lit(BUCKETS)).cast("int"))
    end = GroupStateTimeout.NoTimeout if op.idle_ms is None else GroupStateTimeout.EventTimeTimeout
    run = lambda _, parts, state: op(parts, state)
    held = _struct([("keys", T.ArrayType(_struct([("key", _S), *op.state, ("ends", _L)])))])
    shown = rows.groupBy("x_bucket").applyInPandasWithState(run, out, held, "append", end)
    own = F.from_json("x_key", fields)
    return shown.select(*[own[k].alias(k) for k in key], *[n for n, _ in out_fields])


def _timed(df: DataFrame, ts: str | None, idle: str | None, delay: str) -> tuple[DataFrame, int | None]:
    """Rows with the event time as ``x_at`` and a watermark, and ``idle`` in milliseconds."""
    if idle is None:
        return df, None
    at = df.withColumn("x_at", F.col(ts).cast("timestamp")).withColumn("x_ms", F.unix_millis("x_at"))
    return at.withWatermark("x_at", delay), int(pd.Timedelta(idle).total_seconds() * 1000)


class _Latest(_Operator):
    order = ("x_s",)

    def __init__(self, fields, emit_on, end_field, end_value, idle_ms):
        self.fields, self.emit_on, self.end_field, self.end_value, self.idle_ms = fields, emit_on, end_field, end_value, idle_ms
        # The last line, if it has not been given out but shall be when the key ends.
        self.state = [*[(f, _S) for f in fields], ("seq", _L)]

    def step(self, pdf, known):
        *values, _, ends = known or (None,) * (len(self.fields) + 2)
        snap = pd.DataFrame({"seq": pdf["x_s"].astype("int64")})
        for f, before in zip(self.fields, values, strict=True):
            latest = pdf["x_v"].where(pdf["x_f"] == f).ffill()
            snap[f] = latest if before is None else latest.fillna(before)
        ended = (pdf["x_f"] == self.end_field) & (pdf["x_v"] == self.end_value)
        snap["ended"] = ended
        shown = pdf["x_f"].isin(self.emit_on) | ended
        if self.idle_ms is None:
            shown |= pdf["x_cut"]
        cut = self.idle_ms is not None and bool(pdf["x_cut"].iloc[-1]) and not bool(shown.iloc[-1])
        last = [None if pd.isna(snap[f].iloc[-1]) else snap[f].iloc[-1] for f in self.fields]
        return snap[shown].copy(), (*last, int(snap["seq"].iloc[-1]) if cut else None, ends)

    def end(self, known):
        *values, seq, _ = known
        if seq is not None:
            return pd.DataFrame({"seq": [seq], **{f: pd.Series([v], dtype=object) for f, v in zip(self.fields, values, strict=True)}, "ended": [False]})


def stream_latest_progress(
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
    ts: str | None = None,
    idle: str | None = None,
    delay: str = NEVER_LATE,
) -> DataFrame:
    """Snapshots of the latest field values, as ``fill_snapshots`` gives on a table.

    A line that ``unterminated`` flags is given out when its key ends, if no line
    came after it; without ``idle`` as it comes. State: the latest value of each
    field.
    """
    fields, emit_on = list(fields), list(emit_on)
    cut = F.lit(False) if unterminated is None else F.coalesce(F.col(unterminated), F.lit(False))
    lines, idle_ms = _timed(lines, ts, idle, delay)
    rows = lines.select(
        *as_list(key), F.col(seq).cast("long").alias("x_s"), F.col(field).alias("x_f"),
        F.col(value).alias("x_v"), cut.alias("x_cut"), *(["x_at", "x_ms"] if idle else []),
    )
    op = _Latest(fields, emit_on, end_field, end_value, idle_ms)
    out = [("seq", _L), *[(f, _S) for f in fields], ("ended", _Y)]
    return _apply(rows, key, op, out)


class _Throttle(_Operator):
    order = ("x_t", "x_s")
    state = [("t", _L), ("p", _D), ("stage", _S)]

    def __init__(self, idle_ms):
        self.idle_ms = idle_ms

    def step(self, pdf, known):
        before = pdf["x_stage"].shift(1)
        last_t, last_p = -np.inf, 0.0
        if known:
            last_t, last_p, before.iloc[0], _ = known
        sure = ((pdf["x_stage"] != before) | (pdf["x_p"] >= C.PROGRESS_DONE)).to_numpy()
        cell = Cell(pdf["x_t"].to_numpy(), pdf["x_p"].to_numpy(), sure)
        kept = np.flatnonzero(cell.emitted(float(last_t), float(last_p)))
        if len(kept):
            i = kept[-1]
            known = (int(cell.real[i]), float(cell.p[i]), pdf["x_stage"].iloc[i], known and known[-1])
        return pd.DataFrame({"seq": pdf["x_s"].to_numpy()[kept]}), known


def stream_throttle(
    df: DataFrame, key, ts: str, seq: str, stage: str, pct: str, at: str | None = None, idle: str | None = None, delay: str = NEVER_LATE
) -> DataFrame:
    """Throttled progress rows. State: time, progress and stage of the last emitted row.

    ``at`` is the event time by which a key is idle.
    """
    df, idle_ms = _timed(df, at, idle, delay)
    rows = df.select(
        *as_list(key),
        F.col(seq).cast("long").alias("x_s"),
        micros(df, ts).alias("x_t"),
        F.coalesce(F.col(pct).cast("double"), F.lit(0.0)).alias("x_p"),
        F.coalesce(F.col(stage), F.lit("")).alias("x_stage"), *(["x_at", "x_ms"] if idle else []),
    )
    return _apply(rows, key, _Throttle(idle_ms), [("seq", _L)])


class _Pattern(_Operator):
    order = ("x_s",)
    state = [("end", _L), ("carry", _B), ("hits", _L)]

    def __init__(self, pattern, idle_ms):
        self.keep, self.pattern, self.idle_ms = len(pattern) - 1, pattern, idle_ms

    def step(self, pdf, known):
        find = re.compile(b"(?=" + re.escape(self.pattern) + b")")
        end, carry, count, ends = known or (0, b"", 0, None)
        for at, data in zip(pdf["x_o"], pdf["x_c"], strict=True):
            data = bytes(data) if data is not None else b""
            at = end if pd.isna(at) else int(at)
            if at < end:
                end, carry, count = 0, b"", 0
            elif at > end:
                carry = b""
            joined = bytes(carry) + data
            count += sum(1 for _ in find.finditer(joined))
            carry = joined[-self.keep :] if self.keep else b""
            end = at + len(data)
        return pd.DataFrame({"seq": [int(pdf["x_s"].iloc[-1])], "hits": [int(count)]}), (int(end), carry, int(count), ends)


def stream_pattern_count(
    chunks: DataFrame, key, seq: str, offset: str | None, chunk: str, pattern: bytes,
    ts: str | None = None, idle: str | None = None, delay: str = NEVER_LATE,
) -> DataFrame:
    """Running number of pattern occurrences in a growing byte stream.

    Only new bytes are scanned, prefixed by the last ``m - 1`` old ones. A
    chunk that starts before the end of what was read means the stream was
    truncated: counting restarts. A chunk that starts behind that end leaves a
    gap, so old bytes do not precede it. Without ``offset`` each chunk follows the
    one before. State: end offset, carry, count.
    """
    chunks, idle_ms = _timed(chunks, ts, idle, delay)
    rows = chunks.select(
        *as_list(key), F.col(seq).cast("long").alias("x_s"),
        (F.lit(None) if offset is None else F.col(offset)).cast("long").alias("x_o"), F.col(chunk).cast("binary").alias("x_c"),
        *(["x_at", "x_ms"] if idle else []),
    )
    return _apply(rows, key, _Pattern(pattern, idle_ms), [("seq", _L), ("hits", _L)])


class _Tail(_Operator):
    order = ("x_s",)
    state = [("tail", _B), ("seq", _L)]

    def __init__(self, limit, idle_ms):
        self.limit, self.idle_ms = limit, idle_ms

    def step(self, pdf, known):
        held, _, ends = known or (b"", None, None)
        size, fresh = 0, []
        for data in reversed(pdf["x_b"].tolist()):
            if size >= self.limit:
                break
            if data is not None:
                fresh.append(bytes(data))
                size += len(data)
        tail = b"".join([bytes(held), *fresh[::-1]])[-self.limit :]
        seq = int(pdf["x_s"].iloc[-1])
        return None if self.idle_ms is not None else pd.DataFrame({"seq": [seq], "tail": [tail]}), (tail, seq, ends)

    def ends(self, ended):
        seqs, tails = [known[1] for known in ended.values()], [bytes(known[0]) for known in ended.values()]
        return [pd.DataFrame({"x_key": list(ended), "seq": seqs, "tail": tails})] if ended else []


def stream_tail(
    lines: DataFrame, key, seq: str, text: str, limit: int = C.TAIL_BYTES,
    ts: str | None = None, idle: str | None = None, delay: str = NEVER_LATE,
) -> DataFrame:
    """Last ``limit`` bytes per key: when the key ends or, without ``idle``, after each micro-batch.

    State: those bytes.
    """
    lines, idle_ms = _timed(lines, ts, idle, delay)
    rows = lines.select(
        *as_list(key), F.col(seq).cast("long").alias("x_s"), F.col(text).cast("binary").alias("x_b"), *(["x_at", "x_ms"] if idle else [])
    )
    return _apply(rows, key, _Tail(limit, idle_ms), [("seq", _L), ("tail", _B)])


def latest(df: DataFrame, key, seq: str = "seq") -> DataFrame:
    """Newest output row of every key."""
    key = as_list(key)
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("x_r")).select(*key, "x_r.*")


def run_available(stream: DataFrame, purpose: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process everything available into a table of the shared folder.

    With the same ``checkpoint`` and ``out`` a later call continues where the
    former one stopped.
    """
    spark = stream.sparkSession
    out = out or shared_dir(spark, purpose)
    checkpoint = checkpoint or shared_dir(spark, f"{purpose}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Closing:
    """The end of a stream as a source of its own: a row far in the future, once it is closed."""

    def __init__(self, spark: SparkSession, schema: T.StructType, ts: str):
        self.spark, self.schema, self.ts = spark, schema, ts
        self.path = shared_dir(spark, "stream-end")
        self._write([])

    def _write(self, rows: list) -> None:
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.path)

    def follow(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.path))

    def close(self) -> None:
        end = pd.Timestamp("2262-01-01").to_pydatetime()
        self._write([tuple(end if f.name == self.ts else None for f in self.schema)])


def run_to_end(stream: DataFrame, ts: str, operator, purpose: str) -> DataFrame:
    """All rows of ``operator`` over a stream whose input has ended, with what its keys' ends give out.

    ``operator`` takes the stream and must ignore rows without a number.
    """
    spark = stream.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema])
    closing = Closing(spark, schema, ts)
    out, checkpoint = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-checkpoint")
    run_available(operator(closing.follow(stream)), purpose, checkpoint, out)
    closing.close()
    return run_available(operator(closing.follow(stream)), purpose, checkpoint, out)
