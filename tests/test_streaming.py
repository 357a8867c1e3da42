"""Streams give the same rows as the batch operators, over several batches and a restart."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipledger.operators import aggregates as A
from clipledger.operators import windows as W
from clipledger.operators.throttle import throttle
from clipledger.plans import stream_queries
from clipledger.streaming import keyed as S

SCHEMA = "key string, seq long, t long, stage string, p double, f string, v string, text string, offset long"


@pytest.fixture(scope="module")
def data():
    rnd, out, at, t = random.Random(3), [], {}, 0
    for seq in range(400):
        key = rnd.choice(["hot", "hot", "hot", "b"])
        t += rnd.choice([0, 90_000, 400_000, 1_200_000])
        text = rnd.choice(["a", "aa", "ba", "line\n"])
        out.append((key, seq, t, "s" + str(t // 20_000_000), (seq % 90) / 91, rnd.choice(["frame", "fps", "time", "progress"]),
                    "end" if seq % 50 == 0 else str(seq), text, at.get(key, 0)))
        at[key] = at.get(key, 0) + len(text)
    return out


class Source:
    """A folder that receives the rows in order, a batch per file."""

    def __init__(self, spark, folder, data, n):
        self.spark, self.folder, self.data, self.n = spark, folder / "in", data, n
        self.size = len(data) // n
        self.checkpoint, self.out = str(folder / "cp"), str(folder / "out")

    def put(self, first, last):
        for i in range(first, last):
            part = self.data[i * self.size : (i + 1) * self.size]
            random.Random(i).shuffle(part)
            self.spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"{i:03d}"))

    def run(self, op):
        stream = (self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(str(self.folder)))
        return S.run_available(op(stream), "test", self.checkpoint, self.out)


def restarted(spark, tmp_path, data, op):
    src = Source(spark, tmp_path, data, 4)
    src.put(0, 2)
    src.run(op)
    src.put(2, 4)
    return src.run(op)


def test_latest_progress(spark, tmp_path, data, rows):
    fields = ["frame", "fps"]
    got = restarted(spark, tmp_path, data,
                    lambda d: S.stream_latest_progress(d, "key", "seq", "f", "v", fields, ["time"]))
    batch = spark.createDataFrame(data, SCHEMA)
    want = W.fill_snapshots(batch, "key", "seq", "f", "v", fields, ["time"])
    assert rows(got, "key", "seq", "frame", "fps", "ended") == rows(want, "key", "seq", "frame", "fps", "ended")


def timed(df):
    """The rows with an event time of their own."""
    return df.withColumn("at", F.timestamp_micros(F.col("t")))


def test_last_lines_come_when_the_stream_ends(spark, tmp_path, data, rows):
    """The last line of each key, which nothing follows, is given out once; a second end gives nothing."""
    fields = ["frame", "fps"]
    data = [r for r in data if r[0] != "b" or r[1] < 200] + [("c", 400, data[-1][2], "s", 0.5, "fps", "7", "a", 0)] * 1
    data = [(*r[:5], "fps" if r[1] in (199, 399) else r[5], *r[6:]) for r in data]
    src = Source(spark, tmp_path, data, 1)
    src.put(0, 1)
    read = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(src.folder))

    def operator(d):
        return S.stream_latest_progress(d.withColumn("cut", F.lit(True)), "key", "seq", "f", "v", fields, ["time"], unterminated="cut", ts="at", idle="1 hour")

    got = S.run_to_end(timed(read), "at", operator, "test")
    batch = spark.createDataFrame(data, SCHEMA).withColumn("cut", F.lit(True))
    want = W.fill_snapshots(batch, "key", "seq", "f", "v", fields, ["time"], unterminated="cut")
    assert rows(got, "key", "seq", "frame", "fps", "ended") == rows(want, "key", "seq", "frame", "fps", "ended")
    assert ("c", 400, None, "7", False) in rows(got, "key", "seq", "frame", "fps", "ended")


def test_idle_key_ends_while_others_go_on(spark, tmp_path, rows):
    """The watermark passes an idle key: its last line is given out, its state is gone, and it begins anew."""
    row = lambda key, seq, t, f, v: (key, seq, t * 1_000_000, "", 0.0, f, v, "a", 0)
    parts = [[row("k", 0, 10, "frame", "1"), row("o", 1, 10, "frame", "5")], [row("o", 2, 500, "frame", "6")], [row("o", 3, 501, "frame", "7")],
             [row("k", 4, 502, "time", "x"), row("o", 5, 503, "time", "x")]]
    src = Source(spark, tmp_path, [r for p in parts for r in p], 1)
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(str(src.folder / f"{i:03d}"))
    got = src.run(lambda d: S.stream_latest_progress(
        timed(d).withColumn("cut", F.lit(True)), "key", "seq", "f", "v", ["frame"], ["time"], unterminated="cut", ts="at", idle="60 seconds", delay="10 seconds"))
    assert rows(got, "key", "seq", "frame") == [("k", 0, "1"), ("k", 4, None), ("o", 5, "7")]


def test_idle_state_is_dropped(spark, tmp_path, rows):
    """The watermark passes a key between its chunks: what it had is forgotten, and the others' counts are not."""
    parts = [[("k", 0, 10), ("o", 0, 10)], [("o", 1, 500)], [("o", 2, 501)], [("k", 1, 502), ("o", 3, 503)]]
    src = Source(spark, tmp_path, [], 1)
    for i, p in enumerate(parts):
        chunk = [(k, s, t * 1_000_000, "", 0.0, "", "", "aa", 0) for k, s, t in p]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.parquet(str(src.folder / f"{i:03d}"))
    count = lambda idle: lambda d: S.stream_pattern_count(timed(d), "key", "seq", None, "text", b"aa", "at", idle, "10 seconds")
    # With its state the key has the pair across the border too.
    assert rows(src.run(count("60 seconds")), "key", "seq", "hits")[:2] == [("k", 0, 1), ("k", 1, 1)]
    src.checkpoint, src.out = str(tmp_path / "cp2"), str(tmp_path / "out2")
    assert rows(src.run(count("1 hour")), "key", "seq", "hits") == [("k", 0, 1), ("k", 1, 3), *(("o", i, 2 * i + 1) for i in range(4))]


def test_throttle(spark, tmp_path, data, rows):
    got = restarted(spark, tmp_path, data, lambda d: S.stream_throttle(d, "key", "t", "seq", "stage", "p"))
    want = throttle(spark.createDataFrame(data, SCHEMA), "key", "t", "seq", "stage", "p", 2)
    assert rows(got, "key", "seq") == rows(want, "key", "seq")


def test_pattern(spark, tmp_path, data, rows):
    got = restarted(spark, tmp_path, data, lambda d: S.stream_pattern_count(d, "key", "seq", "offset", "text", b"aa"))
    want = A.chunked_pattern_count(
        spark.createDataFrame(data, SCHEMA).withColumn("c", F.col("text").cast("binary")), "key", "seq", "c", b"aa", 16)
    assert rows(S.latest(got, "key"), "key", "hits") == rows(want, "key", "hits")


def test_pattern_restarts_when_stream_shrinks(spark, tmp_path, data, rows):
    chunks = [("k", i, 0, "", 0.0, "", "", text, off) for i, (text, off) in
              enumerate([("xaa", 0), ("aab", 3), ("aa", 0), ("a", 2)])]
    got = restarted(spark, tmp_path, chunks, lambda d: S.stream_pattern_count(d, "key", "seq", "offset", "text", b"aa"))
    assert rows(got, "seq", "hits") == [(0, 1), (1, 3), (2, 1), (3, 2)]


def test_pattern_does_not_join_bytes_across_a_gap(spark, tmp_path, data, rows):
    row = data[0]
    chunks = [("k", i, *row[2:7], "a", at) for i, at in enumerate([0, 5, 6])]
    src = Source(spark, tmp_path, chunks, 3)
    src.put(0, 3)
    out = src.run(lambda d: S.stream_pattern_count(d, "key", "seq", "offset", "text", b"aa"))
    assert rows(S.latest(out, "key"), "key", "hits") == [("k", 1)]
    follow = Source(spark, tmp_path / "b", chunks, 3)
    follow.put(0, 3)
    out = follow.run(lambda d: S.stream_pattern_count(d, "key", "seq", None, "text", b"aa"))
    assert rows(S.latest(out, "key"), "key", "hits") == [("k", 2)]


def test_tail(spark, tmp_path, data, rows):
    got = restarted(spark, tmp_path, data, lambda d: S.stream_tail(d, "key", "seq", "text", 40))
    want = {}
    for r in data:
        want[r[0]] = (want.get(r[0], b"") + r[7].encode())[-40:]
    assert {k: bytes(t) for k, t in rows(S.latest(got, "key"), "key", "tail")} == want


@pytest.mark.parametrize("limit", [7, 40])
def test_tail_over_many_batches_and_a_restart(spark, tmp_path, data, rows, limit):
    """After every one of six batches the tail is that of a table with the rows so far."""
    src = Source(spark, tmp_path, data[:120], 6)
    op = lambda d: S.stream_tail(d, "key", "seq", "text", limit)
    src.put(0, 4)
    src.run(op)
    src.put(4, 6)
    got = src.run(op)
    held, want = {}, set()
    for i in range(6):
        part = data[i * 20 : (i + 1) * 20]
        for r in part:
            held[r[0]] = (held.get(r[0], b"") + r[7].encode())[-limit:]
        want |= {(k, max(r[1] for r in part if r[0] == k), held[k]) for k in {r[0] for r in part}}
    assert {(k, s, bytes(t)) for k, s, t in rows(got, "key", "seq", "tail")} == want


def test_tail_when_the_stream_ends(spark, tmp_path, data, rows):
    src = Source(spark, tmp_path, data, 4)
    src.put(0, 4)
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src.folder))
    got = S.run_to_end(timed(read), "at", lambda d: S.stream_tail(d, "key", "seq", "text", 40, "at", "1 hour"), "test")
    table = W.tail_bytes(spark.createDataFrame(data, SCHEMA), "key", "seq", "text", 40)
    want = {}
    for key, _, text in rows(table, "key", "seq", "text"):
        want[key] = want.get(key, "") + text
    assert {k: bytes(t).decode() for k, t in rows(got, "key", "tail")} == {
        k: "".join(r[7] for r in data if r[0] == k)[-40:] for k in want}


def test_streams_read_tables_of_one_file_and_of_a_folder(spark, tmp_path, rows):
    """A table may be a folder of part files; every part is read, and no other table."""
    table = spark.createDataFrame([(k, t, "user", f"{k}.T" * t) for k in range(20) for t in range(4)], stream_queries._TURNS)
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    table.repartition(1).write.parquet(str(tmp_path / "folder" / "other.parquet"))
    table.repartition(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    want = [(k, 6) for k in range(20)]
    for place in ("folder", "one"):
        got = stream_queries.stream_pattern(spark, str(tmp_path / place))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_keys_of_a_bucket_end_one_by_one(spark, tmp_path, rows, monkeypatch):
    """Keys share calls and timers, but each has its own state and its own end."""
    monkeypatch.setattr(S, "BUCKETS", 1)
    parts = [[("k", 0, 10), ("o", 1, 10), (None, 2, 10)], [("o", 3, 60), ("p", 4, 300)], [("p", 5, 301)], [("k", 6, 600), ("p", 7, 601)], [("p", 8, 1000)], [("p", 9, 1001)]]
    src = Source(spark, tmp_path, [], 1)
    for i, p in enumerate(parts):
        chunk = [(k, s, t * 1_000_000, "", 0.0, "", "", f"{s};", 0) for k, s, t in p]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.parquet(str(src.folder / f"{i:03d}"))
    got = src.run(lambda d: S.stream_tail(timed(d), "key", "seq", "text", 100, "at", "60 seconds", "10 seconds"))
    ended = sorted((r["key"] or "", r["seq"], bytes(r["tail"]).decode()) for r in got.collect())
    assert ended == [("", 2, "2;"), ("k", 0, "0;"), ("k", 6, "6;"), ("o", 3, "1;3;")]


def test_a_call_handles_many_keys():
    """Spark's cost of a call is paid by buckets, not by keys."""

    class State:
        exists = hasTimedOut = False

        def update(self, known):
            self.known = known

    op, state = S._Tail(100, None), State()
    op.columns, op.texts = ["x_key", "seq", "tail"], ["x_key"]
    pdf = pd.DataFrame({"x_key": [str(i % 200) for i in range(600)], "x_s": range(600), "x_b": [b"%d;" % i for i in range(600)]})
    (out,) = op([pdf.sample(frac=1.0, random_state=1)], state)
    assert dict(zip(out["x_key"], out["tail"], strict=True)) == {str(k): b"%d;%d;%d;" % (k, k + 200, k + 400) for k in range(200)}
    assert len(state.known[0]) == 200
