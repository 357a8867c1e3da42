"""Ordered per-key operators: literal cases, and results that do not depend on
segment size, partitioning or NULL keys."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clipledger.functions.segments import with_rank
from clipledger.functions.skew import salted_join
from clipledger.operators import aggregates as A
from clipledger.operators import windows as W
from clipledger.operators.ordering import empty_created, merge_taken
from clipledger.operators.throttle import throttle
from clipledger.plans import window_queries
from clipledger.plans.window_queries import slot_tables
from clipledger.sources.lines import parse_kv_lines

KEYS = ["hot", "b", None]


@pytest.fixture(scope="module")
def log(spark):
    """Frames of three keys, one of them hot and one NULL; times repeat and run backwards."""
    rnd = random.Random(7)
    data = []
    for seq in range(300):
        key = "hot" if rnd.random() < 0.7 else rnd.choice(KEYS)
        pts = None if rnd.random() < 0.1 else float(rnd.choice([seq, seq, seq - 2, 5]))
        text = rnd.choice(["", "a", "aa", "ba", "éa\n", None])
        field = rnd.choice(["frame", "fps", "out_time_us", "progress"])
        data.append((key, seq, pts, text, field, str(seq) if field != "progress" else rnd.choice(["end", "continue"])))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "key string, seq long, pts double, text string, f string, v string").cache()


def by_key(log, *cols):
    out = {}
    for r in sorted(log.collect(), key=lambda r: r["seq"]):
        out.setdefault(r["key"], []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 22])
def test_rank(log, rows, size):
    want = [(k, s, i + 1) for k, v in by_key(log, "seq").items() for i, (s,) in enumerate(v)]
    assert set(rows(with_rank(log.select("key", "seq"), "key", "seq", rows=size))) == set(want)


def brute_stats(times):
    seen = [t for t in times if t is not None]
    deltas = [b - a for a, b in zip(seen, seen[1:])]
    changes = sum(a != b for a, b in zip(deltas, deltas[1:]))
    return (len(times), bool(seen), changes, min(deltas, default=None), max(deltas, default=None),
            max(seen) - min(seen) if seen else None)


@pytest.mark.parametrize("size", [1, 5, 40, 1 << 22])
def test_timeline_stats(log, rows, size):
    want = {k: brute_stats([p for (p,) in v]) for k, v in by_key(log, "pts").items()}
    got = {r[0]: tuple(r[1:]) for r in rows(A.timeline_stats(log, "key", "seq", "pts", size))}
    assert got == want


@pytest.mark.parametrize("size", [1, 6, 1 << 22])
@pytest.mark.parametrize("pattern", [b"a", b"aa", b"aba", "éa\n".encode(), b"aaaaa"])
def test_pattern_count_equals_one_chunk(log, rows, size, pattern):
    want = {}
    for k, v in by_key(log, "text").items():
        whole = b"".join((t or "").encode() for (t,) in v)
        want[k] = sum(whole[i:].startswith(pattern) for i in range(len(whole)))
    binary = log.withColumn("c", F.col("text").cast("binary"))
    assert dict(rows(A.chunked_pattern_count(binary, "key", "seq", "c", pattern, size))) == want


def test_start_codes(frame, rows):
    data = [("a", 1, b"\x12\x00\x00"), ("a", 2, b"\x01\xb6\xaa\x00\x00\x01\xb6\xbb\x00"), ("a", 3, b"\x00\x01\xb6\xcc"),
            ("half", 1, b"\x10\x00\x00\x1b\x60"), ("empty", 1, b"")]
    d = frame([(k, s, bytearray(c)) for k, s, c in data], "key string, seq long, chunk binary")
    got = dict(rows(A.chunked_pattern_count(d, "key", "seq", "chunk", b"\x00\x00\x01\xb6")))
    assert got == {"a": 3, "half": 0, "empty": 0}


@pytest.mark.parametrize("size", [1, 9, 1 << 22])
@pytest.mark.parametrize("limit", [1, 10, 33, 100000])
def test_tail_bytes(log, size, limit):
    got = {}
    d = W.tail_bytes(log, "key", "seq", "text", limit, size)
    for r in sorted(d.collect(), key=lambda r: r["seq"]):
        got[r["key"]] = got.get(r["key"], b"") + bytes(r["tail"])
    want = {k: b"".join((t or "").encode() for (t,) in v)[-limit:] for k, v in by_key(log, "text").items()}
    assert got == want


def test_tail_of_long_line(frame):
    d = frame([("k", 1, "H" * 32768), ("k", 2, "the actual failure line")], "key string, seq long, t string")
    parts = sorted(W.tail_bytes(d, "key", "seq", "t").collect(), key=lambda r: r["seq"])
    tail = b"".join(bytes(r["tail"]) for r in parts)
    assert len(tail) == 32768 and tail.startswith(b"HH") and tail.endswith(b"the actual failure line")


def brute_snapshots(lines):
    state, out = {}, []
    for i, (seq, f, v) in enumerate(lines):
        state[f] = v
        ended = f == "progress" and v == "end"
        if f == "out_time_us" or ended or i == len(lines) - 1:
            out.append((seq, state.get("frame"), state.get("fps"), ended))
    return out


@pytest.mark.parametrize("size", [1, 11, 1 << 22])
def test_fill_snapshots(log, rows, size):
    d = log.withColumn("cut", F.lit(True))
    got = W.fill_snapshots(d, "key", "seq", "f", "v", ["frame", "fps"], ["out_time_us"], unterminated="cut",
                           segment_rows=size)
    want = {(k, *s) for k, v in by_key(log, "seq", "f", "v").items() for s in brute_snapshots(v)}
    assert set(rows(got)) == want


def test_lines_to_snapshots(frame, rows):
    text = ["frame=7\r", "out_time_us=1000000", "no separator", "progress=continue", "a=b=c", "frame=42"]
    d = frame([("job", i, t, i == 5) for i, t in enumerate(text)], "key string, seq long, line string, cut boolean")
    kv = parse_kv_lines(d, "line")
    assert rows(kv, "field", "value") == sorted(
        [("frame", "7"), ("out_time_us", "1000000"), ("progress", "continue"), ("a", "b=c"), ("frame", "42")])
    snaps = W.fill_snapshots(kv, "key", "seq", "field", "value", ["frame", "out_time_us"], ["out_time_us"],
                             unterminated="cut")
    assert rows(snaps) == [("job", 1, "7", "1000000", False), ("job", 5, "42", "1000000", False)]


def brute_throttle(seq):
    out, last = [], None
    for s, t, stage, p in seq:
        if last is None or stage != last[1] or p >= 0.9999 or p - last[2] >= 0.05 or t - last[0] >= 1_000_000:
            out.append(s)
            last = (t, stage, p)
    return out


@pytest.mark.parametrize("bits", [0, 2, 5, 18])
@pytest.mark.parametrize("seed", [1, 2])
def test_throttle_equals_fold(spark, rows, bits, seed):
    rnd = random.Random(seed)
    data, t = [], 0
    for seq in range(1500):
        t += rnd.choice([0, 1, 40_000, 90_000, 200_000, 1_000_000 if rnd.random() < 0.05 else 10_000])
        key = "hot" if rnd.random() < 0.8 else rnd.choice(KEYS)
        data.append((key, seq, t, "s" + str(t // 15_000_000), rnd.choice([(t // 100_000 % 97) / 97, 0.3, 0.31, 1.0])
                     if rnd.random() < 0.3 else (t // 500_000 % 40) / 41))
    rnd.shuffle(data)
    d = spark.createDataFrame(data, "key string, seq long, t long, stage string, p double")
    want = set()
    for k in KEYS:
        ordered = sorted([(r[2], r[1], r[3], r[4]) for r in data if r[0] == k])
        want |= {(k, s) for s in brute_throttle([(s, t, g, p) for t, s, g, p in ordered])}
    got = rows(throttle(d, "key", "t", "seq", "stage", "p", bits).select("key", "seq"))
    assert len(got) == len(set(got))
    assert set(got) == want


def test_throttle_of_a_dense_key_composes_maps(spark, rows):
    """One key without a sure row for 40 chunks, with many rows a second; a chunk never holds more than its rows."""
    rnd = random.Random(3)
    data = [("hot", s, s * 7_000, "one", (s % 200) * 0.004) for s in range(640)] + [("b", s, s * 10, "x", 0.0) for s in range(9)]
    want = {("hot", s) for s in brute_throttle([(s, t, g, p) for _, s, t, g, p in data[:640]])}
    want |= {("b", s) for s in brute_throttle([(s, t, g, p) for _, s, t, g, p in data[640:]])}
    rnd.shuffle(data)
    d = spark.createDataFrame(data, "key string, seq long, t long, stage string, p double")
    assert set(rows(throttle(d, "key", "t", "seq", "stage", "p", 4).select("key", "seq"))) == want
    assert {("hot", s) for s in (0, 13)} <= want and len(want) < 100


B7 = [
    (90, True, 0, 33.0, 33.0, 2.966, 3.0, False), (160, True, 5, 256.0, 512.0, 3.98, 4.0, False),
    (6, True, 3, 0.0, 512.0, 0.5, 1.0, True), (60, False, 0, None, None, None, 2.0, True),
    (60, True, 0, 0.0, 0.0, 0.033, 2.0, True), (60, True, 0, 33.0, 33.0, 1.97, 2.0, False),
    (500, True, 0, 20.0, 20.0, 10.0, 20.0, False), (60, True, 0, 8.0, 8.0, 0.5, 2.0, False),
    (60, True, 0, 3.0, 3.0, 0.2, 2.0, True), (60, True, 4, 1.0, 2.0, 0.2, 2.0, True),
    (60, True, 4, 16.0, 33.0, 1.97, 2.0, False), (1, True, 0, None, None, 0.0, 2.0, False),
    (60, True, 0, 0.0, 0.0, 0.0, None, False),
]


def test_broken_verdicts(frame):
    d = frame([(i, *c) for i, c in enumerate(B7)],
              "i int, n long, reported boolean, changed_deltas long, min_delta double, max_delta double, span double, "
              "ref double, want boolean")
    assert A.broken_timeline(d, F.col("ref")).where("broken <> want or broken is null").count() == 0


def test_broken_frames(frame):
    paths = {
        "uniform": [i / 30 for i in range(60)], "dropped": [i / 30 for i in range(60) if i % 3],
        "equal": [1.0] * 60, "swapped": [0, 1, 3, 2, 4], "single": [1.0], "none": [None] * 5,
    }
    data = [(p, i, None if t is None else float(t)) for p, v in paths.items() for i, t in enumerate(v)]
    d = frame(data, "path string, seq long, pts double")
    got = {r["path"]: r["broken"] for r in
           A.broken_timeline(A.timeline_stats(d, "path", "seq", "pts"), F.lit(2.0)).collect()}
    assert got == {"uniform": False, "dropped": False, "equal": True, "swapped": True, "single": False, "none": True}


@pytest.mark.parametrize("size", [1, 3, 1 << 22])
def test_retime_keeps_counts(log, size):
    d = log.withColumns({"num": F.lit(30000), "den": F.lit(1001)})
    got = W.retime(d, "key", "seq", "num", "den", segment_rows=size).select("key", "seq", "frame", "t").collect()
    assert len(got) == 300
    want = {(k, s): i for k, v in by_key(log, "seq").items() for i, (s,) in enumerate(v)}
    assert {(r["key"], r["seq"]): r["frame"] for r in got} == want
    assert all(r["t"] == pytest.approx(r["frame"] * 1001 / 30000) for r in got)


def brute_slots(taken, n, top):
    free = [s for s in range(1, top + 1) if s not in taken]
    return [free[i] if i < len(free) else None for i in range(n)]


@pytest.mark.parametrize("size", [1, 4, 1 << 22])
def test_slots(spark, size):
    taken = {"sparse": [2, 4], "full": [1, 2], "far": [1, 2, 99, 5000], "none": [], None: [1, 3, 0, -4], "odd": [7]}
    want_n = {"sparse": 4, "full": 1, "far": 3, "none": 2, None: 3, "odd": 12}
    t = spark.createDataFrame([(k, s) for k, v in taken.items() for s in v], "key string, slot int")
    req = [(k, 10 * i + j) for j, (k, n) in enumerate(want_n.items()) for i in range(n)]
    r = spark.createDataFrame(req, "key string, id long")
    got = {}
    for x in W.allocate_slots(r, t, "key", "id", max_slot=10, segment_rows=size).orderBy("id").collect():
        got.setdefault(x["key"], []).append(x["slot"])
        assert (x["slot"] is None) == (x["slot_error"] is not None)
    assert got == {k: brute_slots(set(v), want_n[k], 10) for k, v in taken.items()}


def test_limit_of_20_slots(frame, rows):
    requests = frame([("k", i) for i in range(1, 24)], "key string, id long")
    taken = frame([("k", 2), ("k", 20), ("k", 21)], "key string, slot int")
    free = [s for s in range(1, 27) if s not in (2, 20, 21)]
    want = [("k", i, s, None) if s <= 20 else ("k", i, None, "no unused slot") for i, s in enumerate(free, 1)]
    assert set(rows(W.allocate_slots(requests, taken, "key", "id", max_slot=20))) == set(want)
    assert set(rows(W.allocate_slots(requests, taken, "key", "id"))) == {("k", i, s, None) for i, s in enumerate(free, 1)}


def test_query_serves_every_request(spark):
    sf_dir = "/root/testdata/sf0.01"
    requests = slot_tables(spark, sf_dir)[0].count()
    served = window_queries.REG.queries["allocate_all_slots"](spark, sf_dir).where("slot is not null and slot_error is null")
    assert served.select("user_id", "slot").distinct().count() == served.count() == requests > 0


def test_slot_names(frame):
    names = ["clip_p.avi", "clip_p_2.avi", "CLIP_P_7.AVI", "clip_p_1.avi", "clip_p_x.avi", "clip_p_2.mov",
             "clip_p_1000000.avi", "other.avi"]
    d = frame([(n,) for n in names], "n string").select("n", W.slot_of_name(F.col("n"), F.lit("clip_p"), "avi").alias("s"))
    assert [r["s"] for r in d.collect()] == [1, 2, 7, None, None, None, None, None]
    back = d.where("s is not null").select(W.slot_name(F.lit("clip_p"), F.col("s"), "avi").alias("n"))
    assert [r["n"] for r in back.collect()] == ["clip_p.avi", "clip_p_2.avi", "clip_p_7.avi"]


def test_raced_slots(frame, rows):
    taken = merge_taken(frame([("k", 2), ("k", 3)], "key string, slot int"),
                        frame([("k", 1), ("k", 3)], "key string, slot int"), "key")
    assert rows(taken) == [("k", 1, False), ("k", 2, True), ("k", 3, False)]
    got = W.allocate_slots(frame([("k", 1)], "key string, id long"), taken, "key", "id")
    assert rows(got, "slot") == [(4,)]


def test_empty_created(frame, rows):
    assert rows(empty_created(frame([("a",), ("b",), (None,)], "d string"),
                              frame([("a",), ("a",), (None,)], "d string"), "d")) == [(None,), ("b",)]


@pytest.mark.parametrize("per_task", [3, 1 << 22])
def test_salted_join_keeps_rows(log, per_task):
    per_key = log.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    got = salted_join(log, per_key, "key", F.col("seq"), how="left", rows_per_task=per_task)
    assert got.count() == 300
    assert got.where("key is not null and n is null").count() == 0
    assert got.where("key is null and n is not null").count() == 0


def test_progress(frame):
    d = frame([(10.0, 4, 100, None), (1.0, 50, 100, None), (10.0, 50, 100, None), (5.0, 25, 100, 0.0),
               (5.0, 25, 100, 9.0), (5.0, 200, 100, None), (5.0, 0, 100, None)],
              "elapsed double, done long, total long, rep double")
    got = [(r["fraction"], r["eta"], r["rate"]) for r in W.progress_columns(d, "done", "total", "rep").collect()]
    assert [g[1] for g in got] == [None, None, 10.0, 15.0, 15.0, None, None]
    assert [g[0] for g in got] == [0.04, 0.5, 0.5, 0.25, 0.25, 1.0, None]
    assert got[3][2] == 5.0 and got[4][2] == 9.0


@pytest.mark.parametrize("per_task", [5, 1 << 22])
def test_progress_starts(log, per_task):
    d = log.withColumns({"ts": F.col("seq") * 1_000_000, "total": F.lit(400)})
    got = W.progress_metrics(d, "key", "ts", "seq", "total", "seq", rows_per_task=per_task).collect()
    first = {k: v[0][0] for k, v in by_key(log, "seq").items()}
    assert len(got) == 300
    assert all(r["elapsed"] == r["seq"] - first[r["key"]] for r in got)


def test_attempts(frame, rows):
    data = [("a", 1, "native", False, "bad"), ("a", 2, "cpu", True, "fine"), ("a", 3, "cpu", False, "again"),
            ("b", 1, "gpu", False, "x"), ("b", 2, "gpu", True, "retry of equal backend"), ("c", 1, "cpu", None, "?")]
    d = frame(data, "item string, no int, backend string, ok boolean, msg string")
    got = rows(W.first_verified_attempt(d, "item", "no", F.col("ok"), ["backend", "msg"]))
    assert got == [("a", 3, True, 2, "cpu", "fine"), ("b", 2, True, 2, "gpu", "retry of equal backend"),
                   ("c", 1, False, 1, "cpu", "?")]
    once = rows(W.first_verified_attempt(d, "item", "no", F.col("ok"), ["msg"], backend="backend"))
    assert once == [("a", 2, True, 2, "fine"), ("b", 1, False, 1, "x"), ("c", 1, False, 1, "?")]


def test_heads_tails_and_first(log, rows):
    per = by_key(log, "seq")
    assert set(rows(W.tail_rows(log, "key", "seq", 3), "key", "seq")) == {(k, s) for k, v in per.items() for (s,) in v[-3:]}
    head = W.head_rows(log, "key", "seq", 2, marker="more")
    assert set(rows(head, "key", "seq", "more")) == {
        (k, s, i == 2) for k, v in per.items() for i, (s,) in enumerate(v[:3])}
    assert set(rows(W.dedupe_keep_first(log, "key", "seq"), "key", "seq")) == {(k, v[0][0]) for k, v in per.items()}
    plan = W.tail_rows(log, "key", "seq", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_results_do_not_depend_on_partitioning(spark, log, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows(A.timeline_stats(log, "key", "seq", "pts", 16))
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert rows(A.timeline_stats(log.repartition(n), "key", "seq", "pts", 16)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chunk_signature_equals_that_of_the_whole(spark, rows):
    """Chunks of several keys, one hot and one NULL, over many partitions; a NULL chunk is empty."""
    rnd = random.Random(11)
    data = [("hot" if rnd.random() < 0.8 else rnd.choice(KEYS), i, rnd.choice([None, b"", bytes(rnd.randbytes(rnd.randint(1, 90)))]))
            for i in range(900)] + [("none", 0, None)]
    d = spark.createDataFrame(rnd.sample(data, len(data)), "key string, seq long, chunk binary").repartition(7)
    want = {}
    for k, _, c in data:
        want[k] = want.get(k, b"") + (c or b"")
    got = rows(A.chunk_signature(d, "key", "seq", "chunk"), "key", "signature")
    signed = {k: hashlib.sha256(len(v).to_bytes(8, "little") + v).hexdigest() for k, v in want.items()}
    assert dict(got) == signed and len(got) == len(signed)
    assert A.chunk_signature(d.limit(0), "key", "seq", "chunk").count() == 0
