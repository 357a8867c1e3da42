"""Reconciliation, reuse, provenance and summaries on literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clipledger.plans import catalog
from clipledger.functions.digest import content_signature, provenance_tag
from clipledger.operators import aggregates as A
from clipledger.operators import joins as J
from clipledger.operators.project import Job
from clipledger.schemas import MEDIA

BASE_IN = dict(path="k", width=320, height=180, pixel_format="yuv420p", frame_count=30, fps=30.0, duration=1.0,
               audio=["aac"], has_alpha=False, bit_depth=8, chroma="4:2:0")
BASE_OUT = {**BASE_IN, "codec": "mpeg4", "codec_tag": "XVID"}


def media(spark, *rows):
    names = MEDIA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MEDIA)


def verify(spark, cases, preset="xvid_compact", expected=30.0, span=1.0, **job):
    """Problems per case; a case is (input changes, output changes)."""
    ins = media(spark, *[{**BASE_IN, **i, "path": str(n)} for n, (i, _) in enumerate(cases)])
    outs = media(spark, *[{**BASE_OUT, **o, "path": str(n)} for n, (_, o) in enumerate(cases)])
    ins = ins.withColumns({"target_rate": F.lit(expected).cast("double"), "expected_span": F.lit(span).cast("double")})
    got = J.verify_outputs(ins, outs, "path", Job(preset, **job))
    return [r["problems"] for r in got.orderBy(F.col("path").cast("int")).collect()]


def test_verify_mutations(spark):
    cases = [
        ({}, {}), ({"frame_count": 90}, {"frame_count": 88}), ({}, {"fps": None, "duration": None}),
        ({}, {"width": 640}), ({}, {"fps": 24.0}), ({}, {"duration": 5.0}), ({}, {"audio": ["mp3"]}),
        ({}, {"audio": ["aac", "ac3"]}), ({"audio": None}, {"audio": ["aac"]}), ({}, {"pixel_format": "yuv444p"}),
        ({}, {"codec_tag": "FMP4"}), ({"frame_count": None}, {}), ({}, {"audio": ["AAC"]}),
    ]
    got = verify(spark, cases)
    starts = [[], ["frame count mismatch"], ["rate missing", "span missing"], ["dimension mismatch"], ["rate mismatch"],
              ["span mismatch"], ["track 1"], ["expected 1 tracks"], ["expected no tracks"], ["pixel format"],
              ["codec/profile"], [], []]
    assert [[p.startswith(s) for p, s in zip(g, w)] for g, w in zip(got, starts)] == [[True] * len(w) for w in starts]
    assert [len(g) for g in got] == [len(w) for w in starts]


def test_verify_audio_options_and_alpha(spark):
    assert verify(spark, [({}, {"audio": []})], strip_audio=True) == [[]]
    assert verify(spark, [({}, {"audio": []})], conform=True) == [[]]
    out = dict(codec="prores", codec_tag=None, profile="4444", pixel_format="yuva444p10le", has_alpha=True)
    got = verify(spark, [({"has_alpha": True}, out), ({}, out), ({}, {**out, "pixel_format": "yuv444p12le"}),
                         ({"has_alpha": True}, {**out, "pixel_format": "yuv444p10le", "has_alpha": False})],
                 preset="prores_4444")
    assert [len(g) for g in got] == [0, 1, 0, 2]
    lossless = dict(codec="magicyuv", codec_tag=None)
    got = verify(spark, [({}, lossless), ({}, {**lossless, "pixel_format": "yuv422p"})], preset="magicyuv_lossless")
    assert got == [[], ["pixel format mismatch: expected yuv420p"]]


@pytest.mark.parametrize("preset,row,want", [
    ("xvid_compact", ("mpeg4", "XVID", None, "yuv420p"), True), ("xvid_compact", ("mpeg4", "FMP4", None, "yuv420p"), False),
    ("prores_lt", ("prores", None, "LT", "yuv422p10le"), True), ("prores_lt", ("prores", None, "4444", "yuv444p10le"), False),
    ("prores_4444", ("prores", None, "Standard", "yuv422p10le"), False),
    ("prores_4444", ("prores", None, "4444", "yuv444p12le"), True), ("magicyuv_lossless", ("magicyuv", None, None, None), True),
    ("other", ("magicyuv", None, None, None), False),
])
def test_codec_matches(frame, preset, row, want):
    d = frame([row], "c string, t string, p string, x string")
    assert d.select(J.codec_matches(preset, *[F.col(n) for n in "ctpx"]).alias("m")).first()["m"] is want


def test_reconcile_structure(frame, rows):
    e = frame([(1, 5), (2, 5), (2, 5), (3, 5), (None, 5)], "k int, n int")
    a = frame([(1, 6), (2, 5), (4, 5), (5, 1), (5, 1)], "k int, n int")
    got = J.reconcile(e, a, "k", lambda x, y: [J.count_rule(x("n"), y("n"))])
    assert rows(got, "k", F.array_join("problems", ";")) == [
        (None, "missing row"), (1, "count mismatch: 5 vs 6"), (2, "duplicate expected key"), (3, "missing row"),
        (4, "unexpected row"), (5, "unexpected row;duplicate actual key")]


def test_incompatible_audio(spark):
    m = media(spark, {"path": "/x/clip.mp4", "audio": ["aac", "aac", "mp3"]}, {"path": "/x/b.mov", "audio": []},
              {"path": "/x/c.mov", "audio": ["flac", "", "pcm_s16be"]})
    assert sorted(r["label"] for r in J.incompatible_audio(m, "xvid_compact").collect()) == [
        "c.mov=", "c.mov=PCM_S16BE", "clip.mp4=AAC"]
    assert sorted(r["label"] for r in J.incompatible_audio(m, "prores_lt").collect()) == ["c.mov=", "c.mov=FLAC"]


@pytest.mark.parametrize("per_task", [2, 1 << 22])
def test_match_reusable(frame, rows, per_task):
    src = frame([("a", "s1", 10), ("b", "s1", 10), ("c", None, 10), ("d", "s1", 10)], "stem string, sig string, mtime int")
    cand = frame(
        [("a", "s1", 3, 11, 0), ("a", "s1", 2, 12, 0), ("a", "s1", 1, 9, 0), ("a", "s2", 1, 20, 0), ("b", "s1", 1, 20, 1),
         ("c", None, 1, 20, 0)] + [("d", "s1", n, 20, 0 if n == 40 else 1) for n in range(2, 60)],
        "stem string, sig string, slot int, mtime int, bad int")
    got = J.match_reusable(src, cand, ["stem", "sig"], "slot", lambda s, c: c("mtime") >= s("mtime"),
                           lambda s, c: [(c("bad") == 1, "bad")], keep=["mtime"], rows_per_task=per_task)
    assert rows(got, "stem", "matched", "reused_slot", "reused_mtime") == [
        ("a", True, 2, 12), ("b", False, None, None), ("c", False, None, None), ("d", True, 40, 20)]


def test_missing_capability_and_delta(frame, rows):
    items = frame([("a", False), ("b", False), ("c", True), ("d", False)], "k string, skip boolean")
    got = J.missing_capability(items, "k", [frame([("a",), ("a",)], "k string"), frame([("d",)], "k string")], F.col("skip"))
    assert rows(got, "k") == [("b",)]
    d = J.size_delta(frame([(1, 1000), (2, 0), (3, 10)], "k int, i long"), frame([(1, 250), (2, 5), (3, -1)], "k int, o long"),
                     "k", "i", "o")
    assert rows(d, "k", "delta_pct") == [(1, -75.0), (2, None), (3, None)]


def test_signatures(frame):
    blob = bytes(range(256)) * 64
    changed = blob[:8000] + b"!" + blob[8001:]
    d = frame([(1, bytearray(blob)), (2, bytearray(blob)), (3, bytearray(changed)), (4, None), (5, None)], "i int, c binary")
    signed = A.content_fingerprint(d, "c", max_bytes=1 << 20).orderBy("i").collect()
    want = hashlib.sha256(len(blob).to_bytes(8, "little") + blob).hexdigest()
    assert [r["signature"] == want for r in signed[:3]] == [True, True, False]
    assert signed[3]["signature"] is None and signed[3]["signature_error"] == "content unreadable"
    groups = A.duplicate_groups(A.content_fingerprint(d, "c"), "signature", "i").collect()
    assert [(r["copies"], r["first_item"]) for r in groups] == [(2, 1)]
    assert A.content_fingerprint(d, "c", max_bytes=10).where("signature is not null").count() == 0


def test_job_signatures(frame):
    jobs = frame(
        [("p", "0.1", "", False, False), ("p", "1/10", "", False, False), ("p", "1/5", "", False, False),
         ("p", "1/10", "", True, False), ("p", "1/10", "", True, True), ("q", "1/10", "", True, True)],
        "preset string, timescale string, capture_fps string, conform boolean, strip_audio boolean",
    ).withColumns({"cpu_only": F.lit(False), "no_native": F.lit(False)})
    s = [r["job_sig"] for r in A.media_job_signature(jobs).collect()]
    assert s[0] == s[1] and s[3] == s[4] and len(set(s)) == 4
    text = b"p\x001/10\x00\x00" + bytes([0, 0, 0, 0])
    assert s[0] == hashlib.sha256(text).hexdigest()[:16]


def test_provenance(frame, rows):
    job = F.lit("00ff")
    src = frame([("a", "x1"), ("b", "x2"), ("c", None)], "k string, sig string")
    tag = provenance_tag("tag1", F.lit("x1"), job)
    outs = frame([("a", 1), ("a", 2), ("b", 1), ("a", 3), ("a", 4), ("c", 1)], "k string, n int").withColumn(
        "tag", F.when((F.col("k") == "a") & (F.col("n") == 2), F.upper(tag)).when(F.col("n") == 3, F.lit("holiday video"))
        .when(F.col("n") == 4, F.lit(None)).otherwise(F.concat(F.lit(" "), tag)))
    got = J.audit_provenance(outs, src, "k", "tag", "sig", job, "tag1")
    assert rows(got, "k", "n", "provenance_state") == [
        ("a", 1, "ok"), ("a", 2, "ok"), ("a", 3, "untagged"), ("a", 4, "untagged"), ("b", 1, "foreign"), ("c", 1, "untagged")]


def test_run_verdicts(frame):
    runs = {
        "ok": [("ok", "o")], "failed": [("failed", None)], "skips": [("skipped", None)] * 2, "resolved": [("skipped", "o")],
        "mixed": [("ok", "o"), ("skipped", None)], "cancelled": [("ok", "o"), ("cancelled", None)], "nothing": [("", None)],
        "unreadable": [("unreadable", None)],
    }
    d = frame([(k, s, o) for k, v in runs.items() for s, o in v], "run string, status string, output string").withColumn(
        "bad_input", F.col("status") == "unreadable")
    got = {r["run"]: r["exit_code"] for r in A.run_verdict(d, "run", unreadable="bad_input").collect()}
    assert got == {"ok": 0, "failed": 1, "skips": 2, "resolved": 0, "mixed": 0, "cancelled": 130, "nothing": 0, "unreadable": 1}


def test_summary(frame):
    d = frame([(1, "ok", "/a", 10), (2, "skipped", "/b", 5), (3, "failed", "/c", 1), (4, "cancelled", "/d", 1), (5, "", None, 1),
               (6, "skipped", None, 2)], "idx int, status string, dir string, size long")
    r = A.summarize(d, in_bytes="size", output_dir="dir").first()
    assert (r["items"], r["successes"], r["skipped"], r["failures"], r["in_total"], r["last_dir"]) == (4, 1, 2, 1, 18, "/b")


def test_profiles_and_collisions(frame, rows):
    d = frame([("c", "compressed", False, "4:2:0", 8), ("m", "lossless", False, "4:2:0", 8), ("m", "intermediate", True, "4:2:2", 10),
               ("x", "compressed", False, "4:2:0", 8), ("x", "lossless", False, "4:2:0", 8), ("o", "other", False, None, 8)],
              "b string, class string, has_alpha boolean, chroma string, bit_depth int")
    got = A.profile_media(d, "b")
    assert rows(got, "b", "profile", "tier", "all_plain") == [
        ("c", "compressed", "prores_lt", True), ("m", "masters", "prores_4444", False), ("o", "mixed", "prores_lt", False),
        ("x", "mixed", "prores_lt", True)]
    p = frame([("/a", "clip.avi"), ("/a", "clip.mov"), ("/b", "clip.avi"), ("/b", "Clip2.avi"), ("/b", "CLIP2.mkv")],
              "d string, n string")
    assert rows(A.colliding_keys(p, F.col("d"), F.col("n"))) == [("/a", "clip", 2), ("/b", "clip2", 2)]
    shared = A.colliding_keys(p, F.lit("/out"), F.col("n"))
    assert rows(shared) == [("/out", "clip", 3), ("/out", "clip2", 2)]


def test_frames_are_counted_before_they_are_joined(spark, frame, rows):
    """A row per source is shuffled, not a row per frame."""
    frames = frame([(p, i) for p, n in (("a", 3), ("b", 2), (None, 2)) for i in range(n)], "path string, frame int")
    counted = catalog._frame_counts(frames, frame([("a",), ("c",)], "path string"), "path")
    assert rows(counted, "path", "__count") == [("a", 3)]
    plan = counted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [next(i for i, line in enumerate(plan) if name in line) for name in ("Join LeftSemi", "Aggregate")]
    assert depth == sorted(depth)
