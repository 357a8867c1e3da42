"""Documents, listings, reports and publishing."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from clipledger.operators.ordering import ordered_inputs
from clipledger.operators.project import classify
from clipledger.sources import files, lines, probe, publish, report


def doc(video=None, audio=(), duration=None, **fmt):
    streams = [] if video is None else [{"codec_type": "video", **video}]
    streams += [{"codec_type": "audio", "codec_name": a} for a in audio]
    return json.dumps({"streams": streams, "format": {"duration": duration, **fmt}, "other": 1})


H264 = dict(codec_name="h264", width=320, height=180, pix_fmt="yuv420p", avg_frame_rate="30/1", r_frame_rate="30/1")
DOCS = {
    "plain": doc({**H264, "nb_frames": "30"}, ["aac", "mp3"], "1.0", size="1000", tags={"comment": "hi"}),
    "bad": "not json", "nan": doc({**H264, "duration": "nan"}, duration="nan"),
    "huge": doc({**H264, "duration": "1e300"}, duration="2.5"),
    "cover": doc({**H264, "disposition": {"attached_pic": 1}}), "none": doc(None, ["aac"]), "number": "12", "missing": None,
    "trusted": doc({**H264, "codec_name": "ffv1", "nb_frames": "300"}, duration="10.0"),
    "refuted": doc({**H264, "codec_name": "ffv1", "nb_frames": "300"}, duration="20.0"),
    "unmapped": doc({**H264, "pix_fmt": "yuv420p10le", "bits_per_raw_sample": "x", "avg_frame_rate": "0/0"}, duration="1"),
}


def test_flatten(frame):
    m = {r["path"]: r for r in probe.flatten_probe(frame(list(DOCS.items()), "path string, doc string"), "doc").collect()}
    assert set(m) == {"plain", "nan", "huge", "trusted", "refuted", "unmapped"}
    p = m["plain"]
    assert (p["codec"], p["frame_count"], p["frame_count_exact"], p["audio"]) == ("h264", 30, False, ["aac", "mp3"])
    assert (p["size_bytes"], p["provenance"], p["fps_text"], p["bit_depth"], p["chroma"]) == (1000, "hi", "30/1", 8, "4:2:0")
    assert m["nan"]["duration"] is None and m["nan"]["frame_count"] is None
    assert m["huge"]["duration"] == 2.5 and m["huge"]["frame_count"] == 75
    assert m["trusted"]["frame_count_exact"] and m["trusted"]["fps"] == 30.0
    assert m["refuted"]["fps"] is None and m["refuted"]["duration"] is None and m["refuted"]["frame_count"] == 300
    assert (m["unmapped"]["bit_depth"], m["unmapped"]["fps"]) == (10, 30.0)


def test_rejects(frame):
    d = frame(list(DOCS.items()), "path string, doc string")
    has_video = probe.video_stream(F.col("doc_parsed")).isNotNull()
    good, bad = probe.split_rejects(d, "doc", required=has_video)
    reasons = {r["path"]: r["reject_reason"] for r in bad.collect()}
    assert reasons == {"bad": "unparsable", "number": "unparsable", "missing": "unreadable", "cover": "no video stream",
                       "none": "no video stream"}
    assert good.count() + len(reasons) == len(DOCS)
    _, bad = probe.split_rejects(d, "doc", max_bytes=20)
    assert bad.where("reject_reason = 'too large'").count() == 8


def touch(path, data=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_scan(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for n in ["z.avi", "b.MOV", "c.txt", "clip_prores_lt.mov", "x.video.tmp.m4v", "clip_xvid_compact_2.avi"]:
        touch(a / n, b"12")
    touch(a / "deep" / "nested.avi")
    touch(b / "q.mkv", b"1")
    got = ordered_inputs(files.scan_files(spark, [str(b), str(a), str(b)])).collect()
    assert [(r["root_idx"], r["name"], r["ext"], r["size_bytes"]) for r in got] == [
        (0, "q.mkv", "mkv", 1), (1, "b.MOV", "mov", 2), (1, "z.avi", "avi", 2)]
    assert all(os.path.isabs(r["path"]) for r in got)
    outs = files.scan_outputs(spark, str(a)).collect()
    assert sorted((r["stem"], r["preset"], r["slot"]) for r in outs) == [("clip", "prores_lt", 1), ("clip", "xvid_compact", 2)]
    sigs = files.file_signatures(spark, str(a)).collect()
    assert len({r["signature"] for r in sigs}) == 1 and sigs[0]["signature"] is not None
    (tmp_path / "big").mkdir()
    for name, data in {"x": b"q" * (3 << 20), "y": b"q" * (2 << 20) + b"r" + b"q" * ((1 << 20) - 1), "z": b"z"}.items():
        (tmp_path / "big" / name).write_bytes(data)
    whole = {r["path"]: r["signature"] for r in files.file_signatures(spark, str(tmp_path / "big")).collect()}
    streamed = {r["path"]: r["signature"] for r in files.file_signatures(spark, str(tmp_path / "big"), 1 << 20).collect()}
    assert whole == streamed and len(set(whole.values())) == 3


def test_publish(spark, frame, tmp_path):
    target = str(tmp_path / "out")
    df = frame([(1, 2), (3, 4)], "a int, b int")

    def check(limit):
        return lambda back: back.withColumn(
            "problems", F.when(F.col("b") > limit, F.array(F.lit("too large"))).otherwise(F.array().cast("array<string>")))

    first = publish.publish_verified(df, target, check(10)).first()
    assert (first["row_count"], first["problem_rows"], first["published"]) == (2, 0, True)
    second = publish.publish_verified(df.limit(1), target, check(1)).first()
    assert (second["problem_rows"], second["published"]) == (1, False)
    assert publish.read_published(spark, target).count() == 2
    with pytest.raises(Exception, match="no_such_column"):
        publish.publish_verified(df, target, lambda back: back.select("no_such_column"))
    assert os.listdir(tmp_path / "out" / "versions") == [first["version"]]


def test_report(frame):
    d = frame([(2, "/x/a\x1b[31m.avi", "mpeg4", "XVID", 30.0, 30, True), (1, "/x/" + "n" * 40 + ".avi", "h264", None, None, 7, False),
               (3, "b.avi", "h264", None, 0.0, None, False)],
              "idx int, path string, codec string, codec_tag string, fps double, frame_count long, frame_count_exact boolean"
              ).withColumns({"width": F.lit(320), "height": F.lit(180), "size_bytes": F.lit(1)})
    got = report.media_report(classify(d, "codec", "codec_tag")).collect()
    assert [r["count_label"] for r in got] == ["~7", "30", "?"]
    assert [r["file"] for r in got] == ["n" * 22 + "...", "a.avi", "b.avi"]
    assert [r["codec_label"] for r in got] == ["H264", "XVID", "H264"]
    assert [r["fps_label"] for r in got] == ["?", "30.000", "?"]


def test_only_one_object_is_a_document(frame):
    good = '{"streams": [], "format": {}}'
    texts = [good, f"  {good}\n", good.replace('"', "'"), good + " rest", good + good, f"{good}],[{good}", good + '},{"d":' + good,
             '{"format": {"duration": NaN}}', "[]", "1", "", None]
    d = frame(list(enumerate(texts)), "path int, doc string")
    got = {r["path"]: r["reject_reason"] for r in probe.parse_json(d, "doc").collect()}
    assert [got[i] for i in range(len(texts))] == [None, None, *["unparsable"] * 9, "unreadable"]


def test_objects_are_told_without_the_parser(frame, monkeypatch):
    """Malformed texts cost the parser exceptions, so only deep brackets and other values may reach it."""
    good = '{"streams": [], "format": {"size": "}\\"{"}}'
    texts = {good: True, f" {good}\n": True, '{"a":' + "[" * 5 + "1" + "]" * 5 + "}": True, '{"a":"' + 400_000 * 'x\\n' + '"}': True,
             good.replace('"', "'"): False, good + " rest": False, good + " 1": False, good + good: False, f"{good}],[{good}": False,
             good + '},{"d":' + good: False, '{"a": NaN}': False, "Prose, of a kind.": False, '{"a": "\t"}': False, "": False}
    monkeypatch.setattr(probe, "_parsed_alone", lambda doc: F.raise_error(F.lit("parsed")).cast("boolean"))
    d = frame([(t,) for t in texts], "doc string")
    assert {r["doc"]: r["alone"] for r in d.select("doc", probe._alone(F.col("doc")).alias("alone")).collect()} == texts


def test_patterns_agree_with_the_parser(frame, monkeypatch):
    rnd, tokens = random.Random(7), ["{", "}", "[", "]", ",", ":", '"a"', '"}"', '"\\""', "1", "-0.5e3", "01", "true", "null", " ", "\n", "é", '{"a":1}', '"k":[]', '{"a":{"b":[[[[[[[1]]]]]]]}}']
    texts = ["".join(rnd.choices(tokens, k=rnd.randint(1, 7))) for _ in range(4000)]
    texts += ["{" + ",".join(rnd.choices(['"k":1', '"m":[{"a":[]}]', '"n":{"a":"["}', '"o":[[[[[[[[1]]]]]]]]'], k=rnd.randint(0, 3))) + "}" + rnd.choice(["", "", " ", ",", "}", "1", "[]"]) for _ in range(1000)]
    d = frame(list(enumerate(texts)), "path int, doc string")
    got = {r["path"]: r["reject_reason"] for r in probe.parse_json(d, "doc").collect()}
    monkeypatch.setattr(probe, "_alone", probe._parsed_alone)
    want = {r["path"]: r["reject_reason"] for r in probe.parse_json(d, "doc").collect()}
    assert got == want
    assert 500 < sum(r is None for r in want.values()) < 4000


def test_report_is_written_once_and_in_order(spark, frame, tmp_path):
    media = frame([(2, 5, True), (1, 7, False), (3, None, True)], "idx int, frames long, exact boolean")
    rows = report.source_report(media, "idx", {"twice": F.col("frames") * 2}, "frames", "exact")
    place = str(tmp_path / "report")
    report.write_source_report(rows.coalesce(1), place, "json")
    got = [(r["idx"], r["count_label"], r["twice"]) for r in spark.read.json(place).orderBy("idx").collect()]
    assert got == [(1, "~7", 14), (2, "5", 10), (3, "?", None)]
    with pytest.raises(Exception, match="(?i)exists"):
        report.write_source_report(rows, place, "json")


def test_key_value_lines_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("frame=1\r\nnoise\nout=x=y\n")
    (tmp_path / "b.log").write_text("fps=2")
    got = {(r["key"].rsplit("/", 1)[1], r["field"], r["field_value"]) for r in lines.read_kv_lines(spark, str(tmp_path)).collect()}
    assert got == {("a.log", "frame", "1"), ("a.log", "out", "x=y"), ("b.log", "fps", "2")}
