"""Row-level decisions on literal cases."""

import pytest
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions.rational import parse_rate, rate_text
from clipledger.operators import project as P
from clipledger.operators.aggregates import judge_claims


ACCEPTED = [
    ("30", 30, 1), ("30000/1001", 30000, 1001), ("0.1", 1, 10), ("23.976", 2997, 125), ("1e-3", 1, 1000),
    ("1E2", 100, 1), ("+5/10", 1, 2), ("030/1", 24, 1), (".5", 1, 2), ("5.", 5, 1), ("60/2", 30, 1),
    ("12345678901234567890/12345678901234567891", 12345678901234567890, 12345678901234567891),
    ("0" + "7" * 22 + "/3", (8**22 - 1) // 3, 1), ("1/0" + "1" + "0" * 41, 1, 8**41),
]
REJECTED = [
    "1e999999999", "1e-999999999", "1e1001", "1e+1001", "0x1p99", "9" * 65, "abc", "1e2e3", "1e-", "1e309", "1e-9999",
    "-5", "1d", "Infinity", "NaN", "1/0", "0", "0/5", "08/1", "1/2/3", "1.5/2", "5/+3", " 30", "30\n", ".", "1e2/3",
]
UNKNOWN = ["", "0/0", "N/A", None]


def parsed(frame, texts, **options):
    d = frame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r["r"] for r in d.select("i", parse_rate("x", **options).alias("r")).orderBy("i").collect()]


def test_rates_accepted(frame):
    for (text, num, den), r in zip(ACCEPTED, parsed(frame, [t for t, _, _ in ACCEPTED])):
        assert (text, r["status"], int(r["num"]), int(r["den"])) == (text, "ok", num, den)
        assert r["value"] == pytest.approx(num / den)


def test_rates_rejected(frame):
    assert [(t, r["status"]) for t, r in zip(REJECTED, parsed(frame, REJECTED))] == [(t, "invalid") for t in REJECTED]


def test_rates_unknown(frame):
    assert {r["status"] for r in parsed(frame, UNKNOWN)} == {"unknown"}
    assert {r["status"] for r in parsed(frame, UNKNOWN, lenient=False)} == {"invalid"}


def test_rate_precision_and_trim(frame):
    assert parsed(frame, ["1e60"])[0]["status"] == "unsupported_precision"
    long = ["1e-50", "0." + "1" * 40, "1/" + "9" * 45]
    for text, r in zip(long, parsed(frame, long)):
        assert (r["status"], r["num"], r["den"]) == ("unsupported_precision", None, None)
        assert r["value"] == pytest.approx(float(text) if "/" not in text else 1e-45, rel=1e-12)
    d = P.with_rate(frame([(" 60/2 ",), ("\t30/1\n",), ("\u200930\u3000",)], "x string"), "x", "r", trim=True)
    assert {r["t"] for r in d.select(rate_text(F.col("r")).alias("t")).collect()} == {"30/1"}
    d = P.normalize_alias(frame([("share\t",), ("\n SHARE",)], "x string"), "x")
    assert {r["canonical"] for r in d.collect()} == {"xvid_max_q2"}


def test_quotient(frame):
    d = frame([("30", "0.1"), ("30000/1001", "1/2"), ("N/A", "1")], "a string, b string")
    d = P.with_quotient(P.with_rate(P.with_rate(d, "a", "ra"), "b", "rb"), "ra", "rb", "q")
    assert [r["t"] for r in d.select(rate_text(F.col("q")).alias("t")).collect()] == ["300/1", "60000/1001", None]


CANDIDATES = [
    ("30/1", "25/1", None, None, "30/1"), ("0/0", "30/1", None, None, "30/1"),
    (None, "30000/1001", None, None, "30000/1001"), ("0/0", "0/0", None, None, None),
    ("junk", "30/1", None, None, "30/1"), ("0/0", "30/1", 300, 10.0, "30/1"),
    ("0/0", "30/1", 300, 10.05, "30/1"), ("0/0", "30/1", 300, 20.0, None),
    ("0/0", "30/1", 295, 10.0, None), ("0/0", "30/1", 106200, 3600.0, None),
    ("60/1", "30/1", 300, 10.0, "30/1"), ("60/1", "30/1", 300, 20.0, None),
    ("30/1", "60/1", 300, 10.0, "30/1"),
    ]


def test_corroborated_rate(frame):
    d = frame([(i, *c[:4]) for i, c in enumerate(CANDIDATES)], "i int, avg string, r string, n long, d double")
    got = P.select_rate_text(d, ["avg", "r"], "n", "d").orderBy("i").collect()
    assert [r["rate_text"] for r in got] == [c[4] for c in CANDIDATES]


@pytest.mark.parametrize(
    "fps,dur,n,rate,span,impeached",
    [
        (30.0, None, 90, 30.0, None, None),
        (30.0, 3.0, 90, 30.0, 3.0, None),
        (60.0, 3.0, 90, None, None, 60.0),
        (None, 3.0, 90, None, 3.0, None),
        (30.0, 3.0, None, 30.0, 3.0, None),
    ],
)
def test_claims_judged(frame, fps, dur, n, rate, span, impeached):
    d = frame([(fps, dur, n)], "fps double, dur double, n long")
    r = judge_claims(d, "fps", "dur", "n").first()
    assert (r["audited_rate"], r["audited_span"], r["impeached_rate"]) == (rate, span, impeached)


@pytest.mark.parametrize("n,dur,codec,want", [
    (90, 3.0, "lagarith", False), (80, 3.0, "lagarith", True), (90, None, "lagarith", True),
    (90, 3.0, "h264", True), (None, 3.0, "lagarith", True),
])
def test_media_needs_measurement(frame, n, dur, codec, want):
    exact = codec in C.TRUSTED_COUNT_CODECS and n is not None
    d = frame(
        [("/c/master.avi", codec, None, "yuv420p", None, n, exact, 30.0, dur)],
        "path string, codec string, codec_tag string, pixel_format string, color_space string, "
        "frame_count long, frame_count_exact boolean, fps double, duration double",
    )
    assert P.media_needs_measurement(d).first()["needs_measurement"] is want


@pytest.mark.parametrize("rate,dur,imp,n,want", [
    (30.0, 2.0, None, 60, 2.0), (None, None, 30.0, 60, 2.0), (None, 2.0, 0.1, 60, 2.0),
    (None, None, 10.0, 500, 50.0), (None, None, None, 60, None),
])
def test_timing_reference(frame, rate, dur, imp, n, want):
    d = frame([(rate, dur, imp, n)], "r double, d double, i double, n long")
    assert P.timing_reference(d, "r", "d", "i", "n").first()["reference_span"] == want


SCALES = [
    ("0.1", 300, 523 / 300, None), ("1/2", 60, 523 / 60, None), ("10000/1", None, None, "target rate too low"),
    ("1/100", None, None, "target rate too high"),
]


def test_expected_timing(frame):
    d = frame([(i, "30", c[0], 523, None) for i, c in enumerate(SCALES)], "i int, r string, s string, n long, d double")
    d = P.with_rate(P.with_rate(d, "r", "rate"), "s", "scale", lenient=False)
    got = P.expected_timing(d, "rate", "n", "d", "scale").orderBy("i").collect()
    for row, (_, num, span, error) in zip(got, SCALES):
        assert row["timing_error"] == error
        if error is None:
            assert int(row["target_rate"]["num"]) == num
            assert row["expected_span"] == pytest.approx(span)
        else:
            assert row["expected_span"] is None


def test_rebuild_rate(frame):
    d = frame(
        [(25.0, 60, 2.0, None, True), (None, 60, 2.0, None, False), (None, 60, None, 30.0, True),
         (None, 60, None, 30.0, False), (None, 1, 2.0, 30.0, True), (None, 60000, 2.0, 30.0, True)],
        "t double, n long, d double, i double, b boolean",
    )
    got = [r["rebuild_rate"] for r in P.rebuild_rate(d, "t", "n", "d", "i", "b").collect()]
    assert got == [25.0, 30.0, 30.0, None, None, 30.0]


def test_impeach_range(frame):
    nan, inf = float("nan"), float("inf")
    d = frame([(1, nan, nan), (2, 1e300, 2.5), (3, -1.0, inf), (4, 0.0, 3.0), (5, 2.0, 1.0)],
              "i int, a double, b double")
    got = [r["x"] for r in P.impeach_range(d, ["a", "b"], "x").orderBy("i").collect()]
    assert got == [None, 2.5, None, 3.0, 2.0]


CLASSES = {
    "compressed": "h264 hevc av1 vp9 mpeg4 mpeg2video wmv1 wmv2 wmv3 h263 h263p flv1 theora vp6 vp6f vp6a cinepak "
                  "msmpeg4v3 H264",
    "lossless": "lagarith ffv1 utvideo",
    "intermediate": "prores dnxhd",
    "other": "mjpeg unknown",
}


def test_codec_classes(frame, rows):
    cases = [(c, None, k) for k, v in CLASSES.items() for c in v.split()]
    cases += [("mpeg4", "DX50", "compressed"), (None, None, "other")]
    d = P.classify(frame(cases, "codec string, tag string, want string"), "codec", "tag")
    assert d.where(~F.col("class").eqNullSafe(F.col("want"))).count() == 0


DEPTHS = {
    8: "rgb24 bgr24 rgba bgra argb abgr yuv420p gbrp gray ya8 yuvj411p yuvj420p yuvj422p yuvj440p yuvj444p nv16 nv24 "
       "v308 v408 vuyx vuya uyva ayuv pal8 rgb0 bgr0 0rgb 0bgr nv12 yuyv422",
    9: "yuv420p9le yuv420p9be gbrp9le",
    10: "yuv444p10le v210 v410 r210 p010le p210le p210be p410le nv20le v30xle xv30le x2rgb10le x2bgr10le y210le y410le",
    12: "gbrp12le p012le p212le p412le y212le y412le xv36le",
    14: "yuv422p14le",
    16: "rgb48le rgb48be bgr48le rgba64le bgra64be gbrp16le gray16le ya16le ya16be p016le p216le p416le y216le y416le "
        "ayuv64le v216",
    32: "gbrpf32le gbrapf32be grayf32le rgbf32be rgbaf32le yaf32le",
    None: "mysteryfmt rgbunknown yuv420pfoo",
}


def test_bit_depths(frame):
    cases = [(p, d) for d, v in DEPTHS.items() for p in v.split()]
    got = P.pixel_properties(frame(cases, "pixel_format string, want int"))
    assert [tuple(r) for r in got.where(~F.col("bit_depth").eqNullSafe(F.col("want")))
            .select("pixel_format", "bit_depth", "want").collect()] == []


def test_alpha_rgb_and_chroma(frame):
    alpha = "rgba bgra argb abgr yuva420p yuva444p gbrap gbraf16le ya8 ya16le v408 vuya uyva ayuv ayuv64le y410le " \
            "y412le y416le pal8 yaf32le gbrapf32le"
    opaque = "rgb24 bgr24 yuv420p yuv444p v308 vuyx v30xle xv30le xv36le y210le y212le y216le x2rgb10le x2bgr10le v410"
    d = P.pixel_properties(frame([(p, True) for p in alpha.split()] + [(p, False) for p in opaque.split()],
                                 "pixel_format string, want boolean"))
    assert d.where(F.col("has_alpha") != F.col("want")).count() == 0
    chroma = {"4:2:0": "nv12 nv21 p010le", "4:2:2": "nv16 nv20 yuyv422 uyvy422 v210 y210le",
              "4:4:4": "nv24 p410le vuyx ayuv v410 y412le argb gbrap 0rgb x2rgb10le r210"}
    d = P.pixel_properties(frame([(p, k) for k, v in chroma.items() for p in v.split()],
                                 "pixel_format string, want string"))
    assert d.where(~F.col("chroma").eqNullSafe(F.col("want"))).count() == 0
    d = P.pixel_properties(frame([(p,) for p in "argb gbrap 0bgr x2bgr10le r210".split()], "pixel_format string"))
    assert d.where(~F.col("is_rgb")).count() == 0


MEDIA = "path string, pixel_format string, bit_depth int, has_alpha boolean, chroma string, color_space string, " \
        "color_range string, codec string, codec_tag string, fps double"


def clip(pix="yuv420p", depth=8, alpha=False, chroma="4:2:0", path="/v/a.avi", codec="lagarith", fps=30.0,
         space=None, rng=None):
    return (path, pix, depth, alpha, chroma, space, rng, codec, None, fps)


def test_preset_violations(frame):
    d = frame([clip(), clip(alpha=True, pix="rgba"), clip(depth=10), clip(depth=None), clip(pix="gray", chroma=None),
               clip(pix="ya8", alpha=True), clip(pix="yuva444p", alpha=True, chroma="4:4:4")], MEDIA)
    caps = P.Capabilities()

    def found(preset, caps=caps):
        return [r["problems"] for r in P.preset_violations(d, P.Job(preset), caps).collect()]

    assert [len(p) for p in found("prores_lt")] == [0, 1, 0, 0, 0, 1, 1]
    assert [len(p) for p in found("xvid_small")] == [0, 1, 0, 0, 0, 1, 1]
    assert [len(p) for p in found("prores_4444")] == [0] * 7
    assert [len(p) for p in found("magicyuv_lossless")] == [0, 0, 1, 1, 0, 1, 0]
    assert [len(p) for p in found("utvideo_lossless")] == [0, 0, 1, 1, 1, 1, 1]
    assert found("magicyuv_lossless")[3] == ["bit depth unknown"]
    assert all("prores encoder missing" in p for p in found("prores_lt", P.Capabilities(has_prores=False)))


def test_route_media(frame):
    d = P.classify(frame([clip(), clip(codec="h264", path="/v/b.mp4"), clip(fps=None), clip(path="/v/c.mkv")], MEDIA),
                   "codec", "codec_tag")

    def routed(job, caps):
        return [(r["status"], r["backend"]) for r in P.route_media(d, job, caps).collect()]

    both = P.Capabilities(has_native_xvid=True)
    job = P.Job("xvid_max_q2", skip_compressed=True)
    assert routed(job, both) == [("run", "native xvid"), ("skipped", "keep original"), ("run", "libxvid"),
                                 ("run", "libxvid")]
    native = P.Capabilities(has_native_xvid=True, has_lib_xvid=False)
    assert [s for s, _ in routed(P.Job("xvid_max_q2", force=True), native)] == [
        "run", "unroutable", "unroutable", "unroutable"]
    masked = P.Job("xvid_max_q2", no_native=True)
    assert {s for s, _ in routed(masked, native)} == {"unroutable"}
    gpu = P.Capabilities(has_prores_gpu=True)
    assert {b for _, b in routed(P.Job("prores_lt"), gpu)} == {"gpu prores"}
    assert {b for _, b in routed(P.Job("prores_lt", cpu_only=True), gpu)} == {"cpu prores"}


ESC = "\x1b"


@pytest.mark.parametrize("raw,want", [
    (f"evil{ESC}[32mVERIFIED{ESC}[0m.avi", "evilVERIFIED.avi"), (f"clip{ESC}[8m{ESC}[0m.mov", "clip.mov"),
    (f"pre{ESC}[38;5;9mred{ESC}[2Kpost.mkv", "preredpost.mkv"), (f"ti{ESC}]0;pwned\x07tle.mp4", "title.mp4"),
    (f"os{ESC}]0;pwned{ESC}\\c.mp4", "osc.mp4"), ("plain\x00name\rline\nnext.avi", "plainnameline\nnext.avi"),
    (f"open{ESC}]0;never ends", "open"), (f"lone{ESC}x", "lonex"), ("no break", "nobreak"),
])
def test_strict_text(frame, raw, want):
    d = frame([(raw,)], "t string")
    once = P.sanitize_text(d, "t")
    assert once.first()["t"] == want
    assert P.sanitize_text(once, "t").first()["t"] == want


@pytest.mark.parametrize("raw,want", [
    (f"evil{ESC}[2K{ESC}]0;pwned\x07\rname\x00\nsecond line", "evil[2K]0;pwnedname\nsecond line"),
    (f"{ESC}[32mVERIFIED{ESC}[0m {ESC}[2mdone{ESC}[0m", f"{ESC}[32mVERIFIED{ESC}[0m {ESC}[2mdone{ESC}[0m"),
    (f"pre{ESC}[8mconcealed{ESC}[5mblink{ESC}[38;5;9mred", "pre[8mconcealed[5mblink[38;5;9mred"),
    (f"{ESC}[2J{ESC}[H{ESC}]0;t\x07x", "[2J[H]0;tx"),
])
def test_listed_text(frame, raw, want):
    assert P.sanitize_text(frame([(raw,)], "t string"), "t", mode="keep_listed").first()["t"] == want


def test_lines_folded_and_clipped(frame):
    d = frame([("first line\nsecond\tline\r\nthird line",)], "t string")
    assert P.sanitize_text(d, "t", collapse=True, max_len=80).first()["t"] == "first line second line third line"
    assert P.sanitize_text(d, "t", one_line=True).first()["t"] == "first line secondline third line"
    assert P.sanitize_text(d, "t", max_len=10).first()["t"] == "first l..."
    assert P.sanitize_text(d, "t", max_len=3).first()["t"] == "fir"


def test_generated_names(frame, rows):
    own = ["clip_prores_lt.mov", "clip_xvid_max_q2_3.avi", "CLIP_PRORES_LT.MOV", "holiday_magicyuv_lossless.AVI"]
    user = ["clip_xvid_compact.mov", "clip_prores_lt_extra.mov", "clip_xvid_compact_abc.avi", "myxvid_compact.avi",
            "xvid_compact.avi", "clip.mp4"]
    kept = P.exclude_generated(frame([(n,) for n in own + user], "name string"), "name")
    assert rows(kept) == sorted((n,) for n in user)


def test_color_tags(frame):
    d = frame([("yuv420p", "tv", "bt709", "iec61966-2-1", "bt709"), ("yuv420p", "odd", "bt709;x", "iec61966_2_1", "unknown"),
               ("gbrp", "pc", "gbr", "bt709", "bt709")],
              "pixel_format string, color_range string, color_space string, color_transfer string, color_primaries string")
    got = [tuple(r)[1:] for r in P.output_color_tags(d, "prores_lt").collect()]
    assert got[0] == ("tv", "bt709", "iec61966-2-1", "bt709")
    assert got[1] == (None, None, None, None)
    assert got[2][:2] == ("tv", "bt709")
    assert [tuple(r)[1:3] for r in P.output_color_tags(d, "utvideo_lossless").collect()][2] == ("pc", "gbr")


def test_aliases(frame):
    d = P.normalize_alias(frame([(" Share ",), ("LT",), ("4444",), ("nope",), (None,)], "a string"), "a")
    got = [(r["canonical"], r["alias_error"] is None) for r in d.collect()]
    assert got == [("xvid_max_q2", True), ("prores_lt", True), ("prores_4444", True), (None, False), (None, False)]


def test_alias_table_agrees(spark, frame, rows):
    table = spark.createDataFrame(list(C.PRESET_ALIASES.items()), "alias string, canonical string")
    d = frame([(a.upper() + " ",) for a in C.PRESET_ALIASES] + [("nope",)], "a string")
    assert rows(P.normalize_alias_from(d, "a", table)) == rows(P.normalize_alias(d, "a"))


def test_rules_in_a_table_equal_constant_rules(frame, rows):
    rules = [(3, r"^x", "three"), (1, r"[0-9]{2}$", "one"), (2, r"^x1", "two"), (1, r"^xx", "one too")]
    table = frame(rules, "rule int, pattern string, class string")
    values = [" X12 ", "x1", "x", "xx99", "y", None, "", "x", "XX"]
    d = frame([(i, v, 7, "k") for i, v in enumerate(values)], "i int, v string, rule int, pattern string")
    got = P.classify_by_rules(d, "v", table, default="none")
    want = P.classify_by_pattern(d, "v", [(p, c) for _, p, c in sorted(rules)])
    assert got.columns == want.columns
    expected = [(i, c or "none") for i, c in rows(want, "i", "class")]
    assert rows(got, "i", "class") == expected and {c for _, c in expected} == {"one", "two", "three", "none", "one too"}
    assert rows(P.classify_by_rules(d, "v", table.limit(0)), "class") == [(None,)] * len(values)


def test_generated_names_by_a_table_of_tokens(frame, rows):
    """The same names go as with the pattern, among thousands of other tokens."""
    names = ["a_prores_lt.mov", "a_PRORES_LT_12.MOV", "a_prores_lt.avi", "prores_lt.mov", "_xvid_max.avi", "a_xvid_max_q2_3.avi", "a_b_xvid_max_3_4.avi",
             "a_xvid_max_.avi", "a.b_xvid_max.avi", "plain.avi", "noext_xvid_max", "x_9.avi", None, "a_prores_lt.mov"]
    d = frame([(n, i) for i, n in enumerate(names)], "name string, ext long")
    tokens = [*C.PRESET_EXTENSIONS.items(), *((f"other_{i}", "avi") for i in range(3000))]
    got = P.exclude_generated_by(d, "name", frame(tokens, "token string, ext string"))
    assert rows(got, "name", "ext") == rows(P.exclude_generated(d, "name"), "name", "ext") and got.columns == d.columns
