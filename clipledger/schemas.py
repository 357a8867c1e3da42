"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_S, _I, _L, _D, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)

STREAM = _fields(
    ("codec_name", _S), ("profile", _S), ("codec_type", _S), ("width", _I),
    ("height", _I), ("pix_fmt", _S), ("bits_per_raw_sample", _S),
    ("avg_frame_rate", _S), ("r_frame_rate", _S), ("duration", _S),
    ("nb_frames", _S), ("nb_read_frames", _S), ("codec_tag_string", _S),
    ("color_range", _S), ("color_space", _S), ("color_transfer", _S),
    ("color_primaries", _S), ("disposition", _fields(("attached_pic", _I))),
)

PROBE_DOC = _fields(
    ("streams", T.ArrayType(STREAM)),
    ("format", _fields(("duration", _S), ("size", _S), ("tags", _fields(("comment", _S))))),
)

MEDIA = _fields(
    ("path", _S), ("codec", _S), ("codec_tag", _S), ("profile", _S), ("width", _I),
    ("height", _I), ("pixel_format", _S), ("bit_depth", _I), ("fps_text", _S),
    ("fps", _D), ("duration", _D), ("frame_count", _L), ("frame_count_exact", _B),
    ("size_bytes", _L), ("color_range", _S), ("color_space", _S),
    ("color_transfer", _S), ("color_primaries", _S), ("has_alpha", _B),
    ("chroma", _S), ("audio", T.ArrayType(_S)), ("provenance", _S),
    ("timestamps_broken", _B), ("impeached_fps", _S),
)
