"""Metadata documents: parse, reject, flatten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger import constants as C
from clipledger.functions import pixels
from clipledger.functions.evaluate import evaluate_once
from clipledger.functions.rational import with_rate
from clipledger.functions.text import trimmed
from clipledger.operators.project import implied_count, in_range, rate_agrees
from clipledger.schemas import PROBE_DOC

_BAD = "_corrupt_record"
# fixed value: spelling of a plain decimal number
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


#: Possessive throughout: one pass, and no depth of recursion in the matcher.
_TEXT = r'"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_TOKENS = rf"\A(?:{_TEXT}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null|[\[\]{{}},: \t\n\r]++)++\z"
#: Depth of brackets that is told without a parser.
_DEPTH = 6


def _closed(depth: int) -> str:
    """Pattern of any number of closed brackets in a row, nested to ``depth``."""
    inner = _closed(depth - 1) if depth > 1 else ""
    return rf"(?:\{{{inner}\}}|\[{inner}\])*+"


_OBJECT = rf"\A\{{{_closed(_DEPTH)}\}}"


def _parsed_alone(doc: Column) -> Column:
    """Nothing follows the first value.

    The parser stops after one value, so the text is read as the only element of
    an array and as the only field of an object. What closes the one early leaves
    the other malformed.
    """
    element = F.from_json(F.concat(F.lit("["), doc, F.lit("]")), "array<string>", _STRICT)
    field = F.from_json(
        F.concat(F.lit('{"d":'), doc, F.lit("}")), f"d string, {_BAD} string", {**_STRICT, "columnNameOfCorruptRecord": _BAD}
    )
    return F.coalesce((F.size(element) == 1) & field[_BAD].isNull() & field["d"].isNotNull(), F.lit(False))


def _alone(doc: Column) -> Column:
    """Nothing follows the first value, if it is well formed.

    The parser pays for each malformed text with exceptions. So a text that is no
    row of tokens is told by a pattern, and where an object ends by its brackets
    alone: at the end of the text or before. Only deeper brackets, and texts that
    begin with another value, are left to the parser.
    """
    tokens = doc.rlike(_TOKENS)
    brackets = F.regexp_replace(doc, rf"{_TEXT}|[^\[\]{{}}\"]++", "")
    whole = doc.rlike(r"\A[ \t\n\r]*+\{") & doc.rlike(r"\}[ \t\n\r]*+\z")
    told = (
        F.when(~doc.rlike(r"\A[ \t\n\r]*+\{"), F.lit(None).cast("boolean"))
        .when(brackets.rlike(rf"{_OBJECT}."), False)
        .when(brackets.rlike(rf"{_OBJECT}\z"), whole)
    )
    return F.when(~F.coalesce(tokens, F.lit(False)), False).otherwise(F.coalesce(told, _parsed_alone(doc)))


def parse_json(
    df: DataFrame, doc: str, schema: T.StructType = PROBE_DOC, out: str = "doc_parsed",
    max_bytes: int | None = None, required: Column | None = None,
    required_reason: str = "no video stream",
) -> DataFrame:
    """Add the parsed document and a ``reject_reason`` (NULL for good rows).

    Only one JSON object is accepted: no other quotes, no NaN, nothing after it.
    Text above ``max_bytes``, if given, is rejected before it is parsed.
    ``required`` is a predicate on the parsed column.
    """
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType(), True)])
    big = F.lit(False) if max_bytes is None else F.octet_length(F.col(doc)) > max_bytes
    parsed = F.from_json(F.when(~big, F.col(doc)), full, {**_STRICT, "columnNameOfCorruptRecord": _BAD})
    df = evaluate_once(df, {out: F.when(_alone(F.when(~big, F.col(doc))), parsed)})
    reason = (
        F.when(big, F.lit("too large"))
        .when(F.col(doc).isNull(), F.lit("unreadable"))
        .when(F.col(out).isNull() | F.col(out)[_BAD].isNotNull(), F.lit("unparsable"))
    )
    if required is not None:
        reason = reason.when(~F.coalesce(required, F.lit(False)), F.lit(required_reason))
    return evaluate_once(df, {"reject_reason": reason})


def split_rejects(
    df: DataFrame, doc: str, schema: T.StructType = PROBE_DOC, out: str = "doc_parsed",
    max_bytes: int | None = None, required: Column | None = None,
    required_reason: str = "no video stream",
) -> tuple[DataFrame, DataFrame]:
    """Good rows with the parsed document, and bad rows with their reason."""
    parsed = parse_json(df, doc, schema, out, max_bytes, required, required_reason)
    good = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, parsed.where(F.col("reject_reason").isNotNull()).drop(out)


def video_stream(parsed: Column) -> Column:
    """First video stream that is not an attached picture."""
    playable = F.filter(
        parsed["streams"],
        lambda s: (s["codec_type"] == "video")
        & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0),
    )
    return F.get(playable, F.lit(0))


def _number(c: Column, kind: str) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast(kind))


def _known(c: Column) -> Column:
    return F.when(c != "", c)


def flatten_probe(df: DataFrame, doc: str, path: str = "path", parsed: str | None = None) -> DataFrame:
    """Metadata documents to ``media`` rows; rows without a usable video stream are dropped.

    Besides the columns of ``schemas.MEDIA`` the rows carry the exact rate as
    ``fps_rate``.

    Implausible durations fall back to the container level. Counts are exact
    only for codecs with dependable frame tables, and only exact counts may
    confirm or refute a rate. A refuted rate takes the duration with it, since
    nothing tells which of the two is stale.
    """
    if parsed is None:
        parsed = "doc_parsed"
        df, _ = split_rejects(df, doc)
    audio = F.transform(
        F.filter(F.col(parsed)["streams"], lambda s: s["codec_type"] == "audio"),
        lambda s: s["codec_name"],
    )
    # Only what is used travels on; the parsed document is wide.
    d = evaluate_once(
        df.select(path, parsed),
        {
            "__v": video_stream(F.col(parsed)),
            "__audio": audio,
            "__fmt": F.col(parsed)["format"],
        },
    ).drop(parsed)
    d = d.where(F.col("__v").isNotNull())
    v, fmt = F.col("__v"), F.col("__fmt")
    d = d.withColumns(
        {
            "__dur": F.coalesce(
                in_range(_number(v["duration"], "double"), 0.0, C.MAX_DURATION),
                in_range(_number(fmt["duration"], "double"), 0.0, C.MAX_DURATION),
            ),
            "__frames": F.when(v["nb_frames"].try_cast("long") > 0, v["nb_frames"].try_cast("long")),
            "__avg": F.coalesce(v["avg_frame_rate"], F.lit("")),
            "__nom": F.coalesce(v["r_frame_rate"], F.lit("")),
        }
    )
    d = d.withColumn(
        "__exact",
        F.col("__frames").isNotNull()
        & F.coalesce(F.lower(trimmed(v["codec_name"])).isin(C.TRUSTED_COUNT_CODECS), F.lit(False)),
    )
    ra, rr, dur = F.col("__ra"), F.col("__rr"), F.col("__dur")
    witness = F.when(F.col("__exact"), F.col("__frames"))
    ok_a = F.coalesce(ra["value"].isNotNull() & rate_agrees(ra["value"], witness, dur), F.lit(False))
    d = with_rate(d, "__avg", "__ra")
    # The nominal rate is only read where the average did not settle the matter.
    d = d.withColumn("__second", F.when(ok_a, F.lit("")).otherwise(F.col("__nom")))
    d = with_rate(d, "__second", "__rr")
    ok_r = rr["value"].isNotNull() & rate_agrees(rr["value"], witness, dur)
    any_valid = ra["value"].isNotNull() | rr["value"].isNotNull()
    d = d.withColumns(
        {
            "__rate": F.when(ok_a, ra).when(ok_r, rr),
            "__text": F.when(ok_a, F.col("__avg")).when(ok_r, F.col("__nom")),
        }
    )
    refuted = F.col("__rate").isNull() & (witness > 0) & (dur > 0) & any_valid
    d = d.withColumn("__dur", F.when(~F.coalesce(refuted, F.lit(False)), dur))
    fps = F.col("__rate")["value"]
    pix = _known(v["pix_fmt"])
    tag_bits = v["bits_per_raw_sample"].try_cast("int")
    return d.select(
        F.col(path).alias("path"),
        _known(v["codec_name"]).alias("codec"),
        _known(v["codec_tag_string"]).alias("codec_tag"),
        _known(v["profile"]).alias("profile"),
        F.when(v["width"] > 0, v["width"]).alias("width"),
        F.when(v["height"] > 0, v["height"]).alias("height"),
        pix.alias("pixel_format"),
        F.coalesce(F.when(tag_bits != 0, tag_bits), pixels.bit_depth(pix)).alias("bit_depth"),
        F.col("__text").alias("fps_text"),
        fps.alias("fps"),
        F.col("__rate").alias("fps_rate"),
        F.col("__dur").alias("duration"),
        F.coalesce(F.col("__frames"), implied_count(fps, F.col("__dur"))).alias("frame_count"),
        F.col("__exact").alias("frame_count_exact"),
        fmt["size"].try_cast("long").alias("size_bytes"),
        *[_known(v[c]).alias(c) for c in ("color_range", "color_space", "color_transfer", "color_primaries")],
        pixels.has_alpha(pix).alias("has_alpha"),
        pixels.chroma(pix).alias("chroma"),
        F.col("__audio").alias("audio"),
        _known(fmt["tags"]["comment"]).alias("provenance"),
        F.lit(False).alias("timestamps_broken"),
        F.lit(None).cast("string").alias("impeached_fps"),
    )
