"""Properties read off a pixel-format name by ordered pattern rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions import text


def bit_depth(name: Column) -> Column:
    """Bits per component, NULL when the name does not tell."""
    low = F.lower(text.trimmed(name))
    rest = F.regexp_replace(low, C.PLANAR_FORMAT, "")
    depth = F.regexp_extract(rest, r"^([0-9]+)", 1).try_cast("int")
    out = F.when(low.rlike(C.FLOAT_FORMAT), F.lit(32)).when(
        low.rlike(C.PLANAR_FORMAT),
        F.when(rest == "", F.lit(8)).when(depth > 0, depth),
    )
    for pattern, bits in C.PACKED_DEPTHS:
        out = out.when(low.rlike(pattern), F.lit(bits))
    return out


def has_alpha(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(low.rlike(C.ALPHA_FORMAT) | is_gray_alpha(name), F.lit(False))


def is_gray_alpha(name: Column) -> Column:
    return F.coalesce(F.lower(text.trimmed(name)).rlike(C.GRAY_ALPHA_FORMAT), F.lit(False))


def is_rgb(name: Column) -> Column:
    return F.coalesce(F.lower(text.trimmed(name)).rlike(C.RGB_FORMAT), F.lit(False))


def chroma(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.contains("444") | is_rgb(name), F.lit("4:4:4"))
    out = out.when(low.contains("422"), F.lit("4:2:2")).when(low.contains("420"), F.lit("4:2:0"))
    for value, pattern in C.CHROMA_BY_NAME:
        out = out.when(low.rlike(pattern), F.lit(value))
    return out
