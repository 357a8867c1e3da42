"""Cleaning of untrusted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger import constants as C


def strict_text(c: Column) -> Column:
    """Drop whole escape sequences, then everything that is not printable or a newline."""
    return F.regexp_replace(F.regexp_replace(c, C.ESCAPE_SEQUENCE, ""), C.NOT_PRINTABLE, "")


def listed_text(c: Column) -> Column:
    """Keep the listed colour sequences; other escapes lose only their ESC."""
    return F.regexp_replace(F.regexp_replace(c, C.UNLISTED_ESC, ""), C.NOT_PRINTABLE_OR_ESC, "")


def one_line(c: Column) -> Column:
    return F.replace(strict_text(c), F.lit("\n"), F.lit(" "))


def clip(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last three replaced by dots when cut."""
    cut = F.substring(c, 1, n) if n <= 3 else F.concat(F.substring(c, 1, n - 3), F.lit("..."))
    return F.when(F.length(c) <= n, c).otherwise(cut)


def trimmed(c: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.regexp_replace(c, f"^{C.WHITE_SPACE_RUN}|{C.WHITE_SPACE_RUN}\\z", "")


def squeeze(c: Column) -> Column:
    """White-space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, C.WHITE_SPACE_RUN, " "))


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*\z", "")


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
