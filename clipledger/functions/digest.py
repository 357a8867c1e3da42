"""Content and job digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian8(n: Column) -> Column:
    """A long as eight little-endian bytes."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def content_signature(content: Column) -> Column:
    """SHA-256 over the 8-byte size followed by the whole content.

    NULL content gives NULL, and NULL never equals another signature.
    """
    data = content.cast("binary")
    return F.sha2(F.concat(little_endian8(F.octet_length(data)), data), 256)


def provenance_tag(prefix: str, source_sig: Column, job_sig: Column) -> Column:
    """``<prefix> src=<source> job=<job>``; NULL when the source has no signature."""
    return F.concat(F.lit(prefix + " src="), source_sig, F.lit(" job="), job_sig)
