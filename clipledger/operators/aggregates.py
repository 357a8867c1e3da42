"""Grouped decisions. All aggregates combine map-side before the shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clipledger import constants as C
from clipledger.functions import text
from clipledger.functions.digest import content_signature
from clipledger.functions.keys import as_list, join_on, micros, restore, solid
from clipledger.functions.rational import rate_text, with_rate
from clipledger.functions.segments import (
    SEG, SEGMENT_ROWS, along, before, inside, summarise, with_segment,
)
from clipledger.operators.project import rate_agrees


# ------------------------------------------------------------- claim audit

def audit_claims(
    claims: DataFrame,
    facts: DataFrame,
    key,
    rate: str,
    span: str,
    measured: str = "measured",
) -> DataFrame:
    """Replace claimed counts by measured ones and re-judge rate and span.

    A contradicted rate is cleared together with the span and kept aside as
    ``impeached_rate``. A confirmed rate refreshes a span that was claimed; a
    span is never invented. Rows without facts keep their claims.
    """
    key = as_list(key)
    counted = facts.groupBy(*key).agg(F.count(F.lit(1)).alias(measured))
    return judge_claims(join_on(claims, counted, key, "left"), rate, span, measured)


def judge_claims(df: DataFrame, rate: str, span: str, measured: str) -> DataFrame:
    """The row-level part of :func:`audit_claims`, for counts already joined."""
    r, d, n = F.col(rate), F.col(span), F.col(measured)
    refuted = n.isNotNull() & (r > 0) & ~rate_agrees(r, n, d)
    df = df.withColumn("__refuted", F.coalesce(refuted, F.lit(False)))
    bad = F.col("__refuted")
    confirmed = n.isNotNull() & (r > 0) & (d > 0)
    return df.withColumns(
        {
            "impeached_rate": F.when(bad, r),
            "audited_rate": F.when(~bad, r),
            "audited_span": F.when(bad, F.lit(None)).when(confirmed, n / r).otherwise(d),
            "count_exact": n.isNotNull(),
        }
    ).drop("__refuted")


# ---------------------------------------------------------------- timeline

def timeline_stats(
    df: DataFrame, key, seq: str, ts: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Per key: rows, changes of spacing, smallest and largest spacing, span.

    Rows are taken in arrival order ``seq`` (an integer, unique per key), never
    in timestamp order, which would hide time running backwards. Timestamps
    count in microseconds, numbers as they are. NULL timestamps are rows
    without a measurement.

    Spacing is measured inside segments, then across segment borders on the
    segment summaries, so no task ever holds a whole hot key.
    """
    names = as_list(key)
    df, key = solid(df.select(*names, seq, micros(df, ts).alias("__t")), names)
    rows = with_segment(df, seq, segment_rows)
    w = inside(key, seq)
    local = rows.withColumn(
        "__d", F.col("__t") - F.last("__t", ignorenulls=True).over(before(w))
    ).withColumn("__pd", F.last("__d", ignorenulls=True).over(before(w)))
    t, d, s = F.col("__t"), F.col("__d"), F.col(seq)
    at_t, at_d = F.when(t.isNotNull(), s), F.when(d.isNotNull(), s)
    per_seg = summarise(
        local,
        key,
        F.count(F.lit(1)).alias("n"),
        F.min_by(t, at_t).alias("t_first"),
        F.max_by(t, at_t).alias("t_last"),
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        F.min_by(d, at_d).alias("d_first"),
        F.max_by(d, at_d).alias("d_last"),
        F.min(d).alias("d_min"),
        F.max(d).alias("d_max"),
        F.count_if(d != F.col("__pd")).alias("changes"),
    )
    a = along(key)
    per_seg = per_seg.withColumn(
        "cross", F.col("t_first") - F.last("t_last", ignorenulls=True).over(before(a))
    ).withColumn("d_end", F.coalesce("d_last", "cross"))
    per_seg = per_seg.withColumn("d_prev", F.last("d_end", ignorenulls=True).over(before(a)))
    cross = F.col("cross")
    border = F.coalesce((cross != F.col("d_prev")).cast("long"), F.lit(0)) + F.coalesce(
        (F.col("d_first") != cross).cast("long"), F.lit(0)
    )
    stats = per_seg.groupBy(*key).agg(
        F.sum("n").alias("n"),
        (F.count("t_first") > 0).alias("reported"),
        F.sum(F.col("changes") + border).alias("changed_deltas"),
        F.least(F.min("d_min"), F.min("cross")).alias("min_delta"),
        F.greatest(F.max("d_max"), F.max("cross")).alias("max_delta"),
        (F.max("t_max") - F.min("t_min")).alias("span"),
    )
    return restore(stats, names)


def broken_timeline(stats: DataFrame, reference: Column, out: str = "broken") -> DataFrame:
    """Verdict on :func:`timeline_stats` rows; ``reference`` is in the span's unit.

    Broken: nothing measured; or spacing varies and is somewhere not positive;
    or the whole span is at most an eighth of the reference. Regular and
    healthy variable spacing are both fine.
    """
    n, span = F.col("n"), F.col("span")
    varies = (F.col("changed_deltas") > 0) & (F.col("min_delta") <= 0)
    collapsed = (n > 1) & (reference > 0) & (span * C.COLLAPSE_FACTOR <= reference)
    return stats.withColumn(
        out,
        ~F.col("reported") | F.coalesce(varies, F.lit(False)) | F.coalesce(collapsed, F.lit(False)),
    )


# --------------------------------------------------------------- summaries

def summarize(
    items: DataFrame,
    by=(),
    status: str = "status",
    in_bytes: str | None = None,
    out_bytes: str | None = None,
    output_dir: str | None = None,
    idx: str = "idx",
    totals: bool = False,
) -> DataFrame:
    """Tallies of finished items; cancelled and unset statuses do not count.

    ``totals=True`` adds the rows of a rollup over ``by``.
    """
    by = as_list(by)
    st = F.col(status)
    done = items.where(st.isNotNull() & ~st.isin("", "cancelled"))
    aggs = [
        F.count(F.lit(1)).alias("items"),
        F.count_if(st == "ok").alias("successes"),
        F.count_if(st == "skipped").alias("skipped"),
        F.count_if(st == "failed").alias("failures"),
    ]
    if in_bytes:
        aggs.append(F.sum(in_bytes).alias("in_total"))
    if out_bytes:
        aggs.append(F.sum(out_bytes).alias("out_total"))
    if output_dir:
        delivered = st.isin("ok", "skipped") & F.col(output_dir).isNotNull()
        aggs.append(F.max_by(F.col(output_dir), F.when(delivered, F.col(idx))).alias("last_dir"))
    grouped = done.rollup(*by) if totals else done.groupBy(*by)
    return grouped.agg(*aggs)


def run_verdict(
    items: DataFrame,
    run: str,
    status: str = "status",
    output: str = "output",
    unreadable: str | None = None,
) -> DataFrame:
    """One exit code per run.

    130 if anything was cancelled, 1 on any failure or unreadable input, 2 if
    there were items but none was delivered, else 0. A skip that resolved to
    an existing output is a delivery.
    """
    st = F.col(status)
    bad = st == "failed"
    if unreadable:
        bad = bad | F.coalesce(F.col(unreadable), F.lit(False))
    counted = st.isNotNull() & ~st.isin("", "cancelled")
    delivered = (st == "ok") | ((st == "skipped") & F.col(output).isNotNull())
    sums = items.groupBy(run).agg(
        F.coalesce(F.bool_or(st == "cancelled"), F.lit(False)).alias("__cancelled"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("__failed"),
        F.count_if(counted).alias("items"),
        F.count_if(delivered).alias("delivered"),
    )
    code = (
        F.when(F.col("__cancelled"), F.lit(C.EXIT_CANCELLED))
        .when(F.col("__failed"), F.lit(C.EXIT_FAILED))
        .when((F.col("delivered") == 0) & (F.col("items") > 0), F.lit(C.EXIT_NOTHING))
        .otherwise(F.lit(C.EXIT_OK))
    )
    return sums.withColumn("exit_code", code).drop("__cancelled", "__failed")


def profile_catalog(
    df: DataFrame, by, compressed: Column, master: Column, alpha: Column, plain: Column
) -> DataFrame:
    """Homogeneous or mixed, any alpha, all plain (8-bit 4:2:0), suggested tier."""
    by = as_list(by)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.bool_and(flag(compressed)).alias("__all_c"),
        F.bool_and(flag(master)).alias("__all_m"),
        F.bool_or(flag(alpha)).alias("any_alpha"),
        F.bool_and(flag(plain)).alias("all_plain"),
    )
    return sums.withColumns(
        {
            "profile": F.when(F.col("__all_c"), F.lit("compressed"))
            .when(F.col("__all_m"), F.lit("masters"))
            .otherwise(F.lit("mixed")),
            "tier": F.when(F.col("any_alpha"), F.lit("prores_4444")).otherwise(F.lit("prores_lt")),
        }
    ).drop("__all_c", "__all_m")


def profile_media(media: DataFrame, by) -> DataFrame:
    """:func:`profile_catalog` on classified clips."""
    kind = F.col("class")
    plain = (F.col("chroma") == "4:2:0") & ~F.coalesce(F.col("bit_depth") > 8, F.lit(False))
    return profile_catalog(
        media, by, kind == "compressed", kind.isin("lossless", "intermediate"), F.col("has_alpha"), plain
    )


def colliding_keys(
    df: DataFrame, directory: Column, name: Column, fold_directory: bool = False
) -> DataFrame:
    """Places where more than one item would land on the same lower-cased stem."""
    place = F.lower(directory) if fold_directory else directory
    return (
        df.groupBy(place.alias("dir"), F.lower(text.stem(name)).alias("stem"))
        .agg(F.count(F.lit(1)).alias("items"))
        .where(F.col("items") > 1)
    )


# ----------------------------------------------------------------- digests

def content_fingerprint(
    df: DataFrame, content: str, out: str = "signature", max_bytes: int | None = None
) -> DataFrame:
    """Add the content signature and, for cells over ``max_bytes``, a reason.

    Oversized cells get no signature rather than a sampled one.
    """
    c = F.col(content)
    if max_bytes is None:
        return df.withColumn(out, content_signature(c))
    big = F.octet_length(c.cast("binary")) > max_bytes
    return df.withColumns(
        {
            out: F.when(~big, content_signature(c)),
            f"{out}_error": F.when(big, F.lit("content too large")).when(
                c.isNull(), F.lit("content unreadable")
            ),
        }
    )


def chunk_signature(df: DataFrame, key, seq: str, chunk: str, out: str = "signature") -> DataFrame:
    """:func:`content_signature` of content that comes as chunks, one row per key.

    The chunks of a key are taken in ``seq`` order, NULL ones as empty; a key
    without any content at all has the signature of nothing. Rows stream through
    the hash one after the other, so content of any length takes constant memory.
    A digest is sequential: one key's chunks go through one task.
    """
    names = as_list(key)
    solid_df, key = solid(df, names)
    data = F.coalesce(F.col(chunk).cast("binary"), F.lit(b""))
    rows = solid_df.select(*key, F.col(seq).alias("__seq"), data.alias("__chunk"))
    sizes = rows.groupBy(*key).agg(F.sum(F.octet_length("__chunk")).alias("__size"))
    rows = join_on(rows, sizes, key).repartition(*key).sortWithinPartitions(*key, "__seq", "__chunk")
    fields = T.StructType([rows.schema[k] for k in key])
    schema = to_arrow_schema(T.StructType([*fields, T.StructField(out, T.StringType())]))
    # Rows change hands as (key, size, chunk); a key ends where the next one begins.
    narrow = rows.select(*key, "__size", "__chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []

        def flush():
            columns = list(zip(*done, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(len(key))), strict=True)
            for k, size, data in zip(keys, b.column(len(key)).to_pylist(), b.column(len(key) + 1), strict=True):
                if k != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = k, hashlib.sha256(int(size).to_bytes(8, "little"))
                digest.update(data.as_buffer())
            yield flush()
            done = []
        if digest is not None:
            done.append((*current, digest.hexdigest()))
            yield flush()

    signed = narrow.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
    return restore(signed, names)


def duplicate_groups(df: DataFrame, signature: str, item: str) -> DataFrame:
    """Signatures carried by more than one item; no signature matches nothing."""
    return (
        df.where(F.col(signature).isNotNull())
        .groupBy(signature)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(item).alias("first_item"))
        .where(F.col("copies") > 1)
    )


def job_signature(
    df: DataFrame,
    texts: Sequence[str],
    rates: Sequence[str],
    flags: Sequence[Column],
    out: str = "job_sig",
) -> DataFrame:
    """16 hex digits over canonical options.

    Rates are reduced to ``num/den`` first (unparsable text is hashed as is),
    each option ends in a NUL byte, and flags follow as one byte each.
    """
    for i, r in enumerate(rates):
        df = with_rate(df, r, f"__r{i}", lenient=False, trim=True)
    parts = [F.col(t).cast("string") for t in texts] + [
        F.coalesce(rate_text(F.col(f"__r{i}")), F.col(r)) for i, r in enumerate(rates)
    ]
    pieces = []
    for p in parts:
        pieces += [F.coalesce(p, F.lit("")), F.char(F.lit(0))]
    pieces += [F.when(f, F.char(F.lit(1))).otherwise(F.char(F.lit(0))) for f in flags]
    df = df.withColumn(out, F.substring(F.sha2(F.concat(*pieces), 256), 1, 16))
    return df.drop(*[f"__r{i}" for i in range(len(rates))])


def media_job_signature(jobs: DataFrame, out: str = "job_sig") -> DataFrame:
    """Signature of rows with the conversion options."""
    return job_signature(
        jobs,
        ["preset"],
        ["timescale", "capture_fps"],
        [
            F.col("conform"),
            F.col("strip_audio") | F.col("conform"),
            F.col("cpu_only"),
            F.col("no_native"),
        ],
        out,
    )


# ----------------------------------------------------------- pattern count

def occurrences(data: Column, pattern: str) -> Column:
    """Number of positions at which the literal ``pattern`` starts."""
    units = "".join(f"\\x{{{ord(ch):x}}}" for ch in pattern)
    return F.regexp_count(data, F.lit(f"(?={units})"))


def chunked_pattern_count(
    df: DataFrame, key, seq: str, chunk: str, pattern: bytes | str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Occurrences of a pattern per key, including those across chunk borders.

    Binary chunks are read as one character per byte, so the count is byte
    exact. Each chunk is searched once, prefixed by the last ``m - 1`` units
    that precede it - which may come from several short chunks. Borders between
    segments are counted on the segment summaries, which carry the first and
    last ``m - 1`` units of each segment.
    """
    names = as_list(key)
    df, key = solid(df, names)
    if isinstance(pattern, bytes):
        units, pattern = F.decode(F.col(chunk), "ISO-8859-1"), pattern.decode("latin-1")
    else:
        units = F.col(chunk)
    m = len(pattern)
    data = with_segment(df.select(*key, seq, units.alias("__c")), seq, segment_rows)
    if m == 1:
        hits = F.coalesce(F.sum(occurrences(F.col("__c"), pattern)), F.lit(0))
        return restore(data.groupBy(*key).agg(hits.alias("hits")), names)
    keep = m - 1
    c = F.col("__c")
    # Empty chunks go to segments of their own, ahead of the others, so that
    # m-1 preceding rows always hold at least m-1 units.
    filled = F.coalesce(F.length(c) > 0, F.lit(False))
    data = data.withColumn(SEG, F.struct(filled.alias("filled"), F.col(SEG).alias("seg")))
    data = data.withColumn("__tail", F.when(filled, F.right(c, F.lit(keep))))
    w = inside(key, seq)
    prior = F.array_join(F.collect_list("__tail").over(w.rowsBetween(-keep, -1)), "")
    data = data.withColumns(
        {"__carry": F.right(prior, F.lit(keep)), "__pos": F.row_number().over(w)}
    )
    joined = F.when(filled, F.concat("__carry", "__c"))
    # Leading units of a segment: its first m-1 chunks hold enough.
    lead = F.when(
        filled & (F.col("__pos") <= keep), F.struct(seq, F.left(c, F.lit(keep)).alias("u"))
    )
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(lead)), lambda x: x["u"]), "")
    per_seg = summarise(
        data,
        key,
        F.coalesce(F.sum(occurrences(joined, pattern)), F.lit(0)).alias("hits"),
        F.left(heads, F.lit(keep)).alias("head"),
        F.max_by(F.right(joined, F.lit(keep)), seq).alias("tail"),
    )
    border_prior = F.array_join(
        F.collect_list("tail").over(along(key).rowsBetween(-keep, -1)), ""
    )
    per_seg = per_seg.withColumn("__carry", F.right(border_prior, F.lit(keep)))
    hits = F.sum(F.col("hits") + occurrences(F.concat("__carry", "head"), pattern))
    return restore(per_seg.groupBy(*key).agg(hits.alias("hits")), names)
