"""Per-item report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import text


def count_label(count: Column, exact: Column) -> Column:
    """``?`` when unknown, ``~n`` when estimated, ``n`` when exact."""
    return F.when(~F.coalesce(count > 0, F.lit(False)), F.lit("?")).otherwise(
        F.concat(F.when(exact, F.lit("")).otherwise(F.lit("~")), count.cast("string"))
    )


def source_report(df: DataFrame, order, columns: dict[str, Column], count: str, exact: str) -> DataFrame:
    """Report rows in ``order`` with a count label and any further columns."""
    rows = df.select(
        order, count_label(F.col(count), F.col(exact)).alias("count_label"),
        *[c.alias(n) for n, c in columns.items()],
    )
    return rows.orderBy(order)


def media_report(media: DataFrame, idx: str = "idx") -> DataFrame:
    """The source table of a classified catalog."""
    codec = F.when(
        (F.lower("codec") == "mpeg4") & F.col("codec_tag").isNotNull(), F.upper("codec_tag")
    ).otherwise(F.upper("codec"))
    return source_report(
        media,
        idx,
        {
            "file": text.clip(text.one_line(text.base_name(F.col("path"))), 25),
            "dimensions": F.concat_ws("x", F.col("width"), F.col("height")),
            "fps_label": F.when(F.col("fps") > 0, F.format_string("%.3f", F.col("fps"))).otherwise("?"),
            "codec_label": text.clip(text.one_line(codec), 11),
            "size_bytes": F.col("size_bytes"),
            "class": F.col("class"),
        },
        "frame_count",
        "frame_count_exact",
    )


def write_source_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    report.write.format(fmt).mode("errorifexists").save(path)
