"""Key/value text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_kv_lines(df: DataFrame, text: str, field: str = "field", value: str = "value") -> DataFrame:
    """Cut each line at its first ``=``; lines without one are dropped.

    Trailing carriage returns go first. The value keeps any further ``=``.
    """
    line = F.rtrim(F.col(text), F.lit("\r"))
    d = df.withColumn("__line", line).withColumn("__at", F.instr("__line", "="))
    line, at = F.col("__line"), F.col("__at")
    return (
        d.where(at > 0)
        .withColumns(
            {
                field: F.substring(line, F.lit(1), at - 1),
                value: F.substring(line, at + 1, F.length(line)),
            }
        )
        .drop("__line", "__at")
    )


def read_kv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Key/value lines of text files, with the file as job key."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("key"), "value")
    return parse_kv_lines(raw, "value", "field", "field_value")
