"""Write, audit, publish."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def publish_verified(
    df: DataFrame, target: str, check: Callable[[DataFrame], DataFrame], problems: str = "problems"
) -> DataFrame:
    """Publish ``df`` below ``target`` only if what was written passes ``check``.

    The data goes to a version directory of its own, is read back, and
    ``check`` reconciles the read-back rows, giving rows with a problem list.
    Without problems a manifest row naming the version is appended last, which
    is what makes it visible; no directory is renamed. With problems, the
    version written by this run is removed and nothing else is touched; so it is
    where writing or checking fails.

    Returns one audit row: version, rows, rows with problems, published.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    place = f"{target.rstrip('/')}/versions/{version}"
    try:
        df.write.parquet(place)
        back = spark.read.schema(df.schema).parquet(place)
        counted = back.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        failed = check(back).where(F.size(problems) > 0).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    except BaseException:
        _remove(spark, place)
        raise
    audit = spark.createDataFrame(
        [(version, counted, failed, failed == 0)],
        "version string, row_count long, problem_rows long, published boolean",
    )
    if failed == 0:
        audit.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{target.rstrip('/')}/manifest"
        )
    else:
        _remove(spark, place)
    return audit


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """The version named by the newest manifest row."""
    base = target.rstrip("/")
    newest = spark.read.parquet(f"{base}/manifest").agg(F.max_by("version", "published_at").alias("v"))
    return spark.read.parquet(f"{base}/versions/{newest.first()['v']}")
