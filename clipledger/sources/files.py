"""File listings as tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions import text
from clipledger.functions.digest import content_signature
from clipledger.operators.project import generated_name
from clipledger.operators.windows import dedupe_keep_first

BLOCK_BYTES = 1 << 20


def scan_files(
    spark: SparkSession,
    roots: Sequence[str],
    exts: Sequence[str] = tuple(C.VIDEO_EXTENSIONS),
    exclude: dict[str, str] | None = None,
) -> DataFrame:
    """Files directly inside each root with a supported extension.

    Only path, length and modification time are read; file contents are never
    opened. Own outputs and unfinished temporary streams are left out, a file
    reached through two roots appears once, under the first. Order the result
    with ``ordered_inputs``.
    """
    exclude = C.PRESET_EXTENSIONS if exclude is None else exclude
    listed = None
    for i, root in enumerate(roots):
        part = (
            spark.read.format("binaryFile")
            .load(root)
            .select(
                F.lit(i).alias("root_idx"),
                F.regexp_replace("path", r"^file:/+", "/").alias("path"),
                F.col("length").alias("size_bytes"),
                F.col("modificationTime").alias("mtime"),
            )
        )
        listed = part if listed is None else listed.unionByName(part)
    name = text.base_name(F.col("path"))
    files = listed.withColumns(
        {
            "dir": text.parent_dir(F.col("path")),
            "name": name,
            "stem": text.stem(name),
            "ext": text.extension(name),
        }
    ).where(F.col("ext").isin([e.lower().lstrip(".") for e in exts]))
    files = files.where(~F.lower("name").endswith(C.TEMP_STREAM_SUFFIX))
    if exclude:
        files = files.where(~generated_name(F.col("name"), exclude))
    if len(roots) > 1:
        files = dedupe_keep_first(files, "path", "root_idx")
    return files


def scan_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Existing results in a folder with their stem, preset and slot."""
    tokens = sorted(C.PRESET_EXTENSIONS, key=len, reverse=True)
    pattern = r"^(.*)_(" + "|".join(tokens) + r")(?:_([0-9]+))?\.(avi|mov)\z"
    low = F.lower("name")
    files = scan_files(spark, [folder], ["avi", "mov"], exclude={})
    digits = F.regexp_extract(low, pattern, 3)
    slot = F.when(digits == "", F.lit(1)).otherwise(digits.try_cast("int"))
    return (
        files.where(low.rlike(pattern))
        .withColumns(
            {
                "preset": F.regexp_extract(low, pattern, 2),
                "stem": F.substring(
                    F.col("name"), F.lit(1), F.length(F.regexp_extract(low, pattern, 1))
                ),
                "slot": slot,
                "numbered": digits != "",
            }
        )
        .where(
            F.col("slot").between(1, C.MAX_SLOT) & ~(F.col("numbered") & (F.col("slot") < 2))
        )
        .drop("numbered")
    )


def _streamed_signature(paths: pd.Series, sizes: pd.Series) -> pd.Series:
    """:func:`content_signature` of files on a mounted store, in constant memory."""
    import hashlib

    def one(path, size):
        digest = hashlib.sha256(int(size).to_bytes(8, "little"))
        with open(path, "rb") as f:
            while block := f.read(BLOCK_BYTES):
                digest.update(block)
        return digest.hexdigest()

    return pd.Series([one(p, n) for p, n in zip(paths, sizes)])


def file_signatures(spark: SparkSession, folder: str, max_cell_bytes: int = 1 << 28) -> DataFrame:
    """Content signature of every file in a folder, whatever its size.

    Files up to ``max_cell_bytes`` are read as one binary cell, from any store.
    Larger ones are streamed by the executors in blocks, which asks for a folder
    that executors have mounted.
    """
    files = spark.read.format("binaryFile").load(folder)
    path = F.regexp_replace("path", r"^file:/+", "/").alias("path")
    small = files.where(F.col("length") <= max_cell_bytes).select(
        path, "length", content_signature(F.col("content")).alias("signature")
    )
    streamed = F.pandas_udf(_streamed_signature, "string")
    large = files.where(F.col("length") > max_cell_bytes).select(path, "length")
    return small.unionByName(large.withColumn("signature", streamed("path", "length")))
