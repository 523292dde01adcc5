"""File lists: new files, files of a window, latest and expired files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from slowlens.config import RETENTION_POLICY
from slowlens.functions.text import split_stem


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file_name, mtime, length)`` of the files below a path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select(
            F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
            F.col("modificationTime").alias("mtime"),
            "length",
        )
    )


def unprocessed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose stem is not the stem of a file in ``ledger(file_name)``."""
    done = ledger.select(split_stem(F.col("file_name")).alias("_stem")).distinct()
    return files.withColumn("_stem", split_stem(F.col("file_name"))).join(done, "_stem", "left_anti").drop("_stem")


def files_in_window(files: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Both ends belong to the window."""
    return files.filter(F.col("mtime").between(F.lit(start), F.lit(end)))


def latest_file(files: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """The last matching file by name."""
    named = files.filter(F.col("file_name").startswith(prefix) & F.col("file_name").endswith(suffix))
    return named.orderBy(F.desc("file_name")).limit(1)


def expired_files(files: DataFrame, now: datetime, policy=RETENTION_POLICY) -> DataFrame:
    """Files older than their policy allows, in whole days; nothing is deleted.

    ``policy`` is a literal list ``(dir, name pattern, max_days)``, so the match
    is a column expression and needs no join.
    """
    age = F.floor((F.unix_micros(F.lit(now)) - F.unix_micros(F.col("mtime").cast("timestamp"))) / F.lit(86_400_000_000))
    rules = F.array(
        *[
            F.when((F.col("dir") == d) & F.col("file_name").rlike(p) & (age > days), F.lit(days))
            for d, p, days in policy
        ]
    )
    return (
        files.withColumn("age_days", age)
        .withColumn("max_days", F.array_min(F.filter(rules, lambda x: x.isNotNull())))
        .filter("max_days is not null")
    )
