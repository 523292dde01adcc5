"""The dedup ledger as a table with one entry per statement and plan.

Entries lie in folders by a hash of their key.  An upsert reads and writes the
folders of its keys only: their new content goes to a generation of its own, and
then a version of the index, one small file that names the generation of every
folder, makes it visible.  Readers see the last version; a run that fails leaves
nothing behind that is read, and one that is repeated changes nothing more.
Entries older than the dedup period go when their folder is written next, so the
size follows the distinct recent keys, not the detected rows.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slowlens.config import DEFAULTS
from slowlens.operators.detect import plan_key

FOLDERS = 64
ENTRY = "sql_id string, plan_hash_value string, collected_at timestamp, elapsed_sec_per_exec double"
INDEX = "folder int, generation string, folders int"


def _folder(sql_id: Column, plan: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(sql_id, plan), F.lit(folders)).cast("int")


def _index(spark: SparkSession, path: str) -> tuple[int, dict[int, str], int | None]:
    """The last version, the generation of each folder that has one, and the number of folders."""
    try:
        versions = spark.read.schema(INDEX + ", version bigint").parquet(f"{path}/index")
    except AnalysisException:
        return 0, {}, None
    last = versions.agg(F.max("version")).first()[0] or 0
    rows = versions.filter(F.col("version") == last).collect()  # a row per folder
    return last, {r.folder: r.generation for r in rows}, rows[0].folders if rows else None


def _entries(spark: SparkSession, path: str, generations: dict[int, str], wanted: list[int]) -> DataFrame:
    paths = [f"{path}/data/{generations[f]}/folder={f}" for f in wanted if f in generations]
    return spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries, one per statement and plan."""
    _, generations, _ = _index(spark, path)
    return _entries(spark, path, generations, sorted(generations))


def _touched(keys: DataFrame) -> list[int]:
    return sorted(r["_folder"] for r in keys.select("_folder").distinct().collect())  # at most one row per folder


def not_in_ledger(df: DataFrame, path: str, now: datetime, hours: int = DEFAULTS.dedup_hours) -> DataFrame:
    """``dedup_recent`` against the table: only the folders of ``df``'s keys are read."""
    spark = df.sparkSession
    _, generations, folders = _index(spark, path)
    if not generations:
        return df
    keyed = df.withColumn("_plan", plan_key()).withColumn("_folder", _folder(F.col("sql_id"), F.col("_plan"), folders))
    recent = _entries(spark, path, generations, _touched(keyed)).filter(F.col("collected_at") >= F.lit(now - timedelta(hours=hours)))
    known = recent.select("sql_id", F.col("plan_hash_value").alias("_plan"))
    return keyed.join(known, ["sql_id", "_plan"], "left_anti").drop("_plan", "_folder")


def upsert_ledger(df: DataFrame, path: str, now: datetime, hours: int = DEFAULTS.dedup_hours, folders: int = FOLDERS) -> None:
    """Mark the keys of ``df`` as collected ``now``."""
    marked = df.select("sql_id", plan_key().alias("plan_hash_value"), F.lit(now).cast("timestamp").alias("collected_at"), "elapsed_sec_per_exec")
    upsert_entries(marked, path, now - timedelta(hours=hours), folders)


def upsert_entries(entries: DataFrame, path: str, oldest: datetime, folders: int = FOLDERS) -> None:
    """Add entries; of one key the newest stays (of equal times the slowest), none from before ``oldest``."""
    spark = entries.sparkSession
    version, generations, used = _index(spark, path)
    folders = used or folders
    folder = _folder(F.col("sql_id"), F.col("plan_hash_value"), folders)
    newest = F.max(F.struct(F.col("collected_at").cast("timestamp").alias("collected_at"), "elapsed_sec_per_exec")).alias("e")

    def reduced(rows: DataFrame) -> DataFrame:
        recent = rows.filter(F.col("collected_at") >= F.lit(oldest))
        return recent.groupBy("sql_id", "plan_hash_value").agg(newest).select("sql_id", "plan_hash_value", "e.*")

    new = entries.select("sql_id", plan_key().alias("plan_hash_value"), "collected_at", "elapsed_sec_per_exec")
    touched = _touched(new.select(folder.alias("_folder")))
    if not touched:
        return
    both = reduced(_entries(spark, path, generations, touched).unionByName(reduced(new)))
    generation = uuid.uuid4().hex
    both.withColumn("folder", folder).repartition("folder").write.mode("errorifexists").partitionBy("folder").parquet(f"{path}/data/{generation}")
    written = {r.folder for r in spark.read.parquet(f"{path}/data/{generation}").select("folder").distinct().collect()}
    current = {f: g for f, g in generations.items() if f not in touched} | dict.fromkeys(sorted(written), generation)
    index = spark.createDataFrame([(f, g, folders) for f, g in current.items()], INDEX)
    index.withColumn("version", F.lit(version + 1).cast("bigint")).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{path}/index")
