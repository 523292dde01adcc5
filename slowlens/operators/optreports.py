"""Report tables on optimizer traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from slowlens.config import KEY_PARAMETERS_SHEET
from slowlens.functions.text import base_name, preview

# Bytes of a block; display limits.
BLOCK_BYTES = 8192
DETAIL_CUT = 200


def trace_summary(
    files: DataFrame,
    statements: DataFrame,
    tables: DataFrame,
    blocks: DataFrame,
    best: DataFrame,
    joins: DataFrame,
    issues: DataFrame,
    db_info: DataFrame,
) -> DataFrame:
    """One row per trace; every side is reduced to one row per trace first."""
    first_table = tables.groupBy("file").agg(F.min_by(F.struct("table_name", "rows"), "at").alias("t"))
    first_block = blocks.groupBy("file").agg(F.min("block_at").alias("block_at"))
    first_best = (
        first_block.join(best.select("file", "block_at", "method", "index_name", "cost"), ["file", "block_at"], "left")
        .drop("block_at")
        .withColumnsRenamed({"method": "best_method", "index_name": "best_index", "cost": "best_cost"})
    )
    counts = issues.groupBy("file").agg(F.count("*").alias("issue_count"))
    n = F.coalesce("issue_count", F.lit(0))
    return (
        files.join(statements, "file", "left")
        .join(first_table, "file", "left")
        .join(first_best, "file", "left")
        .join(joins.select("file", F.col("cost").alias("total_cost")), "file", "left")
        .join(counts, "file", "left")
        .join(db_info.select("file", "instance_name"), "file", "left")
        .select(
            "file",
            "sql_id",
            preview(F.coalesce("sql_text", F.lit("")), 80).alias("sql_preview"),
            F.col("t.table_name").alias("table_name"),
            F.col("t.rows").alias("table_rows"),
            "best_method",
            "best_index",
            "best_cost",
            "total_cost",
            n.alias("issue_count"),
            F.when(n > 2, "danger").when(n > 0, "warn").otherwise("none").alias("band"),
            "instance_name",
        )
    )


def _by_cost():
    return Window.partitionBy("file", "block_at").orderBy("cost", "entry_no")


def access_path_report(methods: DataFrame, best: DataFrame, scan: DataFrame) -> DataFrame:
    """Methods of each block by cost, against the cost of the chosen path."""
    key = ["file", "block_at"]
    chosen = F.coalesce("best_cost", F.lit(0.0))
    ratio = F.when(chosen > 0, F.col("cost") / chosen).otherwise(F.lit(0.0))
    return (
        methods.withColumn("rank", F.row_number().over(_by_cost()).cast("bigint"))
        .join(best.select(*key, F.col("cost").alias("best_cost")), key, "left")
        .join(scan.select(*key, "scan_io_cost", "total_scan_io_cost"), key, "left")
        .withColumn("is_best", F.col("rank") == 1)
        .withColumn("cost_ratio", ratio)
        .select(
            "file",
            "block_at",
            "table_name",
            "rank",
            "method",
            F.coalesce("index_name", F.lit("-")).alias("index_name"),
            "cost",
            "response_time",
            "degree",
            "cost_io",
            "cost_cpu",
            "ix_sel",
            "scan_io_cost",
            "total_scan_io_cost",
            "is_best",
            "cost_ratio",
            F.when(F.col("is_best"), "good").when(F.col("cost_ratio") > 5, "danger").otherwise("none").alias("band"),
        )
    )


def access_rank_html(methods: DataFrame) -> DataFrame:
    """Methods of each block by cost, against the cheapest method."""
    block = Window.partitionBy("file", "block_at")
    cheapest = F.min("cost").over(block)
    method = F.col("method")
    return methods.select(
        "file",
        "block_at",
        "table_name",
        F.row_number().over(_by_cost()).cast("bigint").alias("rank"),
        "method",
        "index_name",
        "cost",
        F.when(cheapest > 0, F.col("cost") / cheapest).otherwise(F.lit(0.0)).alias("cost_ratio"),
        F.count("*").over(block).alias("methods"),
        F.when(method.contains("TableScan"), "FTS")
        .when(method.contains("FFS"), "FFS")
        .when(method.contains("FullScan"), "Full")
        .otherwise("")
        .alias("badge"),
    ).withColumn("is_worst", (F.col("rank") == F.col("methods")) & (F.col("methods") > 1))


def table_size_report(tables: DataFrame) -> DataFrame:
    return tables.select(
        "file",
        "table_name",
        "alias",
        "rows",
        "blocks",
        "avg_row_len",
        (F.col("blocks") * BLOCK_BYTES / F.lit(1024.0 * 1024.0)).alias("size_mb"),
    )


def index_quality_report(indexes: DataFrame) -> DataFrame:
    ratio = F.when(F.col("num_rows") > 0, F.col("clustering_factor") / F.col("num_rows")).otherwise(F.lit(0.0))
    r = F.col("cf_ratio")
    return indexes.withColumn("cf_ratio", ratio).select(
        "file",
        "index_name",
        "columns",
        "levels",
        "leaf_blocks",
        "distinct_keys",
        "lb_per_key",
        "db_per_key",
        "clustering_factor",
        "cf_ratio",
        F.when(r > 0.5, "danger").when(r > 0.3, "warn").when(r < 0.1, "good").otherwise("none").alias("band"),
    )


def column_stats_report(columns: DataFrame) -> DataFrame:
    has = ~F.col("histogram").isin("None", "N/A (no stats)")
    return columns.select(
        "file",
        "column_name",
        "data_type",
        "ndv",
        "nulls",
        "density",
        "avg_len",
        "histogram",
        "buckets",
        F.when(has, "good").otherwise("warn").alias("band"),
    )


def system_stats_report(system: DataFrame) -> DataFrame:
    """Items with their default flag, without the mode."""
    return system.filter("item <> 'stats_type'").select(
        "file",
        "item",
        "value",
        "unit",
        "default_value",
        "is_default",
        F.when(F.col("is_default"), "warn").otherwise("none").alias("band"),
    )


def system_stats_environment(system: DataFrame) -> DataFrame:
    """All items of the first trace by name, with the mode."""
    first = system.agg(F.min(F.struct(base_name(F.col("file")), "file"))["file"].alias("file"))
    return system.join(F.broadcast(first), "file", "left_semi").select(  # one row: an aggregate without keys
        "item",
        "value",
        "default_value",
        F.when(F.col("item") == "stats_type", F.when(F.col("value") == "NOWORKLOAD", "warn").otherwise("good"))
        .otherwise(F.when(F.col("is_default"), "warn").otherwise("none"))
        .alias("band"),
    )


def key_params_report(params: DataFrame, key_names: Sequence[str] = KEY_PARAMETERS_SHEET) -> DataFrame:
    """All altered parameters and the named default ones."""
    return params.filter((F.col("section") == "altered") | F.col("name").isin(*key_names))


def other_params_count(params: DataFrame, key_names: Sequence[str] = KEY_PARAMETERS_SHEET) -> DataFrame:
    """Per trace the number of default parameters that are not listed."""
    return (
        params.filter("section = 'default'")
        .groupBy("file")
        .agg(F.count_if(~F.col("name").isin(*key_names)).alias("other_params"))
    )


def transformation_report(found: DataFrame, cut: int | None = None) -> DataFrame:
    """Kind, name, status and detail; ``cut`` for the page form."""
    detail = F.col("detail") if cut is None else F.substring("detail", 1, cut)
    band = F.when(F.col("status") == "applied", "good").when(F.col("status") == "bypassed", "warn").otherwise("none")
    return found.select("file", "at", "type", "name", "status", detail.alias("detail"), band.alias("band"))
