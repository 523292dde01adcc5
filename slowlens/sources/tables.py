"""Workload tables from columnar files or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of the workload tables.
WORKLOAD_TABLES = (
    "stmt_stats",
    "sqlstat",
    "snapshot",
    "sqltext",
    "sysstat",
    "bind_capture",
    "accounts",
)


def read_workload_tables(spark: SparkSession, path: str, names=WORKLOAD_TABLES, fmt: str = "parquet") -> dict[str, DataFrame]:
    """One lazy DataFrame per table below ``path``.

    ``sqlstat`` written by ``write_sqlstat`` is partitioned by snapshot
    id range, so a window on snapshots prunes files.
    """
    return {name: spark.read.format(fmt).load(f"{path.rstrip('/')}/{name}") for name in names}


def read_workload_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    lower_snap: int,
    upper_snap: int,
    partitions: int = 64,
    fetch_rows: int = 10_000,
    **options: str,
) -> DataFrame:
    """A snapshot table over JDBC, read in parallel ranges of ``snap_id``.

    Filters, columns, aggregates and limits are pushed to the database by the
    JDBC source.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "snap_id")
        .option("lowerBound", lower_snap)
        .option("upperBound", upper_snap)
        .option("numPartitions", partitions)
        .option("fetchsize", fetch_rows)
        .option("pushDownAggregate", "true")
        .option("pushDownLimit", "true")
        .options(**options)
        .load()
    )
