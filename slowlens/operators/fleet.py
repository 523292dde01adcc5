"""Environment tables of a fleet of databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from slowlens.config import INSTANCE_PARAMETERS, OS_ITEMS, PGA_ITEMS
from slowlens.functions.text import base_name

# Bytes of the display units.
MIB = 1024.0 * 1024.0
GIB = MIB * 1024.0


def memory_report(env_metric: DataFrame) -> DataFrame:
    """Shared memory pools and the named process memory items in MB."""
    wanted = (F.col("kind") == "sga") | ((F.col("kind") == "pga") & F.col("name").isin(*PGA_ITEMS))
    return env_metric.filter(wanted).select(
        "inst_id", "kind", "name", F.coalesce(F.col("value").cast("double") / MIB, F.lit(0.0)).alias("size_mb")
    )


def os_report(env_metric: DataFrame) -> DataFrame:
    """Named host items: memory in GB with one digit, CPU counts, others as text."""
    value, name = F.col("value"), F.col("name")
    tenths = F.round(value.cast("decimal(38,10)") / F.lit(int(GIB)).cast("decimal(11,0)"), 1)
    shown = (
        F.when(name.contains("MEMORY"), F.concat(tenths.cast("decimal(28,1)").cast("string"), F.lit(" GB")))
        .when(name.contains("CPU"), value.cast("bigint").cast("string"))
        .otherwise(value.cast("string"))
    )
    return env_metric.filter((F.col("kind") == "os") & name.isin(*OS_ITEMS)).select("inst_id", "name", shown.alias("shown"))


def param_report(env_param: DataFrame) -> DataFrame:
    """Named parameters; numbers above 1 MiB also in MB; sort by name to show."""
    value = F.col("value")
    number = F.when(value.rlike("^[0-9]+$"), value.try_cast("decimal(38,0)"))
    mb = F.round(number / F.lit(1048576).cast("decimal(7,0)"), 0).cast("decimal(38,0)").cast("string")
    shown = F.when(number > 1048576, F.concat(value, F.lit(" ("), mb, F.lit(" MB)"))).otherwise(value)
    return env_param.filter(F.col("name").isin(*INSTANCE_PARAMETERS)).select(
        "inst_id",
        "name",
        shown.alias("shown"),
        (~F.coalesce("is_default", F.lit(True))).alias("is_changed"),
    )


def instance_status(instances: DataFrame) -> DataFrame:
    """Instances of clusters that have more than one, open or not."""
    cluster = Window.partitionBy("db_id")
    return (
        instances.withColumn("members", F.count("*").over(cluster))
        .filter("members > 1")
        .select(
            "db_id",
            "inst_id",
            "instance_name",
            "host_name",
            "status",
            F.col("startup_time").cast("string").alias("startup_time"),
            F.when(F.col("status") == "OPEN", "good").otherwise("warn").alias("band"),
        )
    )


def service_match(config: DataFrame, instances: DataFrame, databases: DataFrame) -> DataFrame:
    """How each configured target fits its instance: ``service``, ``sid``, a
    mismatch of either, or ``none`` when nothing is configured.

    ``config(db_id, inst_id, service_name, sid)``.
    """
    joined = config.join(instances, ["db_id", "inst_id"]).join(databases, "db_id")
    service = F.upper(F.coalesce("service_name", F.lit("")))
    sid = F.upper(F.coalesce("sid", F.lit("")))
    db, instance = F.upper("db_name"), F.upper("instance_name")
    services = F.upper(F.coalesce("service_names", F.lit("")))
    verdict = (
        F.when(service != "", F.when(services.contains(service) | (service == db), "service").otherwise("service mismatch"))
        .when(sid != "", F.when((sid == instance) | (sid == db), "sid").otherwise("sid mismatch"))
        .otherwise("none")
    )
    return joined.select(
        "db_id", "inst_id", "service_name", "sid", "instance_name", "db_name", verdict.alias("verdict")
    ).withColumn("matched", F.col("verdict").isin("service", "sid"))


def environment_from_trace(db_info: DataFrame) -> DataFrame:
    """Labels of the first trace by file name that has any."""
    labels = [c for c in db_info.columns if c != "file"]
    return (
        db_info.filter(F.coalesce(*labels).isNotNull())
        .agg(F.min_by(F.struct("file", *labels), F.struct(base_name(F.col("file")), "file")).alias("e"))
        .filter("e is not null")
        .select("e.*")
    )
