"""Session settings the operators are tuned for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "slowlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time.

    On a cluster leave ``master`` unset; every setting can be overridden.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        # keys of a day do not fit on the heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset the warehouse
    folder of the session takes its place, as long as executors can see it: a session
    on several machines with a folder that is only local is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") and (base.startswith("file:") or ":" not in base):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
