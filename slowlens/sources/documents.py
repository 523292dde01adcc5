"""JSON documents: snapshot statistics, execution reports, detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from slowlens.functions.shape import computed

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Field names of the three document kinds.
AWR_STAT = _struct(
    snap_time=_S,
    plan_hash_value=_S,
    executions_delta=_L,
    avg_elapsed_sec=_D,
    avg_cpu_sec=_D,
    avg_buffer_gets=_S,
    avg_disk_reads=_S,
    avg_rows=_S,
)
AWR_DOC = _struct(
    sql_id=_S,
    sql_text=_S,
    plan_hash_value=_S,
    source=_S,
    plan=T.ArrayType(_S),
    stats=T.ArrayType(AWR_STAT),
)
DETECTED_SQL = _struct(
    sql_id=_S,
    plan_hash_value=_S,
    parsing_schema_name=_S,
    parsing_user=_S,
    module=_S,
    elapsed_sec_per_exec=_D,
    elapsed_time_per_exec=_D,
    buffer_gets_per_exec=_L,
    disk_reads_per_exec=_L,
    executions=_L,
    sql_text=_S,
)
DETECTION_DOC = _struct(detected_at=_S, part=_L, parts=_L, sql_list=T.ArrayType(DETECTED_SQL))
PHASES = ("parse", "execute", "fetch")
COUNTERS = ("count", "cpu", "elapsed", "disk", "query", "current", "rows")
SECONDS = ("cpu", "elapsed")
TKPROF_STATEMENT = T.StructType(
    [T.StructField("sql_id", _S), T.StructField("sql_text", _S)]
    + [
        T.StructField(f"{p}_{c}", T.DecimalType(18, 6) if c in SECONDS else _L)
        for p in PHASES + ("total",)
        for c in COUNTERS
        if not (p == "total" and c == "count")
    ]
    + [
        T.StructField("execution_plan", T.ArrayType(_S)),
        T.StructField("wait_events", T.ArrayType(_struct(event=_S, times_waited=_L, max_wait=_D))),
        T.StructField("bind_variables", T.ArrayType(_struct(position=_L, type=_S, value=_S))),
        T.StructField(
            "issues",
            T.ArrayType(_struct(rule_no=_L, severity=_S, type=_S, message=_S, subject=_S, measure=_D)),
        ),
    ]
)
TKPROF_DOC = _struct(
    sql_id=_S,
    source=_S,
    trc_file=_S,
    tkprof_file=_S,
    part=_L,
    tkprof_full_text=_S,
    plan=T.ArrayType(_S),
    stats=T.ArrayType(AWR_STAT),
    sql_text=_S,
    tkprof_statements=T.ArrayType(TKPROF_STATEMENT),
)


@dataclass(frozen=True)
class Documents:
    """Readable documents and ``rejects(file, content)`` of the others."""

    docs: DataFrame
    rejects: DataFrame


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None, multi_line: bool = True
) -> Documents:
    """Documents that parse, apart from those that do not.

    ``path`` is a folder, whose files are chosen by ``glob``; for one file, or a
    path that is itself a pattern, give ``glob=None``.
    ``multi_line=True`` is one document per file; ``False`` one per line, which
    is what the sinks write and what splits over tasks.
    """
    # Parsed by an expression on the text, not by the JSON source: that one
    # refuses queries, a count for example, which need no field of the document.
    # A text is parsed once, however many fields are read.
    tolerant = T.StructType(schema.fields + [T.StructField("_corrupt_record", _S)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = (
        spark.read.options(**({"pathGlobFilter": glob} if glob else {}))
        .text(path, wholetext=multi_line)
        .filter(F.btrim("value", F.lit(" \t\r\n")) != "")
        .select(F.col("_metadata.file_name").alias("file"), "value")
    )
    rows = computed(rows, d=F.from_json("value", tolerant, options)).drop("value")
    good = rows.filter("d._corrupt_record is null").select("d.*", "file").drop("_corrupt_record")
    rejects = rows.filter("d._corrupt_record is not null").select("file", F.col("d._corrupt_record").alias("content"))
    return Documents(good, rejects)


def read_awr_docs(spark: SparkSession, path: str, glob: str | None = "*_awr_*.json", multi_line: bool = True) -> Documents:
    return read_documents(spark, path, AWR_DOC, glob, multi_line)


def read_tkprof_docs(spark: SparkSession, path: str, glob: str | None = "*_tkprof_*.json", multi_line: bool = True) -> Documents:
    return read_documents(spark, path, TKPROF_DOC, glob, multi_line)


def read_detections(spark: SparkSession, path: str, glob: str | None = "detected_*.json", multi_line: bool = True) -> Documents:
    """One row per detected statement, stamped with its document's time."""
    found = read_documents(spark, path, DETECTION_DOC, glob, multi_line)
    rows = found.docs.select("file", "detected_at", F.explode("sql_list").alias("s")).select("file", "detected_at", "s.*")
    return Documents(rows, found.rejects)
