"""Writers: nested documents, report tables, text files, written relations."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.text import base_name
from slowlens.operators.execreport import exec_text_report
from slowlens.operators.snapshots import snap_range
from slowlens.session import scratch_path
from slowlens.sources.documents import TKPROF_DOC, TKPROF_STATEMENT
from slowlens.sources.texts import PACK_MARK, TextSet

#: Tasks that the rows of one detection run are dealt to.
BUCKETS = 256
# Fixed value: the folder of rows without a name.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def tkprof_docs(statements: DataFrame, blocks_per_doc: int = 1000, reports: TextSet | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Nested documents of execution reports.

    The statements of a report become an array in block order.  A report with
    many statements is spread over several documents of ``blocks_per_doc``
    blocks (``part``, from 0, says which, in the reader too), so no row grows
    without bound; readers explode the arrays and see the same statements.  A
    report is one ``tkprof_file``, however many parts it has.
    Statements whose issues were not looked for have none in their document.

    With ``reports`` documents hold the text of their report as well (a text too
    large for a value part by part), and a report without a kept statement gives
    a document, too.  Plan and statistics are those of snapshot documents; in
    documents of reports they are empty lists.
    """
    if "issues" not in statements.columns:
        statements = statements.withColumn("issues", F.lit(None).cast(TKPROF_STATEMENT["issues"].dataType))
    statement = F.struct("block_no", *[f.name for f in TKPROF_STATEMENT.fields])
    part = F.floor(F.col("block_no") / blocks_per_doc).cast("bigint")
    docs = statements.groupBy("file", part.alias("part")).agg(
        F.array_sort(F.collect_list(statement)).alias("_s")
    )
    text = F.lit(None).cast("string")
    if reports is not None:
        # a text that is a value is its only part, also when it is empty: one pass over the texts
        zero, full_text = F.lit(0).cast("bigint").alias("part"), F.col("text").alias("full_text")
        texts = reports.texts.filter(F.col("text").isNotNull()).select("file", zero, full_text)
        if reports.long_lines is not None:
            long = exec_text_report(TextSet(reports.texts.filter(F.lit(False)), reports.long_lines), settings)
            texts = texts.unionByName(long.select("file", (F.col("part") - 1).alias("part"), "full_text"))
        docs, text = docs.join(texts, ["file", "part"], "full"), F.coalesce("full_text", F.lit(""))
    stem = F.regexp_replace(base_name(F.col("file")), r"\.[^.]*$", "")
    # later parts of a text can be without statements; the report's first document tells
    nothing = F.col("_s").isNull() & (F.col("part") == 0)
    found = F.coalesce("_s", F.array().cast(docs.schema["_s"].dataType))
    return docs.select(
        F.when(nothing, stem).otherwise(F.substring_index(stem, "_", 1)).alias("sql_id"),
        F.lit("tkprof").alias("source"),
        F.concat(stem, F.lit(".trc")).alias("trc_file"),
        F.col("file").alias("tkprof_file"),
        "part",
        text.alias("tkprof_full_text"),
        F.array().cast("array<string>").alias("plan"),
        F.array().cast(TKPROF_DOC["stats"].dataType).alias("stats"),
        F.coalesce(F.get(found, F.lit(0))["sql_text"], F.lit("")).alias("sql_text"),
        F.transform(found, lambda s: s.dropFields("block_no")).alias("tkprof_statements"),
    )


def write_tkprof_docs(
    statements: DataFrame,
    path: str,
    blocks_per_doc: int = 1000,
    reports: TextSet | None = None,
    settings: Settings = DEFAULTS,
    compression: str | None = None,
) -> None:
    """A document per line; compressed files, which are read by a task each, hold a thousand at most."""
    writer = tkprof_docs(statements, blocks_per_doc, reports, settings).write.mode("errorifexists")
    (writer.option("maxRecordsPerFile", 1000) if compression else writer).json(path, compression=compression)


def detection_docs(detections: DataFrame, rows_per_doc: int = 1000) -> DataFrame:
    """``{detected_at, part, parts, sql_list}`` per run, in parts of bounded length.

    Rows of a run are numbered through: inside buckets by a hash of the row, on
    from the sizes of the buckets before, so that a run with very many rows never
    meets in one task and is joined to nothing but one row per bucket.
    """
    columns = [c for c in detections.columns if c != "detected_at"]
    mark = F.xxhash64(*columns)
    inside = Window.partitionBy("detected_at", "_bucket").orderBy(mark, *columns)
    numbered = detections.withColumn("_bucket", F.pmod(mark, F.lit(BUCKETS))).withColumn("_no", F.row_number().over(inside))
    run = Window.partitionBy("detected_at")
    before = run.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("detected_at", "_bucket").agg(F.max("_no").alias("_size"))
    starts = sizes.select(
        "detected_at",
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.ceil(F.sum("_size").over(run) / rows_per_doc).cast("bigint").alias("parts"),
    )
    part = F.floor((F.col("_start") + F.col("_no") - 1) / rows_per_doc).cast("bigint")
    return (
        numbered.join(starts, ["detected_at", "_bucket"])
        .groupBy("detected_at", part.alias("part"), "parts")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("sql_list"))
        .select("detected_at", "part", "parts", "sql_list")
    )


def write_detection_docs(detections: DataFrame, path: str) -> None:
    detection_docs(detections).write.mode("errorifexists").json(path)


def write_report_tables(tables: Mapping[str, DataFrame], path: str, run_date: date, fmt: str = "parquet") -> None:
    """One table per report, partitioned by the date of the run.

    Only the partitions of this run are replaced when it is written again.
    """
    for name, df in tables.items():
        (
            df.withColumn("run_date", F.lit(run_date))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("header", "true")
            .partitionBy("run_date")
            .format(fmt)
            .save(f"{path.rstrip('/')}/{name}")
        )


def write_trace_facts(facts: DataFrame, path: str) -> None:
    """The fact table of a trace set, one folder per kind: extractors that
    filter on the kind read only theirs."""
    facts.write.mode("errorifexists").partitionBy("kind").parquet(path)


def write_sqlstat(sqlstat: DataFrame, path: str) -> None:
    """Snapshot counters in folders of adjacent snapshot ids."""
    ranged = sqlstat.withColumn("snap_range", snap_range())
    ranged.repartition("snap_range", F.pmod(F.xxhash64("sql_id"), F.lit(64))).write.mode("errorifexists").partitionBy(
        "snap_range"
    ).parquet(path)


def write_texts(texts: DataFrame, path: str, named: bool = True) -> None:
    """One text file per row of ``(file, text)``.

    ``named`` puts each into a folder ``file=name``, which readers with the key
    ``folder_value()`` take as its name; without it the files lie side by side under generated names,
    which lists much faster.
    """
    if named:
        texts.select("file", "text").repartition("file").write.mode("errorifexists").partitionBy("file").text(path)
    else:
        texts.select("text").write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def write_packs(texts: DataFrame, path: str, named: bool = True, per_pack: int = 1000, compression: str | None = None) -> None:
    """The texts of ``(file, text)`` in packs of at most ``per_pack``, see ``read_packs``.

    Names in a pack are those of ``write_texts``: ``named`` puts each text into a folder
    ``file=name``, where texts of one name are one, otherwise names are generated.
    """
    writer = pack_records(texts, named).write.mode("errorifexists").option("maxRecordsPerFile", per_pack)
    writer.text(path, compression=compression)


def pack_records(texts: DataFrame, named: bool = True) -> DataFrame:
    """``(value)``: what ``write_packs`` writes; texts that are dealt by a ``file`` without nulls already stay in their tasks."""
    text = F.coalesce("text", F.lit(""))
    if named:
        tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # a name that can't be null is taken as it is, so that texts dealt by it are known to be
        name = F.coalesce("file", F.lit(NO_NAME)) if texts.schema["file"].nullable else F.col("file")
        dealt = texts.select(name.alias("file"), text.alias("text")).repartition(tasks, "file")
        of_name = F.array_join(F.sort_array(F.collect_list("text")), "\n")
        rows = dealt.groupBy("file").agg(of_name.alias("text")).select(F.concat(F.lit("file="), F.col("file"), F.lit("/text.txt")).alias("name"), "text")
    else:
        rows = texts.select(F.concat(F.monotonically_increasing_id().cast("string"), F.lit(".txt")).alias("name"), text.alias("text"))
    broken = F.col("name").rlike(f"[{PACK_MARK}\r\n]") | F.contains("text", F.lit(PACK_MARK))
    record = F.concat(F.lit(PACK_MARK), F.col("name"), F.lit("\n"), F.col("text"))
    checked = F.when(broken, F.raise_error(F.lit("a pack holds no text with its mark"))).otherwise(record)
    return rows.select(checked.alias("value"))


def materialize(df: DataFrame, spark: SparkSession, label: str, *by: str) -> DataFrame:
    """Write a relation to the shared folder, in folders of ``by``, and read it back.

    Cuts the lineage, survives lost executors and lets several readers share
    one pass over the text.
    """
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
