"""Streaming forms of detection, roll-up and text intake.

Most functions take a streaming DataFrame and return one; ``run_available``
drains what has arrived into a table, and a cluster job starts the same frame
with a processing-time trigger.

Ranks, facts of traces and the ledger need whole batches.  Those sinks work per
batch and write to a folder that is named by the batch, so a batch that is done
again after a failure replaces its own rows and changes nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from slowlens.config import DEFAULTS, Settings
from slowlens.operators.detect import detect_over_thresholds, exclude_statements, plan_key
from slowlens.operators.execreport import exec_blocks, exec_statements
from slowlens.operators.execrules import with_issues
from slowlens.operators.optrules import trace_issues
from slowlens.operators.opttrace import candidate_lines, trace_facts
from slowlens.sinks.ledger import not_in_ledger, upsert_ledger
from slowlens.sources.texts import PACK_MARK, TRACE_GLOB, TextSet, clean_bytes, file_path, lines_with_followers, packed_texts, read_traces
from slowlens.functions.text import unix_newlines

# Period of detection, of a snapshot, and the report periods.
DETECT_EVERY = "5 minutes"
SNAPSHOT = "1 hour"
DAY = "1 day"
WEEK = "7 days"
# Fixed value: state rows that the keys of a collection are dealt to; fixed for the life of a checkpoint.
COLLECT_BUCKETS = 2048


def stream_detect(stream: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Arriving rows over a per-execution limit, system users and texts left out.

    Stateless, so it scales with the input partitions alone.
    """
    return exclude_statements(detect_over_thresholds(stream, settings))


def stream_dedup(stream: DataFrame, hours: int = DEFAULTS.dedup_hours, time_column: str = "ts") -> DataFrame:
    """One row per statement and plan within ``hours``.

    Measured in event time from the first sighting, while the batch ledger
    measures in processing time from the last collection; state older than the
    watermark is dropped, so it stays bounded by the distinct recent keys.
    """
    return (
        stream.withColumn("plan_key", plan_key())
        .withWatermark(time_column, f"{hours} hours")
        .dropDuplicatesWithinWatermark(["sql_id", "plan_key"])
    )


def _collector(hours: int, time_column: str) -> Callable:
    """Rows of the keys of one bucket: those of a time are kept unless their key was collected within the ``hours`` before it.

    The state lists keys and the time of their last collection; an entry is dropped once the
    watermark is ``hours`` past it, and rows that are not kept do not renew it.  Rows of a
    bucket in one batch are handled together, in one pass in order of time.
    """
    period = hours * 3_600_000_000

    def collect(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).dropna(subset=[time_column]).sort_values(time_column, kind="stable")
        entries = json.loads(state.get[0]) if state.exists else []
        last = {(sql_id, plan): at for sql_id, plan, at in entries}
        new, kept = {}, []
        times = rows[time_column].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        for i, (sql_id, plan, at) in enumerate(zip(rows["sql_id"].tolist(), rows["plan_key"].tolist(), times)):
            of = (sql_id, plan)
            if of not in last or last[of] < at - period:
                last[of] = new[of] = at
            if new.get(of) == at:
                kept.append(i)
        watermark = state.getCurrentWatermarkMs()
        # the same limit as that of a timeout: the millisecond after the period
        live = [(*of, at) for of, at in last.items() if (at + period) // 1000 + 1 > watermark]
        if live:
            state.update((json.dumps(live),))
            expires = (max(at for _, _, at in live) + period) // 1000 + 1
            state.setTimeoutTimestamp(max(expires, watermark + 1))
        elif state.exists:
            state.remove()
        if kept:
            yield rows.iloc[kept].drop(columns="_bucket")

    return collect


def stream_collect(
    stream: DataFrame, hours: int = DEFAULTS.dedup_hours, time_column: str = "ts", late: str = "1 hour", buckets: int = COLLECT_BUCKETS
) -> DataFrame:
    """Rows to collect: as the batch ledger, measured from the last collection.

    ``time_column`` is the time of the detection run.  A key is collected again by
    the first run more than ``hours`` after its last collection; rows later than the
    watermark are not counted.  State is one time per key and goes ``hours`` after it; keys are
    kept in ``buckets`` by their hash, as a call and a state for every key cost far more than its rows.
    """
    keyed = stream.withColumn("plan_key", plan_key()).withWatermark(time_column, late)
    bucket = F.pmod(F.xxhash64("sql_id", "plan_key"), F.lit(buckets)).alias("_bucket")
    return keyed.select("*", bucket).groupBy("_bucket").applyInPandasWithState(
        _collector(hours, time_column),
        outputStructType=StructType(keyed.schema.fields),
        stateStructType="entries string",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )


def _rollup(stream: DataFrame, window, late: str, time_column: str) -> DataFrame:
    return (
        stream.withWatermark(time_column, late)
        .groupBy(window, "sql_id")
        .agg(
            F.count("*").alias("samples"),
            F.sum("executions").alias("executions"),
            F.sum("buffer_gets_per_exec").alias("buffer_gets"),
            F.max("elapsed_sec_per_exec").alias("max_elapsed_sec"),
        )
        .select(F.col("window.start").alias("period_start"), "sql_id", "samples", "executions", "buffer_gets", "max_elapsed_sec")
    )


def stream_snapshot_rollup(stream: DataFrame, late: str = "1 hour", time_column: str = "ts") -> DataFrame:
    """Hourly sums per statement; an hour is given out once it is complete.

    Rows later than the watermark are not counted.
    """
    return _rollup(stream, F.window(time_column, SNAPSHOT), late, time_column)


def stream_daily_rollup(stream: DataFrame, late: str = "1 hour", time_column: str = "ts") -> DataFrame:
    return _rollup(stream, F.window(time_column, DAY), late, time_column)


def stream_weekly_rollup(stream: DataFrame, late: str = "1 hour", time_column: str = "ts") -> DataFrame:
    """Seven days, moving by one."""
    return _rollup(stream, F.window(time_column, WEEK, DAY), late, time_column)


def period_top(rollup: DataFrame, n: int = DEFAULTS.top_n) -> DataFrame:
    """The ``n`` statements of each period with most buffer gets.

    The rank limit is applied in every task before the shuffle, so a period
    sends at most ``n`` rows per task.
    """
    order = Window.partitionBy("period_start").orderBy(F.desc("buffer_gets"), "sql_id")
    return rollup.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)


def write_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Hand every batch to ``write(rows, batch_id)``; all that has arrived, or for good with a period ``every``."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()
    if not every:
        query.awaitTermination()
    return query


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def run_period_top(rollup: DataFrame, path: str, checkpoint: str, n: int = DEFAULTS.top_n, every: str | None = None) -> StreamingQuery:
    """Ranked rows of every period, once it is complete.

    The watermark completes a period for all its statements at once, so the batch
    that gives them out holds the whole period and its ranks are final.
    """

    def ranked(rows: DataFrame, batch_id: int) -> None:
        period_top(rows, n).write.mode("overwrite").parquet(_batch_folder(path, batch_id))

    return write_batches(rollup, ranked, checkpoint, every)


def stream_files(spark: SparkSession, path: str, glob: str, per_batch: int = 1000) -> DataFrame:
    """``(file, size)`` of newly arrived files, at most ``per_batch`` at a time; their content is not read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
    listed = reader.option("maxFilesPerTrigger", per_batch).load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"))


def run_trace_facts(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    glob: str = TRACE_GLOB,
    settings: Settings = DEFAULTS,
    per_batch: int = 1000,
    every: str | None = None,
    file: Column | None = None,
    packed: bool = False,
    kinds: Collection[str] | None = None,
) -> StreamingQuery:
    """Facts and issues of arriving traces, or packs of them, by the readers and operators for sets of files.

    Files too large to be read whole are read split by split here too, so no file is
    a value.  The driver holds the names of one batch.  All facts are written, or those of
    ``kinds``, to which ``FACT_KINDS`` of the rules must belong for their issues.
    """

    def extract(files: DataFrame, batch_id: int) -> None:
        names = [r.file for r in files.select("file").collect()]  # at most per_batch
        if not names:
            return
        session = files.sparkSession
        facts_path = f"{out.rstrip('/')}/facts/batch_id={batch_id}"
        facts = trace_facts(read_traces(session, names, glob, settings, file, packed), settings, kinds)
        facts.write.mode("overwrite").partitionBy("kind").parquet(facts_path)
        written = session.read.schema(facts.schema).parquet(facts_path)
        trace_issues(written).write.mode("overwrite").parquet(f"{out.rstrip('/')}/issues/batch_id={batch_id}")

    return write_batches(stream_files(spark, path, glob, per_batch), extract, checkpoint, every)


def run_collection(
    stream: DataFrame, ledger: str, out: str, checkpoint: str, hours: int = DEFAULTS.dedup_hours, time_column: str = "ts", every: str | None = None
) -> StreamingQuery:
    """Detected rows that the keyed ledger does not hold, which are then marked in it.

    Every batch is a run at the latest time of its rows.  Its rows are written
    before the ledger, and a batch whose folder is complete is not done again.
    """

    def collect(rows: DataFrame, batch_id: int) -> None:
        session, folder = rows.sparkSession, _batch_folder(out, batch_id)
        now = rows.agg(F.max(time_column)).first()[0]
        if now is None:
            return
        if not _is_written(session, folder):
            not_in_ledger(rows, ledger, now, hours).write.mode("overwrite").parquet(folder)
        upsert_ledger(session.read.schema(rows.schema).parquet(folder), ledger, now, hours)

    return write_batches(stream, collect, checkpoint, every)


def _is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds a finished write."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stream_texts(
    spark: SparkSession, path: str, glob: str, drop_undecodable: bool = False, file: Column | None = None, packed: bool = False
) -> TextSet:
    """Newly arrived texts of any size, or those of newly arrived packs; the checkpoint of the query is the list of files done.

    A file is one row, so one that exceeds Spark's limit for a value (2 GB) stops the
    query with an error instead of being skipped.
    """
    reader = spark.readStream.option("pathGlobFilter", glob)
    if packed:
        return TextSet(packed_texts(reader.option("lineSep", PACK_MARK).text(path), drop_undecodable, file))
    raw = reader.text(path, wholetext=True)
    file = file_path() if file is None else file
    return TextSet(raw.select(file.alias("file"), unix_newlines(clean_bytes(F.col("value"), drop_undecodable)).alias("text")))


def stream_new_traces(
    spark: SparkSession, path: str, glob: str = TRACE_GLOB, file: Column | None = None, packed: bool = False
) -> DataFrame:
    """Candidate lines of new traces; ``facts_of_lines`` reads their table."""
    texts = stream_texts(spark, path, glob, drop_undecodable=True, file=file, packed=packed)
    return candidate_lines(lines_with_followers(texts)[0])


def stream_new_reports(
    spark: SparkSession,
    path: str,
    glob: str = "*.prf",
    settings: Settings = DEFAULTS,
    file: Column | None = None,
    packed: bool = False,
) -> DataFrame:
    """Statements of new execution reports with their issues."""
    return with_issues(exec_statements(exec_blocks(stream_texts(spark, path, glob, file=file, packed=packed))), settings)


def start(df: DataFrame, path: str, checkpoint: str, every: str = DETECT_EVERY) -> StreamingQuery:
    """Run for good, appending to a table."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start(path)
    )


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process all that has arrived, then stop."""
    query = (
        df.writeStream.outputMode("append")
        .format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
