"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the number of cores.  Text queries are measured on texts
that were written beforehand, so that making the texts is not in the figure.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slowlens import build_session  # noqa: E402
from slowlens.operators import execreport as e, execrules as r, opttrace as o, optrules  # noqa: E402
from slowlens.plans import catalog, render  # noqa: E402
from slowlens.session import scratch_path  # noqa: E402
from slowlens.sources.texts import texts_of  # noqa: E402

TABLE_QUERIES = (
    "top_sql",
    "db_time",
    "sql_elapsed",
    "detect_slow_sql",
    "per_exec_metrics",
    "detect_over_thresholds",
    "exclude_statements",
    "dedup_recent",
    "eligible_ids",
    "preferred_plan",
    "literalise",
    "tuning_guide",
)


def timed(df) -> float:
    begin = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    seconds: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # start-up
    for name in TABLE_QUERIES:
        seconds[name] = timed(catalog.QUERIES[name](spark, sf_dir))

    def stored(df, label):
        path = scratch_path(spark, label)
        df.repartition(2 * int(cpus)).write.parquet(path)
        return texts_of(spark.read.parquet(path))

    reports = stored(render.exec_report_texts(spark, sf_dir), "reports")
    traces = stored(render.trace_texts(spark, sf_dir), "traces")
    statements = e.exec_statements(e.exec_blocks(reports))
    seconds["exec_statements"] = timed(statements)
    seconds["exec_issues"] = timed(r.exec_issues(statements))
    facts_path = scratch_path(spark, "facts")
    begin = time.perf_counter()
    o.trace_facts(traces).write.partitionBy("kind").parquet(facts_path)
    seconds["trace_facts"] = round(time.perf_counter() - begin, 3)
    facts = spark.read.parquet(facts_path)
    seconds["access_methods"] = timed(o.access_methods(facts))
    seconds["trace_issues"] = timed(optrules.trace_issues(facts))
    lines = traces.texts.selectExpr("sum(length(text) - length(replace(text, '\n', '')) + 1) n").first().n
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "trace_lines_per_sec": int(lines / seconds["trace_facts"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
