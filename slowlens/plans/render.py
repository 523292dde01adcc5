"""Text and documents made from the workload tables.

The text operators need text: reports and traces are written out from table
rows here, in the shapes of the real formats, and read back by the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slowlens.functions.shape import computed
from slowlens.plans.views import view
from slowlens.sinks.documents import NO_NAME, write_packs
from slowlens.sources.texts import TextSet, texts_of


def _text(*parts) -> Column:
    """Concatenation of columns and plain strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def line(*parts) -> Column:
    return F.array(_text(*parts))


def when_lines(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.concat(*lines)).otherwise(F.array().cast("array<string>"))


def _hundredths(col: Column) -> Column:
    return (col.cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").cast("string")


BIND_CODES = ("1", "2", "12", "99")
#: Reports of up to so many blocks together, some hundred megabytes, are written as plain text.
PLAIN_BLOCKS = 500_000


def exec_block_rows(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """``(file, block_no, block)``: one report block per order, all of a report in one task; ``named`` leaves no file null."""
    c = F.col
    # rows are small, texts are not: spread the rows before texts are made; a fixed number of tasks,
    # as the size of the rows says little about the work that parsing their texts takes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    file = _text("run", c("file_no"), "_trace.prf")
    file = F.coalesce(file, F.lit(NO_NAME)) if named else file
    src = view(spark, sf_dir, "exec_src").withColumn("file", file).repartition(tasks, "file")
    cpu, elapsed = _hundredths(c("fetch_cpu_cs")), _hundredths(c("fetch_elapsed_cs"))
    codes = F.array(*[F.lit(x) for x in BIND_CODES])
    binds = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c("bind_count")),
            lambda i: F.array(
                _text(" bind ", i, ": "),
                _text("  dty=", F.get(codes, i)),
                F.lit("  value=first"),
                _text('  value="', c("bind_value"), " ", i, '"'),
            ),
        )
    )
    figures = [c("fetch_disk"), "  ", c("fetch_query"), "  ", c("fetch_current"), "  ", c("fetch_rows")]
    total = c("parse_count") + c("execute_count") + c("fetch_count")
    block = F.concat_ws(
        "\n",
        _text("select /* ", c("sql_id"), " */ *"),
        _text("  from t where x = ", c("o_orderkey")),
        _text("sql_id='", c("sql_id"), "'"),
        _text(""),
        _text("call     count       cpu    elapsed       disk      query    current        rows"),
        _text("------- ------  -------- ---------- ---------- ---------- ----------  ----------"),
        _text("Parse   ", c("parse_count"), "  0.01  0.0", c("parse_count"), "  0  ", c("parse_count"), "  0  0"),
        _text("Execute ", c("execute_count"), "  0.0", c("execute_count"), "  0.02  ", c("execute_count"), "  7  ", c("execute_count"), "  3"),
        _text("Fetch   ", c("fetch_count"), "  ", cpu, "  ", elapsed, "  ", *figures),
        _text("total   ", total, "  ", cpu, "  ", elapsed, "  ", *figures),
        _text(""),
        _text("Rows     Row Source Operation"),
        _text("-------  ---------------------------------------------------"),
        _text(c("plan_rows"), "  ", c("plan_op"), " T", c("o_orderkey")),
        _text("     ", c("fetch_rows"), "   SORT ORDER BY (cr=", c("fetch_query"), ")  "),
        _text(""),
        _text("Elapsed times include waiting on following events:"),
        _text("  Event waited on                             Times   Max. Wait"),
        _text("  ----------------------------------------   Waited  ----------"),
        _text("  ", c("wait_event"), "  ", c("times_waited"), "  ", _hundredths(c("max_wait_cs"))),
        _text("  log file sync  ", c("execute_count"), "  0.25  1.00"),
        _text(""),
        when_lines(c("bind_count") > 0, line("BINDS #1:"), binds, line("EXEC #1:c=0,e=1"), line("  value=\"not a bind\"")),
    )
    return src.select("file", "block_no", block.alias("block"))


def exec_report_texts(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """``(file, text)``; a report holds the blocks of a hundred orders.  Every
    other report has the line ends of the other convention."""
    rule = "\n" + "*" * 80 + "\n"
    listed = F.array_sort(F.collect_list(F.struct("block_no", "block"))).alias("b")
    files = exec_block_rows(spark, sf_dir, named).groupBy("file").agg(listed)
    text = F.array_join(F.transform("b", lambda s: s["block"]), rule)
    return files.select(
        "file",
        F.when(F.pmod(F.hash("file"), F.lit(2)) == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).alias("text"),
    )


def write_exec_reports(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The texts of ``exec_report_texts`` in packs; those of a large set are compressed, see ``read_packs``."""
    large = view(spark, sf_dir, "exec_src").count() > PLAIN_BLOCKS
    write_packs(exec_report_texts(spark, sf_dir, named=True), path, per_pack=200, compression="gzip" if large else None)


def exec_reports(spark: SparkSession, sf_dir: str) -> TextSet:
    return texts_of(exec_report_texts(spark, sf_dir))


def trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, text)``: one optimizer trace per part."""
    # rows are small, texts are not: spread the rows before texts are made
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = view(spark, sf_dir, "trace_src").repartition(tasks, "trace_no")
    c = F.col
    na = lambda flag: F.when(flag, "  (NOT ANALYZED)").otherwise("")
    stars = line("***************************************")
    gap = when_lines(c("two_tables"), line(""), line(" \t"))
    samples = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(1)), lambda i: i < c("sampling_lines")),
            lambda i: F.array(
                _text("** Dynamic sampling updated table stats.: blocks=", i),
                _text("** Dynamic sampling updated table stats.: blocks=", i),
            ),
        )
    )
    lines = F.concat_ws(
        "\n",
        _text("Trace file /diag/", c("file")),
        _text("Oracle Database 19c Enterprise Edition Release 19.0.0.0.0 - Production"),
        _text("Node name:\tnode", c("instance_no")),
        _text("Instance name: INST", c("instance_no")),
        _text("Database name: DB", c("instance_no"), " "),
        _text("Database role: PRIMARY"),
        _text("Instance name: LATER"),
        stars,
        _text("----- Current SQL Statement for this session (sql_id=", c("sql_id"), ") -----"),
        _text("select /* ", c("comment"), " */ * from ", c("table_name")),
        _text(" where c1 = 'a = b'  "),
        _text("----- Parser State -----"),
        stars,
        _text("Legend"),
        _text("CBQT - cost-based query transformation"),
        _text("ORE - CBQT OR-Expansion"),
        stars,
        _text("PARAMETERS USED BY THE OPTIMIZER"),
        _text("********************************"),
        _text("  *************************************"),
        _text("  PARAMETERS WITH ALTERED VALUES"),
        _text("  ******************************"),
        _text("Compilation Environment Dump"),
        _text("statistics_level                    = basic"),
        _text("statistics_level                    = ", c("statistics_level")),
        _text("Bug Fix Control Environment"),
        _text("not_a_parameter                     = 1"),
        _text(""),
        _text("  *************************************"),
        _text("  PARAMETERS WITH DEFAULT VALUES"),
        _text("  ******************************"),
        _text("Compilation Environment Dump"),
        _text("optimizer_mode                      = all_rows"),
        _text("cpu_count                           = ", c("cpu_count")),
        _text("_optimizer_skip_scan_enabled        = true"),
        _text("_other_parameter                    = ", c("trace_no")),
        when_lines(c("two_tables"), line("_second_parameter                   = ", c("cpu_count"))),
        _text("fix  3834770 = 1"),
        _text(""),
        _text("-----------------------------"),
        _text("SYSTEM STATISTICS INFORMATION"),
        _text("-----------------------------"),
        _text("  Using ", c("stats_type"), " Stats"),
        _text("  CPUSPEEDNW: ", c("cpu_speed"), " millions instructions/sec (default is 1000)"),
        F.when(c("mbrc_unset"), line("  MBRC:       NO VALUE blocks (default is 8)")).otherwise(
            line("  MBRC:       16 blocks (default is 8)")
        ),
        _text(""),
        stars,
        _text("BASE STATISTICAL INFORMATION"),
        _text("***********************"),
        _text("Table Stats::"),
        _text("  Table: ", c("table_name"), "  Alias:  A", na(c("not_analyzed"))),
        gap,
        _text("  #Rows: ", c("table_rows"), "  SSZ: 0  #Blks:  ", c("table_blocks"), "  AvgRowLen:  100.00  NEB: 0"),
        when_lines(
            c("two_tables"),
            line("  Table: ", c("table2_name"), "  Alias:  B"),
            line("  #Rows: 7  SSZ: 0  #Blks:  3  AvgRowLen:  12.50  NEB: 0"),
            line("  Table: ", c("table_name"), "  Alias:  A"),
            line("  #Rows: 1  SSZ: 0  #Blks:  1  AvgRowLen:  1.00  NEB: 0"),
        ),
        _text("Index Stats::"),
        _text("  Index: ", c("index_name"), "  Col#: 1 2", na(c("index_not_analyzed"))),
        gap,
        _text("  LVLS: 1  #LB: 25  #DK: 100  LB/K: 1.00  DB/K: 2.50  CLUF: ", c("clustering_factor"), ".00  NRW: ",
             c("index_rows"), ".00 SSZ: 0.00"),
        _text("Access path analysis for ", c("table_name")),
        stars,
        _text("SINGLE TABLE ACCESS PATH "),
        _text("  Column (#2): C1(NUMBER)"),
        _text("    AvgLen: 3 NDV: 1 Nulls: 0 Density: 1"),
        _text("  Column (#2): C1(NUMBER)", F.when(c("column_no_stats"), "  NO STATISTICS (using defaults)").otherwise("")),
        gap,
        _text("    AvgLen: 5 NDV: ", c("ndv"), " Nulls: 2 Density: 0.25"),
        gap,
        when_lines(c("histogram").isNotNull(), line("    Histogram: ", c("histogram"), "  #Bkts: 10  UncompBkts: 20  EndPtVals: 5")),
        samples,
        _text("  Table: ", c("table_name"), "  Alias: A"),
        _text("    Card: Original: 10.000000rsel = 0.5   Rounded: ", c("cardinality"), "  Computed: 1.0"),
        _text("  Scan IO  Cost (Disk) =   ", c("scan_cost"), ".500000"),
        _text("  Scan CPU Cost (Disk) =   7121.440000"),
        _text("  Total Scan IO  Cost  =   ", c("scan_cost"), ".750000 (scan (Disk))"),
        _text("  Total Scan CPU  Cost =   7121.440000 (scan (Disk))"),
        _text("  Access Path: TableScan"),
        _text("    Cost:  ", c("scan_cost"), ".000000  Resp: ", c("scan_cost"), ".000000  Degree: 0"),
        _text("      Cost_io: ", c("scan_cost"), ".250000  Cost_cpu: 7121"),
        _text("      Resp_io: 2.000000  Resp_cpu: 7121"),
        _text("    Index: IGNORED"),
        _text("  Access Path: index (RangeScan)"),
        _text("    Index: ", c("index_name")),
        _text("    resc_io: 1.500000  resc_cpu: 200"),
        _text("    ix_sel: 0.250000  ix_sel_with_filters: 0.500000 "),
        when_lines(c("nl_line"), line("    NL Join : Cost: ", c("index_cost"), ".125000  Resp: 1.000000  Degree: 2")),
        _text("  Access Path: index (RangeScan)"),
        _text("    Cost: ", c("index_cost"), ".000000  Resp: ", c("index_cost"), ".000000  Degree: 1"),
        F.when(
            c("scan_cost") <= c("index_cost"),
            F.concat(
                line("  Best:: AccessPath: TableScan"),
                gap,
                line("         Cost: ", c("scan_cost"), ".000000  Degree: 1  Resp: ", c("scan_cost"),
                     ".000000  Card: 10.000000  Bytes: 0.000000"),
            ),
        ).otherwise(
            F.concat(
                line("  Best:: AccessPath: ", F.when(c("two_tables"), "IndexFFS").otherwise("IndexRange")),
                gap,
                line("  Index: ", c("index_name")),
                gap,
                line("         Cost: ", c("index_cost"), ".000000  Degree: 1  Resp: ", c("index_cost"),
                     ".000000  Card: 10.000000  Bytes: 0.000000"),
            )
        ),
        when_lines(
            c("two_tables"),
            line("Access path analysis for ", c("table2_name")),
            line("SINGLE TABLE ACCESS PATH "),
            line("  Access Path: TableScan"),
            line("    Cost:  3.500000  Resp: 3.500000  Degree: 0"),
        ),
        when_lines(c("nl_line"), line("Access path analysis for W", c("trace_no"))),
        _text(""),
        _text("OPTIMIZER STATISTICS AND COMPUTATIONS"),
        _text("  Access Path: TableScan"),
        _text("    Cost:  1.000000  Resp: 1.000000  Degree: 0"),
        _text("Join order[1]:  ", c("table_name"), "[A]#0", F.when(c("two_tables"), F.concat(F.lit("  "), c("table2_name"), F.lit("[B]#1"))).otherwise("")),
        _text("Best so far:  Table#: 0  cost: 900.500000  card: 1.000000  bytes: 12.000000"),
        _text("JOIN ORDER[2]:  ", c("table2_name"), "[B]#1"),
        _text("Best so far:  Table#: 1  cost: ", c("index_cost"), ".500000  card: ", c("cardinality"), ".000000  bytes: 12.000000"),
        _text("Number of join permutations tried: ", c("permutations")),
        _text("Number of join permutations tried: 99"),
        _text("Predicate Move-Around (PM)"),
        _text("Predicate Move-Around (PM)"),
        _text("CBQT bypassed for query block SEL$1 (#0): no complex view."),
        _text("CBQT: Considering view merge"),
        _text("TE: Checking validity of table expansion"),
        _text("SU: ", F.when(c("unnested"), "Unnested subquery").otherwise("Considering subquery unnesting")),
        when_lines(c("unnested"), line("CVM: Considering view merge in query block SEL$2")),
        when_lines(c("two_tables"), line("ST: not valid since star transformation is off")),
        _text("OJE: Begin: find best directive"),
        _text("  JE:   Considering join elimination"),
        _text("LORE: Trying or-Expansion"),
        _text("ORE: bypassed - No valid predicate"),
        _text("query block SEL$1 #1 transformed"),
        _text(""),
    )
    return computed(src, text=lines).select("file", "text")


def traces(spark: SparkSession, sf_dir: str) -> TextSet:
    return texts_of(trace_texts(spark, sf_dir))


def awr_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per statement.

    Counters are summed per statement and snapshot first, so the array of a
    statement is as long as the number of snapshots kept, not its row count.
    """
    stat = view(spark, sf_dir, "awr_stat_src")
    plan = view(spark, sf_dir, "awr_plan_src")
    c = F.col
    stats = stat.groupBy("sql_id").agg(
        F.reverse(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "snap_id",
                        F.struct(
                            F.lpad(c("snap_id").cast("string"), 6, "0").alias("snap_time"),
                            F.lit("1").alias("plan_hash_value"),
                            "executions_delta",
                            "avg_elapsed_sec",
                            "avg_cpu_sec",
                            c("avg_buffer_gets").cast("string").alias("avg_buffer_gets"),
                            c("avg_disk_reads").cast("string").alias("avg_disk_reads"),
                            c("avg_rows").cast("string").alias("avg_rows"),
                        ).alias("s"),
                    )
                )
            )
        ).alias("l")
    ).select("sql_id", F.transform("l", lambda e: e["s"]).alias("stats"))
    lines = F.concat(
        line("| Id | Operation | Rows | Cost |"),
        line("-----"),
        when_lines(c("has_full_scan"), line("|  1 |  TABLE ACCESS FULL | 10 | 2 |")),
        when_lines(c("has_ffs"), line("|  2 |  INDEX FAST FULL SCAN | 10 | 2 |")),
        when_lines(c("has_partition_all"), line("|  3 |  PARTITION RANGE ALL | 10 | 2 |")),
        when_lines(c("has_sort"), line("|  4 |  SORT GROUP BY | 10 | 2 |")),
        when_lines(c("has_hash_join"), line("|  5 |  HASH JOIN | 10 | 2 |")),
        when_lines(
            c("has_nl"),
            line("|  6 |  NESTED LOOPS | 5 | 2 |"),
            line("|  7 |  TABLE ACCESS BY INDEX ROWID | ", c("nl_rows_k"), "K | 2 |"),
        ),
        line("-----"),
    )
    plans = computed(
        plan,
        sql_text=_text("select /* ", c("name"), " */ 1\nfrom dual"),
        plan_hash_value=F.lit("1"),
        source=F.lit(None).cast("string"),
        plan=lines,
    )
    return plans.join(stats, "sql_id", "left").select(
        "sql_id", "sql_text", "plan_hash_value", "source", "plan", "stats"
    )
