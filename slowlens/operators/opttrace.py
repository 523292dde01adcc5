"""Optimizer traces: from text to relations.

``trace_facts`` reads every text once.  It keeps the lines that any extractor
needs, adds the section or access block a line belongs to, and names the kind
of fact.  All extractors work on that table, which is a small part of the text
and can be written once (``sinks.write_trace_facts``, partitioned by kind).

Positions are line numbers; a block is known by the line it starts on.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.ordered import running_state
from slowlens.functions.text import extract, strip
from slowlens.session import scratch_path
from slowlens.sources.texts import TextSet, lines_with_followers

# ---------------------------------------------------------------------------
# Line patterns of the trace format.
# ---------------------------------------------------------------------------
DB_LABELS = {
    "oracle_version": r"Oracle Database (.+?)$",
    "instance_name": r"Instance name:\s*(\S+)",
    "database_name": r"Database name:\s*(\S+)",
    "database_role": r"Database role:\s*(\S+)",
    "node_name": r"Node name:\s*(\S+)",
}
SQL_HEADER = r"----- Current SQL Statement for this session \(sql_id=(\w+)\) -----"
SQL_SECTION = r"(?s)" + SQL_HEADER + r"\n(.*?)(?=----- |\n\*)"
STARS = r"^\*{5,}"
SYSTEM_SECTION = "SYSTEM STATISTICS INFORMATION"
STATS_MODE = r"Using\s+(NOWORKLOAD|WORKLOAD)\s+Stats"
STATS_ITEM = r"(\w+):\s+(\S+)\s+(.*?)\(default is (\S+)\)"
ALTERED_SECTION = r"PARAMETERS WITH ALTERED VALUES\s*$"
DEFAULT_SECTION = r"PARAMETERS WITH DEFAULT VALUES\s*$"
SECTION_RULE = r"^\s*\*+\s*$"
SECTION_DUMP = "Compilation Environment Dump"
ALTERED_END = "Bug Fix Control Environment"
DEFAULT_END = r"^\s*Table:|^SYSTEM STATISTICS"
PARAMETER = r"^\s*(\S+)\s+=\s+(.+)$"
TABLE_NAME = r"Table:\s+(\S+)\s+Alias:\s+(\S+)(.*)$"
TABLE_STATS = r"^\s+#Rows:\s+(\d+).*?#Blks:\s+(\d+)\s+AvgRowLen:\s+([\d.]+)"
INDEX_NAME = r"Index:\s+(\S+)\s+Col#:\s*([\d\s]*?)(?:\s*\(.*?\))?\s*$"
INDEX_STATS = (
    r"^\s*LVLS:\s+(\d+)\s+#LB:\s+(\d+)\s+#DK:\s+(\d+)\s+LB/K:\s+([\d.]+)"
    r"\s+DB/K:\s+([\d.]+)\s+CLUF:\s+([\d.]+)\s+NRW:\s+([\d.]+)"
)
COLUMN_NAME = r"Column\s+\(#(\d+)\):\s+(\S+)\((\w+)\)(.*)$"
COLUMN_STATS = r"^\s+AvgLen:\s+(\d+)\s+NDV:\s+(\d+)\s+Nulls:\s+(\d+)\s+Density:\s+([\d.]+)"
HISTOGRAM = r"^\s+Histogram:\s+(\S+)\s+#Bkts:\s+(\d+)(?:\s+UncompBkts:\s+(\d+))?(?:\s+EndPtVals:\s+(\d+))?"
NOT_ANALYZED = r"(?i)NOT ANALYZED"
NO_STATISTICS = r"(?i)NO STATISTICS"
BLOCK_START = r"Access path analysis for (\S+)"
BLOCK_END = "OPTIMIZER STATISTICS"
CARDINALITY = r"Card: Original:\s+([\d.]+)(?:rsel\s*=\s*[\d.eE+-]+\s+)?\s*Rounded:\s+(\d+)"
ACCESS_PATH = r"^\s*Access Path:\s+(.+)"
INDEX_LINE = r"^\s*Index:\s+(\S+)"
RESOURCE_COST = r"^\s*resc_io:\s+([\d.]+)\s+resc_cpu:\s+(\d+)"
SELECTIVITY = r"^\s*ix_sel:\s+([\d.eE+-]+)\s+ix_sel_with_filters:\s+([\d.eE+-]+)"
COST_LINE = r"^\s*Cost:\s+([\d.]+)\s+Resp:\s+([\d.]+)\s+Degree:\s+(\d+)"
NL_COST = r"^\s*NL Join\s*:\s*Cost:\s+([\d.]+)\s+Resp:\s+([\d.]+)\s+Degree:\s+(\d+)"
COST_DETAIL = r"^\s*Cost_io:\s+([\d.]+)\s+Cost_cpu:\s+(\d+)"
SCAN_COSTS = {
    "scan_io_cost": r"^\s*Scan IO\s+Cost\s+\(Disk\)\s*=\s+([\d.]+)",
    "scan_cpu_cost": r"^\s*Scan CPU Cost\s+\(Disk\)\s*=\s+([\d.]+)",
    "total_scan_io_cost": r"^\s*Total Scan IO\s+Cost\s*=\s+([\d.]+)",
    "total_scan_cpu_cost": r"^\s*Total Scan CPU\s+Cost\s*=\s+([\d.]+)",
}
BEST_PATH = r"Best::\s+AccessPath:\s+(\S+)\s*$"
BEST_COST = r"^\s+Cost:\s+([\d.]+)\s+Degree:\s+(\d+)\s+Resp:\s+([\d.]+)\s+Card:\s+([\d.]+)"
JOIN_ORDER = r"(?i)Join order\[(\d+)\]:\s+(.+?)$"
JOIN_TABLE = r"(\w+)\["
BEST_JOIN = r"Best so far:\s+Table#:\s+(\d+)\s+cost:\s+([\d.]+)\s+card:\s+([\d.]+)\s+bytes:\s+([\d.]+)"
PERMUTATIONS = r"Number of join permutations tried:\s+(\d+)"
SAMPLING = r"(?i)dynamic sampling\s+.*?(?:table|index)\s+.*"
PREDICATE_MOVE = "Predicate Move-Around (PM)"
# kind, name, pattern of the detail
TRANSFORMATIONS = (
    ("CBQT", "Cost-Based Query Transformation", r"\bCBQT[:\s]+.*"),
    ("TE", "Table Expansion", r"\bTE:\s+.*"),
    ("SU", "Subquery Unnesting", r"\bSU:\s+.*"),
    ("JE", "Join Elimination", r"\bJE:\s+.*"),
    ("CVM", "Complex View Merging", r"\bCVM:\s+.*"),
    ("ST", "Star Transformation", r"\bST:\s+.*"),
    ("ORE", "Or Expansion", r"\bORE:\s+.*"),
    ("GENERIC", "Query Block Transformation", r"(?i)query block .+ #\d+\s*transformed"),
)
# abbreviation lists at the head of a trace: "CBQT - cost-based ..."
LEGEND_LINE = r"^\s*[A-Za-z/]+ - "

# Phrases without which a line cannot match the patterns of its
# kind.  Looking for a phrase is much cheaper than a pattern.
PHRASES = {
    "db": ("Oracle Database ", "Instance name:", "Database name:", "Database role:", "Node name:"),
    "system": ("WORKLOAD Stats", "(default is "),
    "table": ("Alias:",),
    "index": ("Col#:",),
    "column": ("Column",),
    "access": ("Access", "Index:", "Cost", "resc_io:", "ix_sel:", "Card: Original:"),
    "join": ("Best so far:", "join permutations tried:"),
    "transformation": ("E:", "U:", "M:", "T:", "CBQT", "Predicate Move-Around (PM)"),
}
# the same for patterns that ignore case: a character they need, and a phrase in lower case
LOWER_PHRASES = {"join": ("[", "join order["), "sampling": (" ", "dynamic sampling"), "transformation": ("#", "transformed")}
TAG_PATTERNS = tuple(p for _, _, p in TRANSFORMATIONS if not p.startswith("(?i)"))
ACCESS_PATTERNS = (
    BLOCK_START,
    CARDINALITY,
    ACCESS_PATH,
    INDEX_LINE,
    RESOURCE_COST,
    SELECTIVITY,
    COST_LINE,
    NL_COST,
    COST_DETAIL,
    BEST_PATH,
    *SCAN_COSTS.values(),
)


def _may_be(line: Column, kind: str) -> Column:
    """Whether a line can be of a kind at all, by its phrases."""
    tests = [line.contains(p) for p in PHRASES.get(kind, ())]
    if kind in LOWER_PHRASES:
        character, phrase = LOWER_PHRASES[kind]
        tests.append(line.contains(character) & F.lower(line).contains(phrase))
    return reduce(Column.__or__, tests)


#: Kinds whose facts lie in a block or section, and the states that tell it.
PLACED_KINDS = {"access": ("block",), "parameter": ("altered", "default"), "system": ("system",)}


def candidate_lines(lines: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """``lines`` that may be facts, one row per possible ``kind``, and the lines
    that open or close a section or block, as kind ``marker``.

    Looks at a line and its followers only, so it needs no shuffle.  With ``kinds``
    only theirs are looked for, and markers of their blocks and sections.
    """
    line, next1 = F.col("line"), F.col("next1")

    def any_of(patterns) -> Column:
        return line.rlike("|".join(f"(?:{p})" for p in patterns))

    tests = {
        "db": any_of(DB_LABELS.values()),
        "system": any_of((STATS_MODE, STATS_ITEM)),
        "table": line.rlike(TABLE_NAME) & next1.rlike(TABLE_STATS),
        "index": line.rlike(INDEX_NAME) & next1.rlike(INDEX_STATS),
        "column": line.rlike(COLUMN_NAME) & next1.rlike(COLUMN_STATS),
        "access": any_of(ACCESS_PATTERNS),
        "join": line.rlike(JOIN_ORDER) | any_of((BEST_JOIN, PERMUTATIONS)),
        "sampling": line.rlike(SAMPLING),
        "transformation": line.contains(PREDICATE_MOVE)
        | (any_of(TAG_PATTERNS) & ~line.rlike(LEGEND_LINE))
        | line.rlike(TRANSFORMATIONS[-1][2]),
    }
    rule, system = line.contains("*****"), line.contains("SYSTEM STATISTICS")
    markers = {
        "access": line.contains(BLOCK_END) | line.contains("Access path analysis for "),
        "parameter": line.contains("PARAMETERS WITH ")
        | (rule & next1.contains("PARAMETERS WITH DEFAULT"))
        | line.contains(ALTERED_END)
        | system
        | (line.contains("Table:") & line.rlike(DEFAULT_END)),
        "system": (rule & line.rlike(STARS)) | system,
    }
    found = {"parameter": line.contains("=") & line.rlike(PARAMETER)}
    found |= {kind: _may_be(line, kind) & test for kind, test in tests.items()}
    asked = [kind for kind in found if kinds is None or kind in kinds]
    marker = [markers[kind] for kind in PLACED_KINDS if kind in asked]
    # a plain array with nulls stays in generated code, removing them inside the array would not
    each = F.array(
        *([F.when(reduce(Column.__or__, marker), "marker")] if marker else []),
        *[F.when(found[kind], kind) for kind in asked],
    )
    return lines.select("file", "line_no", "line", "next1", "next2", F.explode(each).alias("kind")).filter(
        "kind is not null"
    )


def _states() -> tuple[dict[str, Column], dict[str, Column]]:
    """Markers that open and close blocks and sections.

    A closed state is a struct of nulls, so that it hides an older open one.
    """
    line, next1, next2, no = F.col("line"), F.col("next1"), F.col("next2"), F.col("line_no")
    here = F.struct(no.alias("at"))
    closed = F.struct(F.lit(None).cast("bigint").alias("at"))
    dump = next1.rlike(SECTION_RULE) & next2.startswith(SECTION_DUMP)
    altered = line.rlike(ALTERED_SECTION) & dump
    default = line.rlike(DEFAULT_SECTION) & dump
    altered_end = line.contains(ALTERED_END) | (line.rlike(r"\*{5,}\s*$") & next1.rlike(r"^\s*PARAMETERS WITH DEFAULT"))
    system = line.contains(SYSTEM_SECTION) & next1.rlike(r"^\s*-+")
    block = F.struct(no.alias("at"), F.regexp_extract(line, BLOCK_START, 1).alias("table"))
    no_block = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("table"))
    lasts = {
        "block": F.when(line.rlike(BLOCK_START), block).when(line.contains(BLOCK_END), no_block),
        "altered": F.when(altered, here).when(altered_end, closed),
        "default": F.when(default, here).when(line.rlike(DEFAULT_END), closed),
        "system": F.when(system, here).when(line.rlike(STARS), closed),
    }
    firsts = {
        "first_altered": F.when(altered, no),
        "first_default": F.when(default, no),
        "first_system": F.when(system, no),
    }
    # most rows are no markers: look at their text no further
    only = lambda e: F.when(F.col("kind") == "marker", e)
    return {n: only(e) for n, e in lasts.items()}, {n: only(e) for n, e in firsts.items()}


def _with_states(whole: DataFrame, long: DataFrame | None, settings: Settings, kinds: Collection[str] | None) -> DataFrame:
    lasts, firsts = _states()
    needed = {n for kind, names in PLACED_KINDS.items() if kinds is None or kind in kinds for n in names}
    if kinds is not None:
        types = {n: "struct<at:bigint,table:string>" if n == "block" else "struct<at:bigint>" for n in lasts}
        absent = {n: t for n, t in (types | {n: "bigint" for n in firsts}).items() if n.removeprefix("first_") not in needed}
        none = [F.lit(None).cast(t).alias(n) for n, t in absent.items()]
        whole = whole.select("*", *none)
        long = None if long is None else long.select("*", *none)
        lasts, firsts = {n: e for n, e in lasts.items() if n in needed}, {n: e for n, e in firsts.items() if n not in absent}
    if not needed:
        return whole if long is None else whole.unionByName(long)
    # A whole file is bounded by whole_file_bytes, so it may be one window group.
    # A range frame: rows of one line see its marker, in whatever order they come.
    w = Window.partitionBy("file").orderBy("line_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = whole.select(
        "*",
        *[F.last(e, ignorenulls=True).over(w).alias(n) for n, e in lasts.items()],
        *[F.first(e, ignorenulls=True).over(w).alias(n) for n, e in firsts.items()],
    )
    if long is None:
        return out
    return out.unionByName(running_state(long, "file", "line_no", lasts, firsts, settings.slice_lines))


def trace_facts(traces: TextSet, settings: Settings = DEFAULTS, kinds: Collection[str] | None = None) -> DataFrame:
    """The fact table of a trace set, see ``facts_of_lines``; all facts, or those of ``kinds``.

    Candidate lines of large traces are looked for and written once, then read slice by slice.
    Whole texts are dealt by file before they are cut, as their candidates come with two lines each.
    """
    if kinds is None or any(kind in PLACED_KINDS for kind in kinds):
        # a fixed number of tasks: shuffled texts compress so well that their size says little about the work
        tasks = int(traces.texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        traces = replace(traces, texts=traces.texts.repartition(tasks, "file"))
    whole, long = lines_with_followers(traces, settings)
    if long is not None:
        long = candidate_lines(long, kinds)
        spark, schema = long.sparkSession, long.schema
        path = scratch_path(spark, "candidate-lines")
        long.write.mode("errorifexists").parquet(path)
        long = spark.read.schema(schema).parquet(path)
    return facts_of_lines(candidate_lines(whole, kinds), long, settings, kinds)


def facts_of_lines(
    whole: DataFrame, long: DataFrame | None = None, settings: Settings = DEFAULTS, kinds: Collection[str] | None = None
) -> DataFrame:
    """``(file, line_no, line, next1, next2, kind, block_at, block_table, section)``
    of candidate lines.

    Access facts lie in a block, parameters and system statistics in the first
    section of their sort.  With ``kinds`` the lines are candidates for these: blocks are
    told where access facts are among them, sections where parameters are, and without a kind
    that has a place lines of whole texts are not shuffled.
    """
    lines = _with_states(whole, long, settings, kinds)
    section = F.when(F.col("altered.at") == F.col("first_altered"), "altered").when(
        F.col("default.at") == F.col("first_default"), "default"
    )
    kind = F.col("kind")
    placed = (
        F.when(kind == "marker", False)
        .when(kind == "access", F.col("block.at").isNotNull())
        .when(kind == "parameter", section.isNotNull())
        .when(kind == "system", F.coalesce(F.col("system.at") == F.col("first_system"), F.lit(False)))
        .otherwise(True)
    )
    return lines.filter(placed).select(
        "file",
        "line_no",
        "line",
        "next1",
        "next2",
        "kind",
        F.col("block.at").alias("block_at"),
        F.col("block.table").alias("block_table"),
        section.alias("section"),
    )


def _of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def _group(col: str, pattern: str, n: int, kind: str) -> Column:
    return F.regexp_extract(col, pattern, n).try_cast(kind)


# --- database, statement, system statistics, parameters ----------------------


def trace_db_info(facts: DataFrame) -> DataFrame:
    """First value of each label per file."""
    line = F.col("line")
    return (
        _of(facts, "db")
        .groupBy("file")
        .agg(
            *[
                F.min_by(strip(extract(line, p)), F.when(line.rlike(p), F.col("line_no"))).alias(name)
                for name, p in DB_LABELS.items()
            ]
        )
    )


def trace_sql(traces: TextSet) -> DataFrame:
    """``(file, sql_id, sql_text)``: the first statement of each file."""
    text = F.col("text")
    whole = traces.texts.filter(text.rlike(SQL_SECTION)).select(
        "file",
        F.regexp_extract(text, SQL_SECTION, 1).alias("sql_id"),
        strip(F.regexp_extract(text, SQL_SECTION, 2)).alias("sql_text"),
    )
    if traces.long_lines is None:
        return whole
    return whole.unionByName(_sql_of_long_files(traces.long_lines))


def _sql_of_long_files(lines: DataFrame) -> DataFrame:
    """Lines between the first header and the next rule, collected per file.

    Only the lines of one statement are collected; the bounds are one row per
    long file.
    """
    line, no = F.col("line"), F.col("line_no")
    heads = (
        lines.filter(line.rlike(SQL_HEADER + r"\z"))
        .groupBy("file")
        .agg(
            F.min("line_no").alias("_head"),
            F.min_by(F.regexp_extract(line, SQL_HEADER, 1), no).alias("sql_id"),
        )
    )
    # a rule with stars ends the text only from the second line on
    marks = lines.filter(line.contains("----- ") | line.startswith("*")).select("file", no.alias("_mark"), line.alias("_line"))
    ends = (
        marks.join(heads.select("file", "_head"), "file")
        .filter((F.col("_mark") > F.col("_head")) & (F.col("_line").contains("----- ") | (F.col("_mark") > F.col("_head") + 1)))
        .groupBy("file")
        .agg(F.min_by(F.struct("_mark", "_line"), "_mark").alias("_end"))
    )
    spans = heads.join(ends, "file")
    inner = (
        lines.join(spans, "file")
        .filter((no > F.col("_head")) & (no < F.col("_end._mark")))
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_rows"))
    )
    rows = F.coalesce(F.transform("_rows", lambda r: r["line"]), F.array().cast("array<string>"))
    tail = F.substring_index("_end._line", "----- ", 1)
    last = F.when(F.col("_end._line").contains("----- "), F.array(tail)).otherwise(F.array().cast("array<string>"))
    return spans.join(inner, "file", "left").select(
        "file", "sql_id", strip(F.array_join(F.concat(rows, last), "\n")).alias("sql_text")
    )


def trace_system_stats(facts: DataFrame) -> DataFrame:
    """``(file, item, value, unit, default_value, is_default)``; last per item.

    The mode is the item ``stats_type`` with no default.
    """
    line, no = F.col("line"), F.col("line_no")

    def row(order, item, value, unit=None, default=None):
        default = F.lit(None).cast("string") if default is None else default
        unit = F.lit(None).cast("string") if unit is None else unit
        return F.struct(
            order.alias("order"),
            item.alias("item"),
            value.alias("value"),
            unit.alias("unit"),
            default.alias("default_value"),
            F.when(default.isNotNull(), (value == default) | (value == "NO")).alias("is_default"),
        )

    parts = [F.regexp_extract(line, STATS_ITEM, i) for i in (1, 2, 3, 4)]
    mode = F.regexp_extract(line, STATS_MODE, 1)
    found = F.array_compact(
        F.array(
            F.when(line.rlike(STATS_ITEM), row(no, parts[0], parts[1], strip(parts[2]), parts[3])),
            # the first mode counts, the last of all other items
            F.when(line.rlike(STATS_MODE), row(-no, F.lit("stats_type"), mode)),
        )
    )
    last = F.max_by(F.struct("s.value", "s.unit", "s.default_value", "s.is_default"), "s.order").alias("s")
    return (
        _of(facts, "system")
        .select("file", F.explode(found).alias("s"))
        .groupBy("file", F.col("s.item").alias("item"))
        .agg(last)
        .select("file", "item", "s.*")
    )


def trace_params(facts: DataFrame) -> DataFrame:
    """``(file, section, name, value)``; a repeated name has its last value."""
    line = F.col("line")
    return (
        _of(facts, "parameter")
        .select(
            "file",
            "section",
            F.regexp_extract(line, PARAMETER, 1).alias("name"),
            strip(F.regexp_extract(line, PARAMETER, 2)).alias("value"),
            "line_no",
        )
        .groupBy("file", "section", "name")
        .agg(F.max_by("value", "line_no").alias("value"))
    )


# --- object statistics ---------------------------------------------------------


def trace_table_stats(facts: DataFrame) -> DataFrame:
    """First statistics of each table."""
    return (
        _of(facts, "table")
        .select(
            "file",
            F.regexp_extract("line", TABLE_NAME, 1).alias("table_name"),
            "line_no",
            F.struct(
                F.col("line_no").alias("at"),
                F.regexp_extract("line", TABLE_NAME, 2).alias("alias"),
                _group("next1", TABLE_STATS, 1, "bigint").alias("rows"),
                _group("next1", TABLE_STATS, 2, "bigint").alias("blocks"),
                _group("next1", TABLE_STATS, 3, "double").alias("avg_row_len"),
                F.regexp_extract("line", TABLE_NAME, 3).rlike(NOT_ANALYZED).alias("not_analyzed"),
            ).alias("s"),
        )
        .groupBy("file", "table_name")
        .agg(F.min_by("s", "line_no").alias("s"))
        .select("file", "table_name", "s.*")
    )


def trace_index_stats(facts: DataFrame) -> DataFrame:
    """First statistics of each index."""
    names = ("levels", "leaf_blocks", "distinct_keys", "lb_per_key", "db_per_key", "clustering_factor", "num_rows")
    kinds = ("bigint", "bigint", "bigint", "double", "double", "double", "double")
    return (
        _of(facts, "index")
        .select(
            "file",
            F.regexp_extract("line", INDEX_NAME, 1).alias("index_name"),
            "line_no",
            F.struct(
                F.col("line_no").alias("at"),
                strip(F.regexp_extract("line", INDEX_NAME, 2)).alias("columns"),
                *[_group("next1", INDEX_STATS, i + 1, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))],
                F.col("line").rlike(NOT_ANALYZED).alias("not_analyzed"),
            ).alias("s"),
        )
        .groupBy("file", "index_name")
        .agg(F.min_by("s", "line_no").alias("s"))
        .select("file", "index_name", "s.*")
    )


def trace_column_rows(facts: DataFrame) -> DataFrame:
    """Every column entry of a trace with the line it stands on."""
    hist = F.col("next2").rlike(HISTOGRAM)
    no_stats = F.regexp_extract("line", COLUMN_NAME, 4).rlike(NO_STATISTICS)
    return _of(facts, "column").select(
        "file",
        F.regexp_extract("line", COLUMN_NAME, 2).alias("column_name"),
        F.col("line_no").alias("at"),
        _group("line", COLUMN_NAME, 1, "bigint").alias("col_num"),
        F.regexp_extract("line", COLUMN_NAME, 3).alias("data_type"),
        _group("next1", COLUMN_STATS, 1, "bigint").alias("avg_len"),
        _group("next1", COLUMN_STATS, 2, "bigint").alias("ndv"),
        _group("next1", COLUMN_STATS, 3, "bigint").alias("nulls"),
        _group("next1", COLUMN_STATS, 4, "double").alias("density"),
        F.when(hist, F.regexp_extract("next2", HISTOGRAM, 1))
        .when(no_stats, "N/A (no stats)")
        .otherwise("None")
        .alias("histogram"),
        F.when(hist, _group("next2", HISTOGRAM, 2, "bigint")).otherwise(F.lit(0)).alias("buckets"),
        F.when(hist, _group("next2", HISTOGRAM, 3, "bigint")).alias("uncomp_buckets"),
        F.when(hist, _group("next2", HISTOGRAM, 4, "bigint")).alias("end_pt_vals"),
        no_stats.alias("no_statistics"),
    )


def trace_column_stats(facts: DataFrame) -> DataFrame:
    """Last entry of each column name."""
    rows = trace_column_rows(facts)
    values = [c for c in rows.columns if c not in ("file", "column_name")]
    return (
        rows.groupBy("file", "column_name")
        .agg(F.max_by(F.struct(*values), "at").alias("s"))
        .select("file", "column_name", "s.*")
    )


# --- access paths --------------------------------------------------------------


def access_blocks(facts: DataFrame) -> DataFrame:
    """``(file, block_at, table_name, cardinality)``: one row per analysed table."""
    line = F.col("line")
    return (
        _of(facts, "access")
        .groupBy("file", "block_at")
        .agg(
            F.min("block_table").alias("table_name"),
            F.min_by(
                _group("line", CARDINALITY, 2, "bigint"), F.when(line.rlike(CARDINALITY), F.col("line_no"))
            ).alias("cardinality"),
        )
    )


def access_methods(facts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Costed access methods of each block, numbered in text order.

    Boundary lines are an access path (its method) and a cost line (END).  A
    segment starts at an access path unless the boundary before it is the same
    method; attribute lines belong to their segment while it is open.  A cost
    line emits an entry and closes the segment, a nested-loop cost line emits
    and leaves it open.  A later cost breakdown overwrites that of the latest
    entry.

    A block is cut into slices of ``slice_lines`` lines, and all windows run
    inside a slice.  What a slice does to the lines after it depends on its past
    only through the boundary that was last before it, so each slice is summed
    up in one row (``_slice_summary``), the rows are composed in block order
    (``_composed``), and every line adds what its slice began with.  Where no
    block is longer than a slice, which a look at line numbers tells, all begin
    with nothing.  ``facts`` should be written, as they are read for that too.
    """
    lines = _sliced_lines(facts, settings.slice_lines)
    one_slice = _of(facts, "access").filter(F.col("line_no") - F.col("block_at") >= settings.slice_lines).isEmpty()
    rows = _at_start(lines) if one_slice else lines.join(_composed(_slice_summary(lines)), ["file", "block_at", "slice"])
    was_open = F.col("in_mark") != ""
    opened = F.coalesce("local_mark", "in_mark")
    emits = F.col("costs") & (opened != "")
    entry_no = F.col("in_entries") + F.col("entries") + F.when(was_open, F.col("early_entries")).otherwise(0)

    def latest(name: str) -> Column:
        """The attribute in the line's segment: of its part, else of the parts that it continues."""
        own, before = F.col(name), F.col(f"in_{name}")
        early = F.coalesce(F.when(was_open, F.col(f"early_{name}")), before)
        return (
            F.when(F.col("part") == 0, F.coalesce(own, before))
            .when((F.col("part") == 1) & ~F.col("reopens"), F.coalesce(own, early))
            .otherwise(own)
        )

    entry = F.when(
        emits,
        F.struct(
            F.col("line_no").alias("at"),
            opened.alias("method"),
            latest("index_name").alias("index_name"),
            _group("cost_text", COST_LINE, 1, "double").alias("cost"),
            _group("cost_text", COST_LINE, 2, "double").alias("response_time"),
            _group("cost_text", COST_LINE, 3, "bigint").alias("degree"),
            latest("resource").alias("resource"),
            latest("selectivity").alias("selectivity"),
            F.when(F.col("nl"), "NL").alias("join_type"),
        ),
    )
    return (
        rows.select("file", "block_at", "block_table", "line_no", "detail", entry_no.alias("entry_no"), entry.alias("entry"))
        .filter("entry_no > 0 and (entry is not null or detail is not null)")
        .groupBy("file", "block_at", "block_table", "entry_no")
        .agg(
            F.max("entry").alias("e"),
            F.max_by("detail", F.when(F.col("detail").isNotNull(), F.col("line_no"))).alias("detail"),
        )
        .select(
            "file",
            "block_at",
            F.col("block_table").alias("table_name"),
            F.col("entry_no").cast("bigint").alias("entry_no"),
            "e.at",
            "e.method",
            "e.index_name",
            "e.cost",
            "e.response_time",
            "e.degree",
            F.coalesce("detail.io", "e.resource.io").alias("cost_io"),
            F.coalesce("detail.cpu", "e.resource.cpu").alias("cost_cpu"),
            F.col("e.selectivity.ix").alias("ix_sel"),
            F.col("e.selectivity.filters").alias("ix_sel_with_filters"),
            "e.join_type",
        )
    )


ATTRIBUTES = ("index_name", "resource", "selectivity")


def _sliced_lines(facts: DataFrame, slice_lines: int) -> DataFrame:
    """Lines that access methods are made of, with what their own slice says about them.

    ``local_mark`` is the boundary last before a line in its slice (a method, or
    empty for END).  Lines up to the first boundary of a slice are *early*: what
    they do depends on earlier slices.  ``part`` is 0 before that boundary, then 1
    plus the segments that surely opened; ``opens``, ``entries`` and
    ``early_entries`` count up to the line.
    """
    line = F.col("line")
    inside = Window.partitionBy("file", "block_at", "slice").orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    of_part = (
        Window.partitionBy("file", "block_at", "slice", "part")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def pair(pattern: str, first: str, second: str, kind: str) -> Column:
        return F.when(
            line.rlike(pattern),
            F.struct(_group("line", pattern, 1, "double").alias(first), _group("line", pattern, 2, kind).alias(second)),
        )

    own = {
        "index_name": extract(line, INDEX_LINE),
        "resource": pair(RESOURCE_COST, "io", "cpu", "bigint"),
        "selectivity": pair(SELECTIVITY, "ix", "filters", "double"),
    }
    ends, method = F.col("ends"), F.col("method")
    early = F.col("local_mark").isNull()
    known_open = ~early & (F.col("local_mark") != "")

    def count(test: Column) -> Column:
        return F.sum(F.coalesce(test, F.lit(False)).cast("int")).over(upto)

    return (
        _of(facts, "access")
        .filter(
            line.rlike(
                "|".join((ACCESS_PATH, INDEX_LINE, RESOURCE_COST, SELECTIVITY, COST_LINE, NL_COST, COST_DETAIL))
            )
        )
        .select(
            "file",
            "block_at",
            "block_table",
            "line_no",
            F.floor((F.col("line_no") - F.col("block_at")) / slice_lines).alias("slice"),
            strip(extract(line, ACCESS_PATH)).alias("method"),
            line.rlike(COST_LINE).alias("ends"),
            line.rlike(NL_COST).alias("nl"),
            *[value.alias(f"own_{name}") for name, value in own.items()],
            pair(COST_DETAIL, "io", "cpu", "bigint").alias("detail"),
            F.when(line.rlike(NL_COST), F.regexp_replace(line, r"^\s*NL Join\s*:", "")).otherwise(line).alias("cost_text"),
        )
        .withColumn("mark", F.when(method.isNotNull(), method).when(ends, F.lit("")))
        .withColumn("costs", ends | F.col("nl"))
        .withColumn("local_mark", F.last("mark", ignorenulls=True).over(earlier))
        .withColumn("opens", count(~early & method.isNotNull() & (method != F.col("local_mark"))))
        .withColumn("entries", count(known_open & F.col("costs")))
        .withColumn("early_entries", count(early & F.col("costs")))
        .withColumn("part", F.when(early & F.col("mark").isNull(), 0).otherwise(F.col("opens") + 1))
        .select(
            "*",
            *[
                F.last(F.when(early | known_open, F.col(f"own_{name}")), ignorenulls=True).over(of_part).alias(name)
                for name in ATTRIBUTES
            ],
        )
        .drop(*[f"own_{name}" for name in ATTRIBUTES])
    )


def _slice_summary(lines: DataFrame) -> DataFrame:
    """What a slice does to the lines after it, one row per slice."""
    early = F.col("local_mark").isNull()
    first = early & F.col("mark").isNotNull()
    return lines.groupBy("file", "block_at", "slice").agg(
        F.max(F.when(first, F.col("mark"))).alias("first_mark"),
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("line_no"))).alias("last_mark"),
        F.max("opens").alias("opens"),
        F.max("entries").alias("entries"),
        F.max("early_entries").alias("early_entries"),
        F.max("part").alias("part"),
        *[F.max_by(n, F.when(F.col("part") == 0, F.col("line_no"))).alias(f"early_{n}") for n in ATTRIBUTES],
        *[F.max_by(n, F.struct("part", "line_no")).alias(f"late_{n}") for n in ATTRIBUTES],
    )


def _at_start(lines: DataFrame) -> DataFrame:
    """Lines of first slices with what these begin with: no method is open."""
    nothing = {f"{side}_{n}": F.lit(None).cast(lines.schema[n].dataType) for side in ("in", "early") for n in ATTRIBUTES}
    return lines.withColumns({"in_mark": F.lit(""), "in_entries": F.lit(0), "reopens": F.lit(True), **nothing})


def _composed(summary: DataFrame) -> DataFrame:
    """Per slice what it begins with, from the slices before it in its block.

    Boundaries carry over; with them it is known whether a slice opens a segment
    at its first boundary and whether its early cost lines emit, so segments and
    entries are running sums; an attribute carries over while its segment lasts.
    """
    order = Window.partitionBy("file", "block_at").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = summary.withColumn("in_mark", F.coalesce(F.last("last_mark", ignorenulls=True).over(before), F.lit("")))
    was_open = F.col("in_mark") != ""
    made = (
        marked.withColumn("reopens", F.coalesce((F.col("first_mark") != "") & (F.col("first_mark") != F.col("in_mark")), F.lit(False)))
        .withColumn("made", F.col("opens") + F.col("reopens").cast("int"))
        .withColumn("emitted", F.col("entries") + F.when(was_open, F.col("early_entries")).otherwise(0))
    )
    counted = made.select(
        "*",
        F.coalesce(F.sum("made").over(before), F.lit(0)).alias("in_opens"),
        F.coalesce(F.sum("emitted").over(before), F.lit(0)).alias("in_entries"),
    )
    segment = (F.col("in_opens") + F.col("made")).alias("segment")

    def at_end(name: str) -> Column:
        early, late = F.when(was_open, F.col(f"early_{name}")), F.col(f"late_{name}")
        value = (
            F.when(F.col("part") == 0, early)
            .when((F.col("part") == 1) & ~F.col("reopens"), F.coalesce(late, early))
            .otherwise(late)
        )
        return F.when(value.isNotNull(), F.struct(segment, value.alias("value")))

    ended = counted.select("*", *[at_end(n).alias(f"end_{n}") for n in ATTRIBUTES])
    carried = ended.select("*", *[F.last(f"end_{n}", ignorenulls=True).over(before).alias(f"was_{n}") for n in ATTRIBUTES])
    return carried.select(
        "file",
        "block_at",
        "slice",
        "in_mark",
        "in_entries",
        "reopens",
        *[f"early_{n}" for n in ATTRIBUTES],
        *[F.when(F.col(f"was_{n}.segment") == F.col("in_opens"), F.col(f"was_{n}.value")).alias(f"in_{n}") for n in ATTRIBUTES],
    )


def scan_costs(facts: DataFrame) -> DataFrame:
    """Last of each of the four scan costs per block."""
    line = F.col("line")
    return (
        _of(facts, "access")
        .groupBy("file", "block_at")
        .agg(
            F.min("block_table").alias("table_name"),
            *[
                F.max_by(_group("line", p, 1, "double"), F.when(line.rlike(p), F.col("line_no"))).alias(name)
                for name, p in SCAN_COSTS.items()
            ],
        )
    )


def best_access(facts: DataFrame) -> DataFrame:
    """First complete best-path entry of each block."""
    indexed = F.col("next1").rlike(INDEX_LINE)
    rows = (
        _of(facts, "access")
        .filter(F.col("line").rlike(BEST_PATH))
        .withColumn("_index", F.when(indexed, F.regexp_extract("next1", INDEX_LINE, 1)))
        .withColumn("_cost", F.when(indexed, F.col("next2")).otherwise(F.col("next1")))
        .filter(F.col("_cost").rlike(BEST_COST))
    )
    best = F.struct(
        F.regexp_extract("line", BEST_PATH, 1).alias("method"),
        F.col("_index").alias("index_name"),
        _group("_cost", BEST_COST, 1, "double").alias("cost"),
        _group("_cost", BEST_COST, 2, "bigint").alias("degree"),
        _group("_cost", BEST_COST, 3, "double").alias("response_time"),
        _group("_cost", BEST_COST, 4, "double").alias("cardinality"),
    )
    return (
        rows.groupBy("file", "block_at")
        .agg(F.min("block_table").alias("table_name"), F.min_by(best, "line_no").alias("b"))
        .select("file", "block_at", "table_name", "b.*")
    )


# --- joins and costs -----------------------------------------------------------


def join_orders(facts: DataFrame) -> DataFrame:
    raw = F.regexp_extract("line", JOIN_ORDER, 2)
    return (
        _of(facts, "join")
        .filter(F.col("line").rlike(JOIN_ORDER))
        .select(
            "file",
            F.col("line_no").alias("at"),
            _group("line", JOIN_ORDER, 1, "bigint").alias("order_num"),
            F.regexp_extract_all(raw, F.lit(JOIN_TABLE), F.lit(1)).alias("tables"),
            strip(raw).alias("raw"),
        )
    )


def best_join(facts: DataFrame) -> DataFrame:
    """Last best join cost of each file."""
    best = F.struct(
        _group("line", BEST_JOIN, 1, "bigint").alias("table_num"),
        _group("line", BEST_JOIN, 2, "double").alias("cost"),
        _group("line", BEST_JOIN, 3, "double").alias("cardinality"),
        _group("line", BEST_JOIN, 4, "double").alias("bytes"),
    )
    return (
        _of(facts, "join")
        .filter(F.col("line").rlike(BEST_JOIN))
        .groupBy("file")
        .agg(F.max_by(best, "line_no").alias("b"))
        .select("file", "b.*")
    )


def join_search(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Permutations tried and the single-table flag of every file.

    ``files(file)`` are those with any fact unless given; these come in the same pass over the facts.
    """
    line, no = F.col("line"), F.col("line_no")
    tried = line.rlike(PERMUTATIONS) & (F.col("kind") == "join")
    # distinct names first: a trace may repeat a table many times
    tables = F.when(F.col("kind") == "table", F.regexp_extract(line, TABLE_NAME, 1))
    looked = facts if files is None else facts.filter(F.col("kind").isin("join", "table"))
    per_name = (
        looked.withColumn("_table", tables)
        .groupBy("file", "_table")
        .agg(F.min(F.when(tried, F.struct(no.alias("at"), _group("line", PERMUTATIONS, 1, "bigint").alias("n")))).alias("_p"))
    )
    found = per_name.groupBy("file").agg(F.min("_p")["n"].alias("n"), F.count("_table").alias("t"))
    if files is None:  # what has no name is no file's
        named = F.col("file").isNotNull()
        found = found.select("file", F.when(named, F.col("n")).alias("n"), F.when(named, F.col("t")).alias("t"))
    else:
        found = files.join(found, "file", "left")
    return (
        found.select(
            "file",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("permutations"),
            F.coalesce("t", F.lit(0)).cast("bigint").alias("tables"),
        )
        .withColumn("is_single_table", (F.col("permutations") == 1) & (F.col("tables") <= 1))
    )


def access_cost_analysis(methods: DataFrame) -> DataFrame:
    """Cheapest and dearest method per file and table; its last block counts.

    Equal costs: the first entry is the cheapest, the last one the dearest.
    """
    entry = F.struct("method", "index_name", "cost")
    per_block = methods.groupBy("file", "table_name", "block_at").agg(
        F.min_by(entry, F.struct("cost", "entry_no")).alias("best"),
        F.max_by(entry, F.struct("cost", "entry_no")).alias("worst"),
        F.count("*").alias("alternatives"),
    )
    return (
        per_block.groupBy("file", "table_name")
        .agg(F.max_by(F.struct("best", "worst", "alternatives"), "block_at").alias("c"))
        .select(
            "file",
            "table_name",
            F.col("c.best.method").alias("best_method"),
            F.col("c.best.index_name").alias("best_index"),
            F.col("c.best.cost").alias("best_cost"),
            F.col("c.worst.cost").alias("worst_cost"),
            F.when(
                (F.col("c.alternatives") > 1) & (F.col("c.best.cost") > 0), F.col("c.worst.cost") / F.col("c.best.cost")
            ).alias("cost_ratio"),
            F.col("c.alternatives").alias("alternatives"),
        )
    )


def overall_cost(best: DataFrame) -> DataFrame:
    return best.select(
        "file",
        F.col("cost").alias("total_cost"),
        F.col("cardinality").alias("total_card"),
        F.col("bytes").alias("total_bytes"),
    )


# --- sampling and transformations ----------------------------------------------


def dynamic_sampling(facts: DataFrame) -> DataFrame:
    """Distinct sampling messages of a file with the line they first stand on."""
    return (
        _of(facts, "sampling")
        .select("file", strip(F.regexp_extract("line", SAMPLING, 0)).alias("message"), "line_no")
        .groupBy("file", "message")
        .agg(F.min("line_no").alias("at"))
    )


def transformations(facts: DataFrame) -> DataFrame:
    """``(file, at, kind_no, kind, name, status, detail)``.

    Tags count only as whole words, abbreviation lists not at all.
    """
    line = F.col("line")

    def row(no: int, kind: str, name: str, pattern: str) -> Column:
        detail = strip(F.regexp_extract(line, pattern, 0))
        status = {
            "CBQT": F.when(detail.rlike("(?i)bypass|failed"), "bypassed").otherwise("applied"),
            "SU": F.when(F.lower(detail).contains("unnested"), "applied").otherwise("considered"),
            "GENERIC": F.lit("applied"),
        }.get(kind, F.lit("considered"))
        found = line.rlike(pattern)
        if kind != "GENERIC":
            found = found & ~line.rlike(LEGEND_LINE)
        return F.when(
            found,
            F.struct(
                F.lit(no).cast("bigint").alias("kind_no"),
                F.lit(kind).alias("type"),
                F.lit(name).alias("name"),
                status.alias("status"),
                detail.alias("detail"),
            ),
        )

    move = F.when(
        line.contains(PREDICATE_MOVE),
        F.struct(
            F.lit(1).cast("bigint").alias("kind_no"),
            F.lit("PM").alias("type"),
            F.lit("Predicate Move-Around").alias("name"),
            F.lit("considered").alias("status"),
            F.lit(None).cast("string").alias("detail"),
        ),
    )
    tags = [row(i + 2, k, n, p) for i, (k, n, p) in enumerate(TRANSFORMATIONS)]
    tagged = (
        _of(facts, "transformation")
        .select("file", F.col("line_no").alias("at"), F.explode(F.array_compact(F.array(move, *tags))).alias("t"))
        .select("file", "at", "t.*")
    )
    # predicate move-around counts once per file, every other kind once per line
    entry = F.when(F.col("type") == "PM", F.lit(0)).otherwise(F.col("at"))
    return (
        tagged.groupBy("file", "kind_no", "type", "name", entry.alias("_entry"))
        .agg(F.min(F.struct("at", "status", "detail")).alias("e"))
        .select("file", "e.at", "kind_no", "type", "name", "e.status", "e.detail")
    )


def transformation_summary(found: DataFrame) -> DataFrame:
    """Per file and kind the count and the sorted set of statuses."""
    return found.groupBy("file", "kind_no", "type", "name").agg(
        F.count("*").alias("entries"),
        F.array_join(F.sort_array(F.collect_set("status")), ", ").alias("statuses"),
    )
