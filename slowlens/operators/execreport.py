"""Execution reports: blocks, statements, phases, plans, waits, binds.

A report is cut into blocks at its star rules; one block is one statement.
Everything below works on the lines of one block inside one row, so a report
set is parsed in a single pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.labels import band, bind_type_name, severity_weight
from slowlens.functions.ordered import running_sum
from slowlens.functions.shape import computed
from slowlens.functions.text import base_name, preview, rstrip, strip
from slowlens.sources.documents import PHASES
from slowlens.sources.texts import TextSet

# Line patterns of the report format, and its limits.
STAR_RULE = r"\*{10,}"
MIN_BLOCK_CHARS = 50
CALL_HEADER = r"(?i)^call\s+count"
STATEMENT_ID = r"sql_id='(\w+)'"
PHASE_ROWS = 10
PHASE_NUMBERS = r"\s+\d+\s+[\d.]+\s+[\d.]+\s+\d+\s+\d+\s+\d+\s+\d+"
PLAN_HEADER = r"(?i)^Rows\s+(?:Row Source|Execution Plan)"
PLAN_HEADER_PHRASE = "Row Source Operation"
PLAN_END = r"^\s*(?:$|Elapsed|\*{4})"
WAIT_HEADER = r"(?i)^(?:Elapsed times include waiting|Event waited on)"
WAIT_ROW = r"^(.+?)\s+(\d+)\s+([\d.]+)"
BINDS_OPEN = r"BINDS\s*#"
BINDS_CLOSE = r"(?:\*{4}|(?:WAIT|STAT|CLOSE|EXEC|FETCH|PARSE)\s+#)"
BIND_OPEN = r"(?i)bind\s+\d+:"
BIND_NUMBER = r"(?i)^\s*bind\s+(\d+):"
BIND_VALUE = r"(?im)^\s*value=(.*)$"
BIND_TYPE = r"(?im)^\s*dty=(.*)$"


ALL_PHASES = PHASES + ("total",)
# The same on a whole text: a newline alone ends a line, and a blank inside a line is not one.
_BLANK = r"[ \t\r\x0B\f]"
_HEAD = rf"call{_BLANK}+count"
_BEFORE = rf"(?dsi)\A(?!{_HEAD})(.*?)\n{_HEAD}"
_ID_LINE = rf"(?dm)^.*{STATEMENT_ID}.*(?:\n|\z)"
_LAST_ID = rf"(?ds)\A(?:.*\n)?[^\n]*?{STATEMENT_ID}"
_STARTS_LINE = r"(?<=(?:\A|\n).)"
_PLAN = (
    rf"(?ds)[Rr](?:(?<=R){PLAN_HEADER_PHRASE[1:]}|{_STARTS_LINE}(?i:ows{_BLANK}+(?:Row Source|Execution Plan)))[^\n]*"
    rf"(.*?)(?=\n{_BLANK}*(?:\n|\z|Elapsed|\*{{4}})|\z)"
)
_WAITS = (
    rf"(?ds)[Ee]{_STARTS_LINE}(?i:lapsed times include waiting|vent waited on)[^\n]*\n[^\n]*"
    rf"(.*?)(?=\n{_BLANK}*(?:\n|\z|\*{{4}})|\z)"
)


def exec_blocks(reports: TextSet, settings: Settings = DEFAULTS) -> DataFrame:
    """``(file, block_no, block)``: trimmed blocks of at least 50 characters."""
    pieces = reports.texts.select("file", F.posexplode(F.split("text", STAR_RULE, -1)).alias("block_no", "block"))
    if reports.long_lines is not None:
        pieces = pieces.unionByName(_blocks_of_long_files(reports.long_lines, settings))
    return kept_blocks(pieces)


def kept_blocks(pieces: DataFrame) -> DataFrame:
    """Trimmed blocks that are long enough."""
    return (
        pieces.select("file", F.col("block_no").cast("bigint").alias("block_no"), strip(F.col("block")).alias("block"))
        .filter(F.length("block") >= MIN_BLOCK_CHARS)
    )


def _blocks_of_long_files(lines: DataFrame, settings: Settings) -> DataFrame:
    """Blocks of files read split by split; a group is one statement's block."""
    cut = F.split("line", STAR_RULE, -1)
    numbered = running_sum(
        lines.withColumn("_cuts", F.size(cut) - 1), "file", ["line_no"], F.col("_cuts"), "_after", settings.slice_lines
    )
    parts = numbered.select(
        "file", "line_no", (F.col("_after") - F.col("_cuts")).alias("_before"), F.posexplode(cut).alias("_i", "_part")
    )
    return (
        parts.groupBy("file", (F.col("_before") + F.col("_i")).cast("int").alias("block_no"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "_i", "_part"))).alias("_parts"))
        .select("file", "block_no", F.array_join(F.transform("_parts", lambda p: p["_part"]), "\n").alias("block"))
    )


def _last_row(rows: Column, phase: str) -> Column:
    """The last line of a phase up to its last number, empty without one."""
    numbers = PHASE_NUMBERS.replace(r"\s", _BLANK)
    return F.regexp_extract(rows, rf"(?dsi)\A(?:.*\n)?{_BLANK}*({phase}{numbers})", 1)


def words(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"\S+"), F.lit(0))


def _lines_of(section: Column) -> Column:
    """Lines of a section that begins with a line end or is empty."""
    return F.slice(F.split(section, "\n", -1), 2, 1 << 30)


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def _seconds(text: Column) -> Column:
    return F.coalesce(text.try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))


def wait_structs(lines: Column) -> Column:
    """Waits of those lines that are wait rows."""
    return F.transform(
        F.filter(lines, lambda l: l.rlike(WAIT_ROW)),
        lambda l: F.struct(
            strip(F.regexp_extract(l, WAIT_ROW, 1)).alias("event"),
            F.regexp_extract(l, WAIT_ROW, 2).try_cast("bigint").alias("times_waited"),
            F.coalesce(F.regexp_extract(l, WAIT_ROW, 3).try_cast("double"), F.lit(0.0)).alias("max_wait"),
        ),
    )


def last_value(text: Column, pattern: str) -> Column:
    """What the last match of a pattern holds, trimmed; null without a match."""
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))


def _binds(block: Column) -> Column:
    """Binds of all sections of a block.

    A section runs from its opening line to the next opening or closing line,
    a bind from its number line to the next one; both are cut out of the text.
    Values before the first number line of a section form a bind without
    position.
    """
    sections = F.filter(
        F.split(block, rf"(?m)^(?=[ \t]*(?:{BINDS_OPEN}|{BINDS_CLOSE}))", -1), lambda s: s.rlike(rf"^\s*{BINDS_OPEN}")
    )
    pieces = F.flatten(F.transform(sections, lambda s: F.split(s, rf"(?m)^(?=[ \t]*{BIND_OPEN})", -1)))
    binds = F.filter(pieces, lambda p: p.rlike(BIND_NUMBER) | p.rlike(BIND_VALUE) | p.rlike(BIND_TYPE))
    found = F.transform(
        binds,
        lambda p: F.struct(
            (F.when(p.rlike(BIND_NUMBER), F.regexp_extract(p, BIND_NUMBER, 1)).cast("bigint") + 1).alias("position"),
            bind_type_name(last_value(p, BIND_TYPE)).alias("type"),
            last_value(p, BIND_VALUE).alias("value"),
        ),
    )
    kind = "array<struct<position:bigint,type:string,value:string>>"
    return F.when(block.contains("BINDS"), found).otherwise(F.array().cast(kind))


def exec_statements(blocks: DataFrame) -> DataFrame:
    """One row per statement with its phase counters, plan, waits and binds.

    Blocks without a call table, without text, or with no elapsed time in the
    total row are not statements.
    """
    headed = computed(blocks, before=F.regexp_extract("block", _BEFORE, 1)).filter("before <> ''")
    before, body = F.col("before"), F.col("body")
    has_id = before.contains("sql_id='")
    shaped = (
        headed.withColumn("body", F.substr("block", F.length(before) + 2))
        .select(
            "file",
            "block_no",
            "block",
            "body",
            F.when(has_id, F.regexp_extract(before, _LAST_ID, 1)).otherwise("").alias("sql_id"),
            strip(F.when(has_id, F.regexp_replace(before, _ID_LINE, "")).otherwise(before)).alias("sql_text"),
            F.substring_index(body, "\n", PHASE_ROWS).alias("_rows"),
        )
        .filter("sql_text <> ''")
    )
    phases = shaped.select("*", *[words(_last_row(F.col("_rows"), p)).alias(f"_{p}") for p in ALL_PHASES])
    timed, counters = with_counters(phases)
    plan = _lines_of(F.regexp_extract(body, _PLAN, 1))
    waits = _lines_of(F.regexp_extract(body, _WAITS, 1))
    # plain columns: a reader that does not use one does not compute it
    return timed.select(
        "file",
        "block_no",
        "sql_id",
        "sql_text",
        *counters,
        F.transform(plan, rstrip).alias("execution_plan"),
        wait_structs(F.transform(waits, strip)).alias("wait_events"),
        _binds(F.col("block")).alias("bind_variables"),
    )


def with_counters(phases: DataFrame) -> tuple[DataFrame, list[str]]:
    """Counters from the words of the phase rows ``_parse`` .. ``_total``, and their names; blocks with elapsed time only."""
    counters = {}
    for phase in ALL_PHASES:
        part = [F.get(F.col(f"_{phase}"), F.lit(i)) for i in range(8)]
        if phase != "total":
            counters[f"{phase}_count"] = _whole(part[1])
        counters[f"{phase}_cpu"] = _seconds(part[2])
        counters[f"{phase}_elapsed"] = _seconds(part[3])
        for i, name in enumerate(("disk", "query", "current", "rows")):
            counters[f"{phase}_{name}"] = _whole(part[4 + i])
    timed = phases.filter(counters["total_elapsed"] > 0)
    return timed.select("*", *[value.alias(name) for name, value in counters.items()]), list(counters)


KEY = ("file", "block_no", "sql_id")


def exec_phases(statements: DataFrame) -> DataFrame:
    """Long form: four rows per statement; the total row has no count."""
    rows = F.array(
        *[
            F.struct(
                F.lit(phase.capitalize()).alias("phase"),
                (F.col(f"{phase}_count") if phase != "total" else F.lit(None)).cast("bigint").alias("count"),
                *[
                    F.col(f"{phase}_{c}").alias(c)
                    for c in ("cpu", "elapsed", "disk", "query", "current", "rows")
                ],
            )
            for phase in ALL_PHASES
        ]
    )
    return statements.select(*KEY, "sql_text", F.explode(rows).alias("r")).select(*KEY, "sql_text", "r.*")


def exec_phase_report(statements: DataFrame) -> DataFrame:
    return exec_phases(statements).withColumn("sql_preview", preview(F.col("sql_text"), 80)).drop("sql_text")


def exec_plan_lines(statements: DataFrame) -> DataFrame:
    plans = computed(statements, _plan=F.col("execution_plan"))
    return plans.select(*KEY, F.posexplode("_plan").alias("line_no", "line")).withColumn(
        "line_no", (F.col("line_no") + 1).cast("bigint")
    )


def exec_waits(statements: DataFrame) -> DataFrame:
    found = computed(statements, _waits=F.col("wait_events"))
    return found.select(*KEY, F.explode("_waits").alias("w")).select(*KEY, "w.*")


def exec_wait_report(waits: DataFrame) -> DataFrame:
    return waits.withColumn("band", band(F.col("max_wait"), 1, 0.1))


def exec_binds(statements: DataFrame) -> DataFrame:
    found = computed(statements, _binds=F.col("bind_variables"))
    return found.select(*KEY, "sql_text", F.explode("_binds").alias("b")).select(*KEY, "sql_text", "b.*")


def exec_bind_report(binds: DataFrame) -> DataFrame:
    return binds.withColumn("sql_preview", preview(F.col("sql_text"), 80)).drop("sql_text")


def exec_report_totals(statements: DataFrame) -> DataFrame:
    """Per file: statements, issues, HIGH issues and elapsed seconds.

    Takes statements with their ``issues``; everything is counted inside each
    row, so one aggregate with map-side sums is enough.
    """
    high = F.size(F.filter("issues", lambda i: i["severity"] == "HIGH"))
    return statements.groupBy("file").agg(
        F.count("*").alias("statements"),
        F.sum(F.size("issues")).cast("bigint").alias("issues"),
        F.sum(high).cast("bigint").alias("high_issues"),
        F.sum("total_elapsed").cast("double").alias("total_elapsed"),
    )


def exec_worst_severity(statements: DataFrame) -> DataFrame:
    """Per statement with issues: how many, and the worst severity."""
    worst = F.array_max(
        F.transform("issues", lambda i: F.struct(severity_weight(i["severity"]).alias("w"), i["severity"].alias("s")))
    )
    return statements.filter(F.size("issues") > 0).select(
        *KEY, F.size("issues").cast("bigint").alias("issue_count"), worst["s"].alias("severity")
    )


def exec_text_report(reports: TextSet, settings: Settings = DEFAULTS) -> DataFrame:
    """Whole texts per file in numbered parts, with the line count of the file; empty texts are left out.

    A file too large to be one value comes in parts of ``slice_lines`` lines, every other
    one is a single part; parts in order, joined by line ends, are the text.
    """
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    one = F.lit(1).cast("bigint")
    found = reports.texts.filter(F.col("text") != "").select(
        "file", F.col("text").alias("full_text"), (newlines + 1).cast("bigint").alias("line_count"), one.alias("part"), one.alias("parts")
    )
    if reports.long_lines is not None:
        part = (F.floor((F.col("line_no") - 1) / settings.slice_lines) + 1).alias("part")
        pieces = (
            reports.long_lines.groupBy("file", part)
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
            .select("file", "part", F.array_join(F.col("lines.line"), "\n").alias("full_text"))
        )
        sizes = reports.long_lines.groupBy("file").agg(F.count("*").alias("line_count"), F.max(part).alias("parts"))
        found = found.unionByName(pieces.join(sizes, "file"))
    return found.select(
        "file",
        F.regexp_extract(base_name(F.col("file")), r"([^_]*?)(?:_|\.[^.]*$|$)", 1).alias("doc_id"),
        base_name(F.col("file")).alias("file_name"),
        "full_text",
        "line_count",
        "part",
        "parts",
    )

