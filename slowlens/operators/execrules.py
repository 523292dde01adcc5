"""Rules on execution reports.

The plan lines and waits of a statement are matched once, into a struct; all
rules are evaluated on it and give one array of issues: one pass over the
statements, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.shape import computed, let
from slowlens.operators.execreport import KEY
from slowlens.operators.rules import Findings, Rule

# The patterns that rules look for.
FULL_SCAN_LINE = r"(\d+)\s+TABLE ACCESS.*FULL\s+(\w+)"
NESTED_LOOP_LINE = r"(\d+)\s+NESTED LOOPS"
SEQUENTIAL_READ = "db file sequential read"
SCATTERED_READ = "db file scattered read"

ISSUES = Findings({"message": "string", "subject": "string", "measure": "double"})
_CUT = "\u0001"


def _groups(line: Column, phrase: str, pattern: str, groups: int) -> Column:
    """The groups of a pattern's first match, null without one; lines without its phrase are not matched."""
    marks = _CUT.join(f"${i}" for i in range(1, groups + 1))
    cut = F.regexp_replace(line, rf"(?is)^.*?{pattern}.*$", f"{_CUT}{marks}")
    found = let(cut, lambda c: F.when(c.startswith(_CUT), F.split(c, _CUT)))
    return F.when(F.upper(line).contains(phrase), found)


def _plan_line(line: Column) -> Column:
    scan = _groups(line, "TABLE ACCESS", FULL_SCAN_LINE, 2)
    loop = _groups(line, "NESTED LOOPS", NESTED_LOOP_LINE, 1)

    def rows(found: Column) -> Column:
        return F.when(found.isNotNull(), F.coalesce(F.get(found, F.lit(1)).try_cast("bigint"), F.lit(0)))

    return let(
        F.struct(scan.alias("scan"), loop.alias("loop")),
        lambda m: F.struct(
            line.alias("line"),
            rows(m["scan"]).alias("scan_rows"),
            F.get(m["scan"], F.lit(2)).alias("scan_table"),
            rows(m["loop"]).alias("loop_rows"),
        ),
    )


def _wait(w: Column, settings: Settings) -> Column:
    event = F.lower(w["event"])
    sequential = event.contains(SEQUENTIAL_READ) & (w["times_waited"] > settings.sequential_read_waits)
    scattered = event.contains(SCATTERED_READ) & (w["times_waited"] > settings.scattered_read_waits)
    reads = F.when(sequential, "sequential").when(scattered, "scattered")
    return F.struct(
        w["event"].alias("event"), w["times_waited"].alias("times_waited"), w["max_wait"].alias("max_wait"), reads.alias("reads")
    )


def statement_figures(settings: Settings = DEFAULTS) -> Column:
    """What rules on a statement look at: its columns, ``plan`` lines, ``waits`` and ratios."""
    gets = F.col("total_query") + F.col("total_current")
    parsed = (F.col("parse_count") > 1) & (F.col("execute_count") > 0)
    return F.struct(
        *KEY,
        "sql_text",
        *[F.col(f"{p}_{c}") for p in ("parse", "execute", "fetch") for c in ("count", "elapsed", "disk", "rows")],
        "total_elapsed",
        "total_cpu",
        "total_disk",
        gets.alias("gets"),
        F.when(F.col("fetch_rows") > 0, gets / F.col("fetch_rows")).alias("gets_per_row"),
        F.when(parsed, F.col("parse_count") / F.col("execute_count")).alias("parse_ratio"),
        F.when((gets > 0) & (F.col("total_disk") > 0), F.col("total_disk") / gets).alias("disk_ratio"),
        F.transform("execution_plan", _plan_line).alias("plan"),
        F.transform("wait_events", lambda w: _wait(w, settings)).alias("waits"),
    )


def exec_rules(settings: Settings = DEFAULTS) -> list[Rule | Sequence[Rule]]:
    """The rules on statements, in the order in which their issues are listed."""
    text = F.format_string
    return [
        Rule(
            1,
            "FULL_TABLE_SCAN",
            lambda l: l["scan_rows"] >= settings.full_scan_rows,
            lambda l: F.when(l["scan_rows"] > settings.full_scan_high_rows, "HIGH").otherwise("MEDIUM"),
            {
                "message": lambda l: text("Full scan of table %s returned %d rows", l["scan_table"], l["scan_rows"]),
                "subject": lambda l: l["scan_table"],
                "measure": lambda l: l["scan_rows"],
            },
            each="plan",
        ),
        Rule(
            2,
            "HIGH_COST_NL_JOIN",
            lambda l: l["loop_rows"] >= settings.nested_loop_rows,
            "HIGH",
            {"message": lambda l: text("Nested loops produced %d rows", l["loop_rows"]), "measure": lambda l: l["loop_rows"]},
            each="plan",
        ),
        Rule(
            3,
            "HIGH_BUFFER_GETS_PER_ROW",
            lambda x: x["gets_per_row"] > settings.gets_per_row,
            "MEDIUM",
            {
                "message": lambda x: F.concat(F.lit("Buffer gets per fetched row: "), F.round(x["gets_per_row"], 1).cast("string")),
                "measure": lambda x: F.round(
                    x["gets"].cast("decimal(20,0)") / F.nullif(x["fetch_rows"], F.lit(0)).cast("decimal(18,0)"), 1
                ),
            },
        ),
        Rule(
            4,
            "EXCESSIVE_PARSING",
            lambda x: x["parse_ratio"] > settings.parse_ratio,
            "MEDIUM",
            {
                "message": lambda x: F.concat(F.lit("Parse calls per execution: "), F.round(x["parse_ratio"], 2).cast("string")),
                "measure": lambda x: F.round(
                    x["parse_count"].cast("decimal(18,0)") / F.nullif(x["execute_count"], F.lit(0)).cast("decimal(18,0)"), 2
                ),
            },
        ),
        Rule(
            5,
            "HIGH_DISK_READ_RATIO",
            lambda x: x["disk_ratio"] > settings.disk_ratio,
            lambda x: F.when(x["disk_ratio"] < settings.disk_ratio_medium, "LOW").otherwise("MEDIUM"),
            {
                "message": lambda x: F.concat(F.lit("Share of buffer gets read from disk: "), F.round(x["disk_ratio"], 3).cast("string")),
                "measure": lambda x: F.round(
                    x["total_disk"].cast("decimal(18,0)") / F.nullif(x["gets"], F.lit(0)).cast("decimal(18,0)"), 2
                ),
            },
        ),
        (
            Rule(
                6,
                "EXCESSIVE_INDEX_READ",
                lambda w: w["reads"] == "sequential",
                "MEDIUM",
                {
                    "message": lambda w: text("Waited %d times for single-block reads", w["times_waited"]),
                    "subject": lambda w: w["event"],
                    "measure": lambda w: w["times_waited"],
                },
                each="waits",
            ),
            Rule(
                7,
                "EXCESSIVE_FTS_READ",
                lambda w: w["reads"] == "scattered",
                "HIGH",
                {
                    "message": lambda w: text("Waited %d times for multi-block reads", w["times_waited"]),
                    "subject": lambda w: w["event"],
                    "measure": lambda w: w["times_waited"],
                },
                each="waits",
            ),
        ),
    ]


def with_issues(
    statements: DataFrame, settings: Settings = DEFAULTS, rules: Sequence[Rule | Sequence[Rule]] | None = None
) -> DataFrame:
    """Statements with an ``issues`` array in rule order; ``rules`` are those of ``exec_rules`` unless given."""
    rules = exec_rules(settings) if rules is None else rules
    seen = computed(statements, _figures=statement_figures(settings))
    return computed(seen, issues=ISSUES.findings(rules, F.col("_figures"))).drop("_figures")


def exec_issues(
    statements: DataFrame, settings: Settings = DEFAULTS, rules: Sequence[Rule | Sequence[Rule]] | None = None
) -> DataFrame:
    """One row per issue; ``issue_no`` keeps the rule order in a statement."""
    return (
        with_issues(statements, settings, rules)
        .select(*KEY, F.posexplode("issues").alias("issue_no", "i"))
        .select(*KEY, (F.col("issue_no") + 1).cast("bigint").alias("issue_no"), "i.*")
    )
