"""Rules on optimizer traces.

Each rule looks at one relation, and rules on the same one are evaluated in one
pass; ``trace_issues`` puts them together.  For more than one rule, pass facts
that were written once (a table), not the text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.functions.labels import severity_label
from slowlens.operators import opttrace as o
from slowlens.operators.rules import Findings, Rule, rows_of_relations

# Names and limits of the rules.
LARGE_TABLE_ROWS = 100_000
CLUSTERING_INFO = 0.3
CLUSTERING_WARNING = 0.5
FEW_DISTINCT = 10
ADVICE = {
    "Full Table Scan": "Check for an index on the predicates and on grouping or ordering columns",
    "Index Fast Full Scan": "The index covers the statement; no action needed",
    "High Clustering Factor": "Rows do not follow the index order; consider rebuilding the table in that order",
    "Missing Histogram": "Gather a histogram for the column",
    "NOWORKLOAD System Stats": "Gather system statistics under a real workload",
    "MBRC Not Set": "Set the multiblock read count by gathering system statistics",
    "Table NOT ANALYZED": "Gather table statistics",
    "Index NOT ANALYZED": "Gather index statistics, or table statistics with cascade",
    "Dynamic Sampling Used": "Gather statistics so that no sampling is needed",
}


ISSUES = Findings({"at": "bigint", "message": "string", "measure": "double", "recommendation": "string"})
COLUMNS = ("file", "rule_no", "at", "severity", "type", "message", "measure", "recommendation")


def _rule(no: int, kind: str, severity, message, when=lambda x: F.lit(True), measure=None, at=0) -> Rule:
    return Rule(no, kind, when, severity, {"at": at, "message": message, "measure": measure, "recommendation": ADVICE[kind]})


def _text(pattern: str, *names: str):
    return lambda x: F.format_string(pattern, *[x[n] for n in names])


def _level(x: Column) -> Column:
    return F.when(x["ratio"] > CLUSTERING_WARNING, "WARNING").otherwise("INFO")


#: Rules and the relation that each looks at, see ``relations_of``.
TRACE_RULES: tuple[tuple[str, Rule], ...] = (
    (
        "best",
        _rule(
            1,
            "Full Table Scan",
            "WARNING",
            _text("%s: full scan is the best path for %d rows", "table_name", "rows"),
            lambda x: (x["method"] == "TableScan") & (x["rows"] > LARGE_TABLE_ROWS),
            lambda x: x["rows"],
            lambda x: x["block_at"],
        ),
    ),
    (
        "best",
        _rule(
            2,
            "Index Fast Full Scan",
            "INFO",
            lambda x: F.concat_ws(" ", x["table_name"], F.lit("is read from index"), F.coalesce(x["index_name"], F.lit("N/A"))),
            lambda x: x["method"] == "IndexFFS",
            at=lambda x: x["block_at"],
        ),
    ),
    (
        "indexes",
        _rule(
            3,
            "High Clustering Factor",
            _level,
            lambda x: F.concat_ws(" ", x["index_name"], F.lit("has a clustering factor far from its row order")),
            lambda x: x["ratio"] > CLUSTERING_INFO,
            lambda x: x["ratio"],
            lambda x: x["at"],
        ),
    ),
    (
        "columns",
        _rule(
            4,
            "Missing Histogram",
            "WARNING",
            _text("%s: %d distinct values and no histogram", "column_name", "ndv"),
            lambda x: (x["ndv"] <= FEW_DISTINCT) & (x["histogram"] == "None"),
            lambda x: x["ndv"],
            lambda x: x["at"],
        ),
    ),
    (
        "system",
        _rule(
            5,
            "NOWORKLOAD System Stats",
            "INFO",
            "System statistics are not from a workload",
            lambda x: (x["item"] == "stats_type") & (x["value"] == "NOWORKLOAD"),
        ),
    ),
    (
        "system",
        _rule(
            6,
            "MBRC Not Set",
            "WARNING",
            lambda x: F.concat(F.lit("Multiblock read count is not set, the default applies: "), x["default_value"]),
            lambda x: (x["item"] == "MBRC") & x["is_default"],
            lambda x: x["default_value"].try_cast("double"),
        ),
    ),
    ("bare_tables", _rule(7, "Table NOT ANALYZED", "WARNING", lambda x: x["names"], measure=lambda x: x["count"])),
    ("bare_indexes", _rule(8, "Index NOT ANALYZED", "WARNING", lambda x: x["names"], measure=lambda x: x["count"])),
    (
        "sampling",
        _rule(9, "Dynamic Sampling Used", "INFO", _text("Dynamic sampling was used: %d messages", "count"), measure=lambda x: x["count"]),
    ),
)


def _scans(best: DataFrame, tables: DataFrame) -> DataFrame:
    """Best paths with the rows of their table."""
    sized = tables.select("file", "table_name", "rows")
    return best.select("file", "block_at", "table_name", "method", "index_name").join(sized, ["file", "table_name"], "left")


def _indexes(indexes: DataFrame) -> DataFrame:
    ratio = F.when(F.col("num_rows") > 0, F.col("clustering_factor") / F.col("num_rows"))
    return indexes.select("file", "at", "index_name", ratio.alias("ratio"))


def _bare(objects: DataFrame, name: str) -> DataFrame:
    """One row per trace that lists the objects without statistics in file order.

    The list is part of the result and holds the object names of one trace.
    """
    return (
        objects.filter("not_analyzed")
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("at", name))).alias("l"))
        .select("file", F.array_join(F.transform("l", lambda e: e[name]), ", ").alias("names"), F.size("l").alias("count"))
    )


def _sampled(sampling: DataFrame) -> DataFrame:
    return sampling.groupBy("file").agg(F.count("*").alias("count"))


#: Kinds of facts that ``relations_of`` reads.
FACT_KINDS = ("access", "table", "index", "column", "system", "sampling")


def relations_of(facts: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """What rules can look at; each has a column ``file``, and is made only where a rule asks for it."""
    return {
        "best": lambda: _scans(o.best_access(facts), o.trace_table_stats(facts)),
        "tables": lambda: o.trace_table_stats(facts),
        "indexes": lambda: _indexes(o.trace_index_stats(facts)),
        "columns": lambda: o.trace_column_stats(facts),
        "system": lambda: o.trace_system_stats(facts),
        "bare_tables": lambda: _bare(o.trace_table_stats(facts), "table_name"),
        "bare_indexes": lambda: _bare(o.trace_index_stats(facts), "index_name"),
        "sampling": lambda: _sampled(o.dynamic_sampling(facts)),
    }


def _found(frame: DataFrame, *numbers: int) -> DataFrame:
    """Issues of the named rules on a relation that is at hand."""
    rules = [("given", rule) for _, rule in TRACE_RULES if rule.no in numbers]
    return rows_of_relations(rules, {"given": lambda: frame}, ISSUES, ["file"]).select(*COLUMNS)


def full_scan_issues(best: DataFrame, tables: DataFrame) -> DataFrame:
    """A full scan is the best path of a table with more than 100,000 rows."""
    return _found(_scans(best, tables), 1)


def fast_full_scan_issues(best: DataFrame) -> DataFrame:
    return _found(best, 2)


def clustering_issues(indexes: DataFrame) -> DataFrame:
    return _found(_indexes(indexes), 3)


def histogram_issues(columns: DataFrame) -> DataFrame:
    return _found(columns, 4)


def system_stats_issues(system: DataFrame) -> DataFrame:
    """No workload statistics (INFO) and multiblock read count not set (WARNING)."""
    return _found(system, 5, 6)


def not_analyzed_issues(objects: DataFrame, name: str, rule_no: int, kind: str) -> DataFrame:
    """One row per trace that lists the objects without statistics."""
    return _found(_bare(objects, name), rule_no)


def sampling_issues(sampling: DataFrame) -> DataFrame:
    return _found(_sampled(sampling), 9)


def trace_issues(
    facts: DataFrame,
    rules: Sequence[tuple[str, Rule]] = TRACE_RULES,
    relations: Mapping[str, Callable[[], DataFrame]] | None = None,
) -> DataFrame:
    """All rules on one trace set; ``at`` orders issues of one rule.

    A rule of one's own is one more entry; ``relations`` adds what it looks at.
    """
    known = relations_of(facts) | dict(relations or {})
    return rows_of_relations(rules, known, ISSUES, ["file"]).select(*COLUMNS)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file").agg(
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity") == "INFO").alias("infos"),
        F.count("*").alias("issues"),
    )


def trace_issue_report(issues: DataFrame, statements: DataFrame) -> DataFrame:
    """Sheet rows; sort by (file, rule_no, at) for the reading order."""
    return issues.join(statements.select("file", "sql_id"), "file", "left").select(
        "file",
        "sql_id",
        "rule_no",
        "at",
        severity_label(F.col("severity")).alias("severity_label"),
        "type",
        "message",
        "recommendation",
    )
