"""Tuning rules on plan text and snapshot statistics of a document."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.functions.labels import severity_label
from slowlens.functions.text import parse_num
from slowlens.operators.rules import Findings, Rule
from slowlens.operators.snapshots import first_stats

# Plan texts and limits of the rules.
ELAPSED_LIMITS = (10, 3)
GETS_LIMITS = (1_000_000, 100_000)
READS_LIMIT = 10_000
GETS_PER_ROW_LIMIT = 100
NESTED_LOOP_LIMIT = 100_000
FAST_FULL_SCAN = "INDEX FAST FULL SCAN"
FULL_SCANS = ("TABLE ACCESS FULL", "FULL TABLE SCAN")
PARTITION_SCANS = ("PARTITION LIST ALL", "PARTITION RANGE ALL")
NESTED_LOOP_ROWS = r"NESTED LOOPS[^\n]*\n[^|]*\|[^|]*\|[^|]*\|\s*([\d.KMG]+)\s*\|"
SORTS = r"SORT\s+(?:UNIQUE|GROUP BY|JOIN|AGGREGATE)"
HASH_JOIN = "HASH JOIN"
# Symptom and advice of each rule.
GUIDE = {
    "elapsed": ("Average elapsed time is long", "Review the whole plan, its indexes and join methods"),
    "buffer_gets": ("Many buffer gets", "Check index selectivity and clustering; consider partitioning"),
    "physical_reads": ("Many physical reads", "Check the buffer cache size and the objects kept in it"),
    "gets_per_row": ("Many buffer gets for each row", "Check the range scans and the order of index columns"),
    "index_fast_full_scan": ("An index is read as a whole", "Add an index that supports the predicates as a range"),
    "full_table_scan": ("A table is read as a whole", "Add an index on the predicates or check partition pruning"),
    "no_partition_pruning": ("All partitions are read", "Add a predicate on the partition key"),
    "large_nested_loop": ("A nested loop handles many rows", "Try a hash join or another driving table"),
    "sort": ("The plan sorts", "An index in that order, or more work area memory, may avoid it"),
    "hash_join": ("The plan joins by hash", "Check that the build side fits into memory"),
    "nothing_found": ("No rule applies", "The plan looks appropriate"),
}


POINTS = Findings({"symptom": "string", "advice": "string", "measure": "double"})


def document_figures() -> Column:
    """What rules on a document look at: its plan as ``text``, the figures of its first statistics, large loops."""
    text = F.coalesce(F.array_join("plan", "\n"), F.lit(""))
    loop_rows = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(NESTED_LOOP_ROWS), F.lit(1)), parse_num),
        lambda n: n > NESTED_LOOP_LIMIT,
    )
    return F.struct(text.alias("text"), loop_rows.alias("loop_rows"), *[c.alias(n) for n, c in first_stats().items()])


def _rule(no: int, kind: str, when, severity, measure=None) -> Rule:
    symptom, advice = GUIDE[kind]
    return Rule(no, kind, when, severity, {"symptom": symptom, "advice": advice, "measure": measure})


def _above(name: str, limits: tuple[int, ...]):
    """Condition and severity of a figure over the lower, or the higher, limit."""
    return (lambda x: x[name] > limits[-1]), (lambda x: F.when(x[name] > limits[0], "HIGH").otherwise("MEDIUM"))


def _has(*phrases: str):
    return lambda x: reduce(Column.__or__, [x["text"].contains(p) for p in phrases])


def _per_row(x: Column) -> Column:
    return F.when((x["rows"] > 0) & (x["gets"] > 0), x["gets"] / F.greatest(x["rows"], F.lit(1.0)))


def tuning_rules() -> list[Rule]:
    """The rules on documents, in the order in which their points are listed."""
    return [
        _rule(1, "elapsed", *_above("elapsed", ELAPSED_LIMITS), lambda x: x["elapsed"]),
        _rule(2, "buffer_gets", *_above("gets", GETS_LIMITS), lambda x: x["gets"]),
        _rule(3, "physical_reads", lambda x: x["reads"] > READS_LIMIT, "HIGH", lambda x: x["reads"]),
        _rule(4, "gets_per_row", lambda x: _per_row(x) > GETS_PER_ROW_LIMIT, "MEDIUM", _per_row),
        _rule(5, "index_fast_full_scan", _has(FAST_FULL_SCAN), "MEDIUM"),
        _rule(6, "full_table_scan", _has(*FULL_SCANS), "HIGH"),
        _rule(7, "no_partition_pruning", _has(*PARTITION_SCANS), "MEDIUM"),
        _rule(8, "large_nested_loop", lambda x: F.size(x["loop_rows"]) > 0, "MEDIUM", lambda x: F.get(x["loop_rows"], F.lit(0))),
        _rule(9, "sort", lambda x: x["text"].rlike(SORTS), "LOW"),
        _rule(10, "hash_join", _has(HASH_JOIN), "LOW"),
    ]


NOTHING = _rule(11, "nothing_found", lambda x: F.lit(True), "GOOD")


def tuning_points(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Documents with a ``points`` array in rule order, never empty; ``rules`` are those of ``tuning_rules`` unless given."""
    rules = tuning_rules() if rules is None else rules
    row = F.col("_figures")
    seen = docs.withColumn("_figures", document_figures())
    found = seen.withColumn("_found", POINTS.findings([tuple(rules)], row))
    points = F.when(F.size("_found") > 0, F.col("_found")).otherwise(POINTS.findings([NOTHING], row))
    return found.withColumn("points", points).select(*docs.columns, "points")


def tuning_guide(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document and point, in rule order."""
    return (
        tuning_points(docs, rules)
        .select("sql_id", F.posexplode("points").alias("point_no", "p"))
        .select(
            "sql_id",
            (F.col("point_no") + 1).cast("bigint").alias("point_no"),
            "p.*",
            severity_label(F.col("p.severity")).alias("severity_label"),
        )
    )
