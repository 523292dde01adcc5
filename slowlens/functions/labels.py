"""Severity weights, display bands and type names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from slowlens.config import BIND_TYPES, SEVERITY_WEIGHT

# Label shown for each severity of the three rule sets.
SEVERITY_LABELS = {
    "HIGH": "🔴 HIGH",
    "MEDIUM": "🟡 MEDIUM",
    "LOW": "🟢 LOW",
    "GOOD": "🟢 GOOD",
    "CRITICAL": "🔴 CRITICAL",
    "WARNING": "🟡 WARNING",
    "INFO": "🟢 INFO",
}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_label(severity: Column) -> Column:
    return F.coalesce(_lookup(SEVERITY_LABELS, severity), severity)


def severity_weight(severity: Column) -> Column:
    return F.coalesce(_lookup(SEVERITY_WEIGHT, severity), F.lit(0))


def bind_type_name(code: Column) -> Column:
    return F.coalesce(_lookup(BIND_TYPES, code), F.concat(F.lit("TYPE("), code, F.lit(")")))


def band(value: Column, danger: float, warn: float) -> Column:
    """``danger`` above the first limit, ``warn`` above the second, else ``none``."""
    return F.when(value > danger, "danger").when(value > warn, "warn").otherwise("none")
