"""Thresholds and fixed name lists.

Everything here is a plain value that an operator takes as an argument; a
site changes it with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Names and lists that decide results.
# ---------------------------------------------------------------------------
SYSTEM_SCHEMAS = ("SYS", "SYSTEM", "DBSNMP", "OUTLN")
INELIGIBLE_USERS = ("SYS", "SYSTEM", "DBSNMP", "OUTLN", "AUDSYS")
EXCLUDE_PATTERNS = (
    r"^SELECT .* FROM V\$",
    r"^SELECT .* FROM GV\$",
    r"^/\*.*tuning_auto\*/",
    r"DBMS_",
)
PLAN_FORMATS = ("ALLSTATS LAST", "TYPICAL")
PLAN_MISSING = "cannot fetch plan"
PGA_ITEMS = (
    "aggregate PGA target parameter",
    "aggregate PGA auto target",
    "total PGA allocated",
    "total PGA inuse",
    "maximum PGA allocated",
)
OS_ITEMS = (
    "NUM_CPUS",
    "NUM_CPU_CORES",
    "NUM_CPU_SOCKETS",
    "PHYSICAL_MEMORY_BYTES",
    "IDLE_TIME",
    "BUSY_TIME",
)
INSTANCE_PARAMETERS = (
    "optimizer_mode",
    "optimizer_features_enable",
    "db_block_size",
    "db_file_multiblock_read_count",
    "pga_aggregate_target",
    "sga_target",
    "sga_max_size",
    "memory_target",
    "memory_max_target",
    "cursor_sharing",
    "statistics_level",
    "optimizer_adaptive_plans",
    "optimizer_adaptive_statistics",
    "parallel_max_servers",
    "parallel_threads_per_cpu",
    "result_cache_mode",
    "inmemory_size",
    "undo_tablespace",
    "undo_retention",
    "open_cursors",
    "session_cached_cursors",
    "db_keep_cache_size",
    "db_recycle_cache_size",
    "log_buffer",
    "processes",
    "sessions",
)
KEY_PARAMETERS_SHEET = (
    "optimizer_mode",
    "optimizer_features_enable",
    "cpu_count",
    "active_instance_count",
    "db_file_multiblock_read_count",
    "pga_aggregate_target",
    "hash_area_size",
    "sort_area_size",
    "cursor_sharing",
    "star_transformation_enabled",
    "parallel_threads_per_cpu",
    "_optimizer_cost_model",
    "_b_tree_bitmap_plans",
)
KEY_PARAMETERS_PAGE = KEY_PARAMETERS_SHEET + (
    "_optimizer_skip_scan_enabled",
    "_optimizer_batch_table_access_by_rowid",
)
BIND_TYPES = {
    "1": "VARCHAR2",
    "2": "NUMBER",
    "12": "DATE",
    "23": "RAW",
    "96": "CHAR",
    "112": "CLOB",
    "113": "BLOB",
    "180": "TIMESTAMP",
    "181": "TIMESTAMP WITH TZ",
}
SEVERITY_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
# (directory, file name pattern, days kept)
RETENTION_POLICY = (
    ("traces", r"^.*\.trc$", 30),
    ("traces", r"^detected_.*\.json$", 30),
    ("traces", r"^trace_results_.*\.json$", 30),
    ("tkprof", r"^.*\.prf$", 30),
    ("reports", r"^.*\.html$", 90),
)


@dataclass(frozen=True)
class Settings:
    """Numeric limits of the detection, report and rule operators."""

    # detection over cumulative statistics
    elapsed_ms: int = 5000
    min_executions: int = 10
    detect_limit: int = 100
    # detection per execution
    elapsed_threshold_sec: float = 3.0
    buffer_gets_threshold: int = 100_000
    disk_reads_threshold: int = 10_000
    recent_minutes: int = 1440
    dedup_hours: int = 24
    # reports
    top_n: int = 20
    # execution-report rules
    full_scan_rows: int = 10_000
    full_scan_high_rows: int = 100_000
    nested_loop_rows: int = 100_000
    gets_per_row: int = 100
    parse_ratio: float = 0.5
    disk_ratio: float = 0.3
    disk_ratio_medium: float = 0.5
    sequential_read_waits: int = 1000
    scattered_read_waits: int = 100
    # text sources: a larger file is read split by split instead of whole
    whole_file_bytes: int = 32 * 1024 * 1024
    # lines per slice when one large file is spread over tasks
    slice_lines: int = 50_000


DEFAULTS = Settings()
