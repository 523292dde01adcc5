"""SQL-workload analytics on Spark DataFrames.

Statement statistics, snapshot counters, execution reports and optimizer
traces go in as tables, file sets or streams; ranked statements, extracted
relations, tuning findings and report tables come out.  Operators are plain
functions ``DataFrame -> DataFrame`` made of built-in column expressions.
"""

from slowlens.config import Settings
from slowlens.session import build_session

__all__ = ["Settings", "build_session"]
