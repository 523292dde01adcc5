"""A corpus from raw documents to shards: every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slowlens.llm.catalog import query
from slowlens.llm.common import saved, table
from slowlens.llm.contamination import decontamination_stage
from slowlens.llm.lines import quality_stage
from slowlens.llm.mixing import mixing_stage
from slowlens.llm.ngram_join import near_duplicate_stage
from slowlens.llm.shards import sharding_stage

STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Chosen paths and label propagation are no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return docs
