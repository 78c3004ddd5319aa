"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
Null ids and texts, empty and very long texts and repeated rows go through as each stage's operator states; an empty
table gives no rows; further columns of ``documents`` are kept up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulse.llm.common import read_table, with_package, write_shared
from pulse.llm.line_dedup import line_stage
from pulse.llm.ngram_join import ngram_stage
from pulse.llm.packing import packing_stage
from pulse.llm.toxicity import toxicity_stage


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(with_package(spark), docs, sf_dir)
    return run


#: Toxic documents go; lines that a source repeats go; one document of each near-duplicate group stays; the rest is packed.
STAGES = [
    ("toxicity", _stage(toxicity_stage)),
    ("line_dedup", _stage(line_stage)),
    ("ngram_join", _stage(ngram_stage)),
    ("packing", _stage(packing_stage)),
]

#: Tokenizers, iterative linking and a trained classifier have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
