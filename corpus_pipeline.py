"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing; each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; the last returns the pieces of the
packed sequences.  run() writes each stage's rows to the folder all executors share and reads them back, so a lost
executor repeats one stage at most.  The tables that a stage wrote for itself go when its rows are stored, and the rows of
all stages but the last at the end.  SQL can't express the trained and the packing stages, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import scratch
from strandloom.llm.decontaminate import drop_leaks
from strandloom.llm.exact_dedup import drop_exact_copies
from strandloom.llm.jaccard_join import drop_near_copies
from strandloom.llm.packing import pack_documents
from strandloom.llm.quality import keep_good

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return drop_exact_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that the remaining documents are packed into."""
    return pack_documents(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, exact_dedup, ngram_jaccard_join, benchmark_decontamination, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as whole:
        for name, stage in STAGES[:-1]:
            with scratch() as work:
                docs = work.keep(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return whole.keep(stage(spark, docs, sf_dir), name)
