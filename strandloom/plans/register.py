"""The register of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as a query of its name, with SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return register


#: Bytes of a table, as stored, for each partition that adaptive execution starts a shuffle with.
PIECE = 2 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes at most of shuffled partitions that are joined into one, and of an Arrow batch; defaults are far larger.
BOUNDS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _bytes(size: str) -> int:
    digits = size.strip().lower().rstrip("bkmg")
    return int(digits) * _UNITS[size.strip().lower()[len(digits) :]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.

    The session's shuffles start with partitions in proportion to the largest table read so far, and adaptive execution
    joins small ones up to a few MB only, so that what a task sorts or counts in memory doesn't grow with the table; nor
    does an Arrow batch grow with the length of texts.
    """
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    now = int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if size // PIECE > now:
        spark.conf.set(_INITIAL, str(size // PIECE))
    for key, most in BOUNDS.items():
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return read
