"""Cutting lineage in iterative plans, by tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, tempfile.TemporaryDirectory] = {}
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder serves on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "" not in _local:
        _local[""] = tempfile.TemporaryDirectory(prefix="strandloom-")
        atexit.register(_local[""].cleanup)
    return _local[""].name


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder and read back.

    Unlike a checkpoint, the table's size is known to the planner; estimates of a checkpoint carry over from the plan
    before, and in loops of joins they grow without bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandloom-cut-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables() -> None:
    """Delete the tables that cut_lineage() wrote; call it when the results built on them have been stored."""
    while _tables:
        spark, path = _tables.pop()
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    try:
        clear_tables()
    except Exception:  # noqa: BLE001  the session may be gone already
        _tables.clear()


atexit.register(_at_exit)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer files than there are cores (few tasks, before costly kernels)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df
