"""Operators on unbounded input: reads are sketched as they arrive, and gap clusters become session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.sketch import shimmers
from strandloom.params import Params


def stream_shimmers(reads: DataFrame, p: Params) -> DataFrame:
    """The sketch of each read of a stream (rid, seq); sketching needs no state, so no watermark."""
    return shimmers(reads, p)


def stream_sessions(events: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Keys, bgn, end and count of runs of events with gaps under `gap`; events later than `late` are dropped."""
    window = F.session_window(at, gap)
    grouped = events.withWatermark(at, late).groupBy(*keys, window.alias("session"))
    return grouped.agg(F.min(at).alias("bgn"), F.max(at).alias("end"), F.count("*").alias("count")).drop("session")
