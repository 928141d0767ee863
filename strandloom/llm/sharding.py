"""Sharding by jump consistent hashing: a row's shard follows from its key and the number of shards alone.

No ring table is kept, and when shards are appended only the rows that the new shards take move.  A row's slot is its
gapless place in its shard, in order of key (null first), size and checksum: rows are sorted in ranges of shard and key,
a few per shard or many, and the ranges' parts of a shard are offset by a running sum over their counts, so no task holds
a shard, and a key with very many rows is in several ranges.

Edge cases: a null key counts as 0 (such rows share a shard), a null text has no bytes, and
repeated rows get slots of their own.  Ties are broken by size and checksum, so equal rows are interchangeable.
An empty table gives an empty result; columns other than the key and the text are not read.  A column of the result
that the key is called like gets an underscore more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import free_names, materialize

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key (Lamping and Veach, 2014), for all keys at once."""
    key = keys.astype(np.uint64, copy=True)
    bucket, jump = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = jump[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        with np.errstate(over="ignore"):
            jump[live] = ((bucket[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def jump(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def stable_key(docs: DataFrame, key: str) -> Column:
    """A 64-bit key: integers themselves (null: 0), other types by their hash."""
    integral = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)) if integral else F.xxhash64(F.col(f"`{key}`"))


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", piece_rows: int = 25_000, most_pieces: int = 20_000) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard (the shard with one shard more) of each row.

    piece_rows, most_pieces: rows that a sorted range has about, as far as so many ranges do; slots don't depend on them.
    """
    bytes_ = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(bytes_).cast("long") + 16).alias("size"), F.crc32(bytes_).alias("text_crc32"), stable_key(docs, key).alias("hash_key"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    rows = materialize(rows.select("*", shard_of(F.col("hash_key"), shards).alias("shard"), shard_of(F.col("hash_key"), shards + 1).alias("grown_shard")).drop("hash_key"), "shards")
    pieces = min(most_pieces, max(1, -(-rows.count() // piece_rows)))
    order = [F.col("shard"), F.col("key").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("tie")]
    ranges = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    ranges = materialize(ranges.select("*", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("place")).drop("tie"), "ranges")
    counts = ranges.groupBy("shard", "piece").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    numbered = ranges.join(F.broadcast(offsets), ["shard", "piece"])
    size, crc, law, shard, slot, grown = free_names(docs.select(F.col(f"`{key}`")), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return numbered.select(F.col("key").alias(key), F.col("size").alias(size), F.col("text_crc32").alias(crc), F.lit("key").alias(law), F.col("shard").alias(shard), (F.col("offset") + F.col("place")).cast("long").alias(slot), F.col("grown_shard").alias(grown))
