"""Shared pieces of the corpus operators: shared-folder tables, bounded blocks of texts, word hashes.

Word hashing works on the UTF-8 bytes of a whole block of texts with array operations, so no Python object is made
for a word.  A word's hash is a polynomial over random 64-bit byte values, mixed at the end with the word's length.
"""

from __future__ import annotations

import atexit
import ctypes
import inspect
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Arrow batches have at most so many rows and bytes, since a row can be a whole text.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_tables: list[tuple[SparkSession, str]] = []
_open = threading.local()
_fallback: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _fallback:
        holder = tempfile.TemporaryDirectory(prefix="strandloom-")
        atexit.register(holder.cleanup)
        _fallback["dir"] = holder.name
    return _fallback["dir"]


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, once, where they aren't bounded closer already."""
    for name, most in ARROW.items():
        if int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, str(most))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{work_dir(spark)}/strandloom-{tag}-{uuid.uuid4().hex}"
    (_open.tables[-1] if getattr(_open, "tables", None) else _tables).append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class scratch:
    """A block whose tables are deleted at its end, but for those given to keep(), which the block around it owns.

    Only tables that this thread writes meanwhile are meant, so queries beside it keep theirs.
    """

    def __enter__(self) -> "scratch":
        if not hasattr(_open, "tables"):
            _open.tables = []
        _open.tables.append([])
        return self

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out = materialize(df, tag)
        own = _open.tables[-1].pop()
        (_open.tables[-2] if len(_open.tables) > 1 else _tables).append(own)
        return out

    def __exit__(self, *error) -> None:
        for table in _open.tables.pop():
            _delete(*table)


def clear_work() -> None:
    """Delete the tables that materialize() wrote; call it when the results built on them have been stored."""
    while _tables:
        _delete(*_tables.pop())


def at_exit() -> None:
    try:
        clear_work()
    except Exception:  # noqa: BLE001  the session may be gone already
        _tables.clear()


atexit.register(at_exit)


def release() -> None:
    """Give freed memory back to the system, so that idle Python workers hold little beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(task):
    """The task on batches, or on a group's table, with freed memory given back when its frame is gone."""

    def batches_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release()

    def group(table: pa.Table) -> pa.Table:
        out = task(table)
        release()
        return out

    return batches_ if inspect.isgeneratorfunction(task) else group


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of the public MurmurHash3)."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts in one array, offsets of the texts in it); a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return bytes_, at - at[0]


def blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text (a longer text stands alone)."""
    _, at = text_bytes(texts)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_spans(bytes_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each word, and the number of words before each text and in all."""
    if not len(bytes_):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    space = _IS_SPACE[bytes_]
    before, after = np.ones(len(space), bool), np.ones(len(space), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edge = at[(at > 0) & (at < len(space))]
    before[edge], after[edge - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, word offsets of the texts); lower: A-Z count as a-z."""
    bytes_, at = text_bytes(texts)
    starts, ends, words = word_spans(bytes_, at)
    if not len(starts):
        return np.empty(0, np.uint64), words
    up, down = BYTE_POWERS.upto(len(bytes_))
    sums = np.zeros(len(bytes_) + 1, np.uint64)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[bytes_] * up[: len(bytes_)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64)), words


class Roll:
    """Hashes of runs of words of a fixed length, in constant time a word."""

    def __init__(self, base: int):
        self.powers = Powers(base | 1)

    def __call__(self, words: np.ndarray, length: int) -> np.ndarray:
        n = len(words) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        up, down = self.powers.upto(len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix64((sums[length:] - sums[:n]) * down[:n])


def order_within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by group (small integers), then value; few groups are sorted by radix."""
    if not len(group) or int(group.max()) >= 1 << 16:
        return np.lexsort((value, group))
    order = np.argsort(value)
    return order[np.argsort(group[order].astype(np.uint16), kind="stable")]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
