"""Count-min sketch over 64-bit keys, kept sparse per partition, merged by chunks of cells, broadcast as a bitmap.

Only "at least two" matters to the callers, so counters saturate at two.  A partition sends the cells that its own keys
touch; a chunk of cells is merged in one place; the merged sketch is one bit per cell and row, of a size fixed by `bits`
(2**bits / 4 bytes for the two rows), which bounds what is collected and broadcast.  A key's estimate is never under
its count, so a key estimated unique is unique; with more keys than cells the sketch filters less but loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm.common import mix64

ROWS, CHUNK = 2, 16
#: Cells of a row, as a power of two: the merged sketch has at most 64 MB.
MOST_BITS, LEAST_BITS = 28, 20
SCHEMA = "chunk int, once binary, more binary"
_ARROW = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def bits_for(keys: int) -> int:
    """About eight cells a key."""
    return min(MOST_BITS, max(LEAST_BITS, int(8 * max(keys, 1)).bit_length()))


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix64(keys ^ _SALTS[row]) >> np.uint64(64 - bits)


def partial(keys: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """The sketch of these keys (one entry per counted occurrence)."""
    every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    for row in range(ROWS):
        cells, counts = np.unique(cells_of(every, row, bits), return_counts=True)
        chunk, cell = (cells >> np.uint64(CHUNK)).astype(np.int64), (cells & np.uint64((1 << CHUNK) - 1)).astype("<u2")
        ends = np.searchsorted(chunk, np.arange((1 << (bits - CHUNK)) + 1))
        chunks, once, more = [], [], []
        for k in np.flatnonzero(ends[1:] > ends[:-1]):
            c, n = cell[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
            chunks.append((row << (bits - CHUNK)) + int(k))
            once.append(c[n == 1].tobytes())
            more.append(c[n > 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=_ARROW)


def _merge(table: pa.Table) -> pa.Table:
    count = np.zeros(1 << CHUNK, np.uint8)
    for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True):
        one = np.frombuffer(once, "<u2")
        count[one] = np.minimum(count[one] + 1, 2)
        count[np.frombuffer(more, "<u2")] = 2
    return pa.table({"chunk": table.column("chunk").combine_chunks()[:1], "bits": pa.array([np.packbits(count > 1).tobytes()], pa.binary())})


def merged(partials: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of cells counted twice or more: chunks are merged by key, then gathered, at most 2**bits / 4 bytes."""
    out = np.zeros(ROWS << (bits - 3), np.uint8)
    size = 1 << (CHUNK - 3)
    for row in partials.groupBy("chunk").applyInArrow(_merge, "chunk int, bits binary").toLocalIterator():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def repeated(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch estimates at least two of each key."""
    out = np.ones(len(keys), bool)
    for row in range(ROWS):
        cell = cells_of(keys, row, bits) + np.uint64(row << bits)
        out &= (bitmap[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out
