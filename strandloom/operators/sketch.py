"""Hierarchical minimizers ("shimmers") of reads.

The production path makes each read's sketch inside an Arrow batch with array operations, so no k-mer becomes a row and
nothing is shuffled.  The native path expresses the same by two nested windows over k-mer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.hashing import HASH_BITS, mix
from strandloom.functions.sequences import base_array
from strandloom.params import Params
from strandloom.plans.lineage import spread

MM_SCHEMA = "rid long, pos int, strand int, span int, mhash long"
_TOP = np.uint64(2**64 - 1)


def _windows(bits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the k bits from each place on, the first bit highest; of their complements, the first bit lowest.

    Windows of a power of two are made of two of half the length, and one of k of those in its binary form.
    """
    n = len(bits) - k + 1
    forward, back, done = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 0
    f, b, m = bits, bits ^ np.uint64(1), 1
    while m <= k:
        if k & m:
            forward = forward << np.uint64(m) | f[done : done + n]
            back |= b[done : done + n] << np.uint64(done)
            done += m
        if 2 * m <= k:
            f, b = f[:-m] << np.uint64(m) | f[m:], b[:-m] | b[m:] << np.uint64(m)
        m *= 2
    return forward, back


def kmer_arrays(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end position, strand, hash) of the k-mers that end at base k or later and aren't their own reverse complement.

    A k-mer is two words, of the low and of the high bits of its codes; the strand is chosen by the low words only.
    Letters that are no base count as A.
    """
    codes = base_array(seq) & 3
    n = len(codes) - k
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    words = []
    for bit in (codes & 1, codes >> 1):
        words.append(_windows(bit[1:].astype(np.uint64), k))
    (f0, r0), (f1, r1) = words
    keep = np.flatnonzero((f0 != r0) | (f1 != r1))
    strand = (r0 < f0)[keep]
    low, high = np.where(strand, r0[keep], f0[keep]), np.where(strand, r1[keep], f1[keep])
    return keep + k, strand.astype(np.int64), (mix(low) ^ mix(high)) & np.uint64(2**HASH_BITS - 1)


def _trailing_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of the w values up to each place; fewer at the start."""
    padded = np.concatenate([np.full(w - 1, _TOP), x])
    wide = 1
    while wide * 2 <= w:
        padded, wide = np.minimum(padded[:-wide], padded[wide:]), wide * 2
    return np.minimum(padded[: len(padded) - (w - wide)], padded[w - wide :]) if w > wide else padded


def _leading_max(x: np.ndarray, w: int) -> np.ndarray:
    return ~_trailing_min(~x[::-1], w)[::-1]


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places that are the smallest of a window of w; windows are cut short at the start; ties are kept."""
    return np.flatnonzero(h == _leading_max(_trailing_min(h, w), w)) if len(h) else np.empty(0, np.int64)


def reduce_once(h: np.ndarray, r: int) -> np.ndarray:
    """Places that are the smallest of a whole window of r."""
    if len(h) < r:
        return np.empty(0, np.int64)
    least = _trailing_min(h, r)
    least[: r - 1] = 0
    best = _leading_max(least, r)
    return np.flatnonzero(h == best)


def shimmer_arrays(seq: bytes, p: Params, reductions: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos, strand, h = kmer_arrays(seq, p.k)
    chosen = np.flatnonzero(pos >= max(p.k, p.w))
    pos, strand, h = pos[chosen], strand[chosen], h[chosen]
    for step in (lambda x: winnow(x, p.w), *[lambda x: reduce_once(x, p.r)] * reductions):
        chosen = step(h)
        pos, strand, h = pos[chosen], strand[chosen], h[chosen]
    return pos, strand, h


def _per_read(reads: DataFrame, arrays, kinds: str = MM_SCHEMA) -> DataFrame:
    """The rows that arrays() makes of each read, without its rid."""
    schema = pa.schema([(c, pa.int64() if kind == "long" else pa.int32()) for c, kind in (field.split() for field in kinds.split(", "))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], 0
            for rid, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = arrays((seq or "").encode())
                out.append((np.full(len(found[0]), -1 if rid is None else rid), *found))
                n += len(found[0])
                if n >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, n = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = reads.select(F.col("rid").cast("long"), "seq")
    return (rows if rows.isStreaming else spread(rows)).mapInArrow(sketch, kinds)


def _with_span(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    pos, strand, h = found
    return pos, strand, np.full(len(pos), k), h.view(np.int64)


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """A row for each k-mer of each read (rid, seq)."""
    return _per_read(reads, lambda s: _with_span(kmer_arrays(s, k), k))


def shimmers(reads: DataFrame, p: Params, reductions: int = 2) -> DataFrame:
    """The sketch of each read: minimizers of windows of w, then of windows of r among them, twice."""
    return _per_read(reads, lambda s: _with_span(shimmer_arrays(s, p, reductions), p.k))


def minimizers_native(mers: DataFrame, p: Params) -> DataFrame:
    """Level 0 by windows over k-mer rows."""
    order = Window.partitionBy("rid").orderBy("pos")
    rows = mers.where(F.col("pos") >= max(p.k, p.w)).withColumn("least", F.min("mhash").over(order.rowsBetween(1 - p.w, 0)))
    return rows.withColumn("best", F.max("least").over(order.rowsBetween(0, p.w - 1))).where("mhash = best").drop("least", "best")


def reduce_native(mers: DataFrame, r: int) -> DataFrame:
    """One reduction by windows over minimizer rows."""
    order = Window.partitionBy("rid").orderBy("pos")
    least = F.when(F.row_number().over(order) >= r, F.min("mhash").over(order.rowsBetween(1 - r, 0)))
    rows = mers.withColumn("least", least)
    return rows.withColumn("best", F.max("least").over(order.rowsBetween(0, r - 1))).where("mhash = best").drop("least", "best")


def shimmer_pairs(mm: DataFrame) -> DataFrame:
    """Adjacent shimmers of a read: (rid, h0, p0, st0, h1, p1, st1, span)."""
    order = Window.partitionBy("rid").orderBy("pos")
    nxt = F.lead(F.struct("mhash", "pos", "strand")).over(order)
    return mm.withColumn("next", nxt).where("next is not null").select(
        "rid", F.col("mhash").alias("h0"), F.col("pos").alias("p0"), F.col("strand").alias("st0"), F.col("next.mhash").alias("h1"), F.col("next.pos").alias("p1"), F.col("next.strand").alias("st1"), "span"
    )


def read_pairs(reads: DataFrame, p: Params) -> DataFrame:
    """shimmer_pairs() of the shimmers() of reads with different rids, made where the sketch is made: nothing is shuffled."""

    def pairs(seq: bytes) -> tuple[np.ndarray, ...]:
        pos, strand, h = shimmer_arrays(seq, p)
        h = h.view(np.int64)
        return h[:-1], pos[:-1], strand[:-1], h[1:], pos[1:], strand[1:], np.full(max(0, len(h) - 1), p.k)

    return _per_read(reads, pairs, "rid long, h0 long, p0 int, st0 int, h1 long, p1 int, st1 int, span int")


#: Parameters of the offset of two overlapping sequences.
OFFSET_PARAMS = Params(w=24, k=24, r=1)


def sketch_offset(a: bytes, b: bytes, p: Params = OFFSET_PARAMS) -> tuple[int, int] | None:
    """Positions in a and b of the first minimizer of b that stands once in each and has the same strand."""
    (pa_, sa, ha), (pb, sb, hb) = shimmer_arrays(a, p), shimmer_arrays(b, p)
    once = lambda h: {int(v): int(i) for v, i, c in zip(*np.unique(h, return_index=True, return_counts=True), strict=True) if c == 1}
    in_a, in_b = once(ha), once(hb)
    for h, j in sorted(in_b.items(), key=lambda x: x[1]):
        i = in_a.get(h)
        if i is not None and sa[i] == sb[j]:
            return int(pa_[i]), int(pb[j])
    return None


def mask_intervals(seq: bytes) -> list[tuple[int, int]]:
    """[bgn, end) of the runs of upper-case bases."""
    upper = np.isin(np.frombuffer(seq, np.uint8), np.frombuffer(b"ACGT", np.uint8)).astype(np.int8)
    step = np.diff(np.concatenate([[0], upper, [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
