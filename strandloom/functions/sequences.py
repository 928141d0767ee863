"""Scalar functions on sequences over the letters ACGT, as Column expressions wherever Catalyst can express them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2-bit codes of the bases, and flags in the two bits above them.
CODES = {"A": 0, "C": 1, "G": 2, "T": 3}
HOMOPOLYMER, DIMER, OTHER = 4, 8, 12
#: Bases whose positions are held at a time.
SLICE = 1 << 18

_CODE = np.full(256, OTHER, np.uint8)
for _base, _code in CODES.items():
    _CODE[ord(_base)] = _CODE[ord(_base.lower())] = _code
#: Runs of one base, or of two different bases in turn; what follows the first four bases of a run is its tail.
_RUN = re.compile(rb"([ACGT])\1+|([ACGT])(?!\2)([ACGT])(?:\2\3)+")


def text_to_sequence(text: Column) -> Column:
    """Letters of a text mapped to the four bases in turn (a to A, b to C, c to G, d to T, e to A and so on)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, ("ACGT" * 7)[:26])


def base_codes(seq: Column) -> Column:
    """The 2-bit codes as digits; a letter that is no base becomes a dot."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "."), "ACGT", "0123")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def fragment(seq: Column, bgn: Column, end: Column, strand: Column | None = None) -> Column:
    """Bases [bgn, end) of the sequence, or of its reverse complement where strand is 1."""
    forward = F.substring(seq, bgn + 1, end - bgn)
    if strand is None:
        return forward
    return F.when(strand == 1, F.substring(reverse_complement(seq), bgn + 1, end - bgn)).otherwise(forward)


def mask_quality(seq: Column, low: Column) -> Column:
    """Lower-case where quality is low."""
    return F.when(low, F.lower(seq)).otherwise(F.upper(seq))


def upper_runs(seq: Column) -> Column:
    """All runs of upper-case bases."""
    return F.regexp_extract_all(seq, F.lit("[ACGT]+"), F.lit(0))


def homopolymer_runs(seq: Column) -> Column:
    """All runs of two or more equal bases."""
    return F.regexp_extract_all(seq, F.lit("AA+|CC+|GG+|TT+"), F.lit(0))


def base_array(seq: bytes) -> np.ndarray:
    """Codes of the bases; other letters have code 12."""
    return _CODE[np.frombuffer(seq, np.uint8)]


def _cuts(seq: bytes) -> np.ndarray:
    """Places in seq that no run goes over: the search for runs can start or end there.

    There a base differs from the one before it, the base after differs from the one before, and the base itself from the
    one two before.
    """
    a = np.frombuffer(seq, np.uint8)
    over, two = a[1:] == a[:-1], a[2:] == a[:-2]
    over[:-1] |= two
    over[1:] |= two
    return np.flatnonzero(~over) + 1


def _long_runs(seq: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of seq that may hold a run of more than four bases, and that no run leaves or enters."""
    a, n = np.frombuffer(seq, np.uint8), len(seq)
    if n < 5:
        return
    one, two = a[1:] == a[:-1], a[2:] == a[:-2]
    # five equal bases, or two dimers in turn with two bases more
    long = np.concatenate([np.flatnonzero(x[:-3] & x[1:-2] & x[2:-1] & x[3:]) for x in (one, two)])
    if not len(long):
        return
    cuts = np.concatenate([[0], _cuts(seq), [n]])
    for k in np.unique(np.searchsorted(cuts, long, "right")).tolist():
        yield int(cuts[k - 1]), int(cuts[k])


def tail_flags(seq: bytes) -> np.ndarray:
    """Flag of each base: tail of a homopolymer, tail of a run of dimers, or none.  The last base joins no run."""
    out = np.zeros(len(seq), np.uint8)
    upper = seq.upper()
    for bgn, end in _long_runs(upper[:-1]):
        for run in _RUN.finditer(upper, bgn, end):
            out[run.start() + 4 : run.end()] = HOMOPOLYMER if run.group(1) else DIMER
    return out


def compressed(seq: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, positions) of the bases that are in no tail, without the last base."""
    codes = base_array(seq)
    keep = np.flatnonzero((tail_flags(seq) == 0) & (codes < 4))
    keep = keep[keep < len(seq) - 1]
    return codes[keep], keep


class Suffixes:
    """compressed() of the suffixes of a sequence, whose runs are looked for once, but for those that a suffix cuts."""

    def __init__(self, seq: bytes):
        self.seq, self.codes, self.flags = seq, base_array(seq), tail_flags(seq)
        self.cuts = _cuts(seq.upper()[:-1]) if len(seq) > 5 else np.empty(0, np.int64)

    def compressed(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        codes, flags = self.codes[at:], self.flags[at:]
        if at:
            k = int(np.searchsorted(self.cuts, at + 2))
            end = int(self.cuts[k]) if k < len(self.cuts) else len(self.seq)
            flags = np.concatenate([tail_flags(self.seq[at : end + 1])[: end - at], flags[end - at :]])
        keep = np.flatnonzero((flags[:-1] == 0) & (codes[:-1] < 4))
        return codes[keep], keep


def packed_strands(seq: bytes) -> bytes:
    """A byte per base: low four bits the base and its flags, high four bits the same of the reverse complement."""
    codes, flags = base_array(seq), tail_flags(seq)
    forward = np.where(codes == OTHER, OTHER, codes | flags)
    back = np.where(codes == OTHER, OTHER | 3, (codes ^ 3) | flags)[::-1]
    return (back.astype(np.uint8) << 4 | forward).tobytes()


@F.arrow_udf(T.BinaryType())
def pack_strands(seqs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Both strands of each sequence, packed."""
    for batch in seqs:
        yield pa.array([None if s is None else packed_strands(s.encode()) for s in batch.to_pylist()], pa.binary())


@F.arrow_udf(T.StructType([T.StructField("seq", T.StringType()), T.StructField("pos", T.ArrayType(T.IntegerType()))]))
def compress_runs(seqs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sequence without tails of runs, and the original position of each base; made for SLICE bases or so at a time."""
    letters, kind = np.frombuffer(b"ACGT", np.uint8), pa.struct([("seq", pa.string()), ("pos", pa.list_(pa.int32()))])

    def columns(texts: list[str], places: list[np.ndarray]) -> pa.Array:
        at = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32)
        pos = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int32), *places])))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pos.cast(kind.field("pos").type)], fields=list(kind))

    for batch in seqs:
        texts, places, n = [], [], 0
        for s in batch:
            codes, keep = compressed((s.as_py() or "").encode())
            texts.append(letters[codes].tobytes().decode())
            places.append(keep.astype(np.int32))
            n += len(keep)
            if n >= SLICE:
                yield columns(texts, places)
                texts, places, n = [], [], 0
        if texts:
            yield columns(texts, places)
