import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import hashing, sequences as S
from strandloom.params import Params


def test_mix_vectors_in_both_forms(spark):
    want = {1: 6614235796240398542, 123456789012345: 15798945862212523229}
    keys = np.array(list(want), np.uint64)
    assert hashing.mix(keys).tolist() == list(want.values())
    more = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    df = hashing.with_mix(spark.createDataFrame([(int(x),) for x in more], "x long"), "x")
    assert [r["x"] % 2**64 for r in df.collect()] == hashing.mix(more).tolist()


def naive_flags(seq):
    """Runs of one base, else of two in turn, scanned from the left; the last base joins none."""
    out, i, n = [0] * len(seq), 0, len(seq) - 1
    while i < n:
        j = i
        while j + 1 < n and seq[j + 1] == seq[i] and seq[i] in "ACGT":
            j += 1
        kind = S.HOMOPOLYMER
        if j == i and i + 1 < n and seq[i] in "ACGT" and seq[i + 1] in "ACGT":
            while j + 4 - (j - i) % 2 - 1 < n + 2 and j + 4 <= n + 1 and seq[j + 2 : j + 4] == seq[i : i + 2] and j + 3 < n:
                j += 2
            kind, j = S.DIMER, j + 1 if j > i else i
        if j > i:
            out[i + 4 : j + 1] = [kind] * max(0, j + 1 - i - 4)
            i = j + 1
        else:
            i += 1
    return out


def test_tail_flags():
    rng = random.Random(2)
    for seq in ["A" * 7, "ACACACACACT", "AACACACT", "AAAAAAN", "", "A", "ACACACAC"] + ["".join(rng.choice("AACCCGTN") for _ in range(rng.randrange(40))) for _ in range(500)]:
        assert S.tail_flags(seq.encode()).tolist() == naive_flags(seq), seq


def test_strands_and_compression(spark):
    df = spark.createDataFrame([("ACGTTTTTTTA",), ("NNacgt",), ("",), (None,)], "seq string")
    out = df.select(S.reverse_complement(F.col("seq")).alias("rc"), S.base_codes(F.col("seq")).alias("codes"), S.pack_strands("seq").alias("packed"), S.compress_runs("seq").alias("hpc")).collect()
    assert out[0]["rc"] == "TAAAAAAACGT" and out[0]["codes"] == "01233333330" and out[1]["codes"] == "..0123"
    assert out[0]["hpc"]["seq"] == "ACGTTTT" and out[0]["hpc"]["pos"] == [0, 1, 2, 3, 4, 5, 6]
    packed = out[0]["packed"]
    assert len(packed) == 11 and packed[0] & 3 == 0 and packed[0] >> 4 & 3 == 3 and packed[8] & 4
    assert out[1]["packed"][0] & 15 == 12 and out[3]["packed"] is None and out[2]["packed"] == b""


def test_fragments_and_masks(spark):
    df = spark.createDataFrame([("AACCGGTT", 1, 4, 0), ("AACCGGTT", 1, 4, 1)], "seq string, b int, e int, s int")
    out = df.select(S.fragment(F.col("seq"), F.col("b"), F.col("e"), F.col("s")).alias("f"), S.mask_quality(F.col("seq"), F.col("s") == 1).alias("m"), S.upper_runs(F.lit("acGTAnCC")).alias("u")).collect()
    assert [r["f"] for r in out] == ["ACC", "ACC"] and out[1]["m"] == "aaccggtt" and out[0]["u"] == ["GTA", "CC"]


def test_parameters_are_checked():
    for bad in ({"k": 57}, {"w": 129}, {"r": 0}, {"r": 13}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_runs_are_compressed_in_slices():
    """What a batch of reads becomes is made a slice at a time, with the same rows."""
    seqs = ["ACGT" * 30_000, None, "", "AAAAAAAAC"] * 5
    parts = list(S.compress_runs.func(iter([pa.array(seqs)])))
    assert len(parts) > 1 and max(len(p.field("pos").flatten()) for p in parts) <= S.SLICE + 120_000
    got = [r for p in parts for r in p.to_pylist()]
    for s, r in zip(seqs, got, strict=True):
        codes, keep = S.compressed((s or "").encode())
        assert r["pos"] == keep.tolist() and r["seq"] == "".join("ACGT"[c] for c in codes)


def test_tails_are_looked_for_near_long_runs_only():
    """The runs found near long ones are those of a search of the whole sequence."""
    rng = random.Random(4)
    for n in range(400):
        parts = rng.choices(["A", "C", "G", "T", "AT", "GC", "ATAT", "CCC", "a", "n", "tata"], k=n % 80)
        seq = "".join(parts).encode()
        flags = np.zeros(len(seq), np.uint8)
        for run in S._RUN.finditer(seq.upper(), 0, max(0, len(seq) - 1)):
            flags[run.start() + 4 : run.end()] = S.HOMOPOLYMER if run.group(1) else S.DIMER
        assert (S.tail_flags(seq) == flags).all()
    plain = bytes(rng.choices(b"ACGT", k=100_000))
    assert sum(end - bgn for bgn, end in S._long_runs(plain)) < 20_000


def test_suffixes_are_compressed_like_sequences_of_their_own(monkeypatch):
    """Runs that a suffix cuts, at every place, and a whole sequence's runs are looked for once."""
    rng = random.Random(8)
    pieces = ["A" * 7, "ACACACAC", "GTGTGTGTGT", "acacACAC", "NNNNNNN", "ACGT", "G", "TTTTTG", "CACAAAAAAC"]
    seqs = ["".join(rng.choice(pieces) if rng.random() < 0.4 else rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 7, 30, 60, 60, 60, 90)]
    for seq in (s.encode() for s in [*seqs, "A" * 40, "AC" * 20]):
        suffixes = S.Suffixes(seq)
        for at in range(len(seq) + 1):
            got, want = suffixes.compressed(at), S.compressed(seq[at:])
            assert [x.tolist() for x in got] == [x.tolist() for x in want], (seq, at)
    looked, real = [], S.tail_flags
    monkeypatch.setattr(S, "tail_flags", lambda s: looked.append(len(s)) or real(s))
    plain = "".join(rng.choice("ACGT") for _ in range(5000)).encode()
    suffixes = S.Suffixes(plain)
    for at in range(0, 4000, 500):
        suffixes.compressed(at)
    assert sum(looked) < 2 * len(plain)
