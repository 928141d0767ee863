import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions.hashing import mix
from strandloom.operators import candidates, sketch
from strandloom.params import Params

P = Params(w=16, k=15, r=3)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def naive_kmers(seq, k):
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    out = []
    for end in range(k, len(seq)):
        word = [code.get(c, 0) for c in seq[end - k + 1 : end + 1]]
        back = [3 - c for c in reversed(word)]
        plane = lambda w, b: sum(((c >> b) & 1) << (k - 1 - i) for i, c in enumerate(w))
        f, r = (plane(word, 0), plane(word, 1)), (plane(back, 0), plane(back, 1))
        if f == r:
            continue
        strand = int(r[0] < f[0])
        lo, hi = r if strand else f
        h = int(mix(np.array([lo], np.uint64))[0] ^ mix(np.array([hi], np.uint64))[0]) & (2**56 - 1)
        out.append((end, strand, h))
    return out


def naive_shimmers(seq, p):
    """A stateful scan with a buffer of the last w k-mers, and then of the last r minimizers, twice."""
    found, buffer, least, gap = [], [], None, 0
    for pos, strand, h in naive_kmers(seq, p.k):
        buffer = [*buffer, (pos, strand, h)][-p.w :]
        if gap == p.w - 1:
            low = min(b[2] for b in buffer)
            ties = [b for b in buffer if b[2] == low]
            found += ties
            least, gap = ties[-1], pos - ties[-1][0]
        elif (least is None or h <= least[2]) and pos >= p.w:
            least, gap = (pos, strand, h), 0
            found.append(least)
        else:
            gap += 1
    for _ in range(2):
        if len(found) < p.r:
            return []
        keep = set()
        for i in range(len(found) - p.r + 1):
            part = range(i, i + p.r)
            low = min(found[j][2] for j in part)
            keep |= {j for j in part if found[j][2] == low}
        found = [found[j] for j in sorted(keep)]
    return found


def test_arrays_match_a_stateful_scan():
    rng = random.Random(4)
    for n in (0, 10, 15, 16, 40, 200, 700, 2000):
        seq = dna(rng, n) + ("ACGGT" * 20 if n == 700 else "")
        pos, strand, h = sketch.kmer_arrays(seq.encode(), P.k)
        assert list(zip(pos.tolist(), strand.tolist(), h.tolist())) == naive_kmers(seq, P.k)
        pos, strand, h = sketch.shimmer_arrays(seq.encode(), P)
        assert list(zip(pos.tolist(), strand.tolist(), h.tolist())) == naive_shimmers(seq, P)


def test_native_windows_equal_the_arrays(spark):
    rng = random.Random(5)
    reads = spark.createDataFrame([(k, dna(rng, 600)) for k in range(5)] + [(9, "ACG"), (10, None)], "rid long, seq string")
    native = sketch.minimizers_native(sketch.kmers(reads, P.k), P)
    for level in (0, 1, 2):
        key = lambda df: sorted(tuple(r) for r in df.select("rid", "pos", "strand", "span", "mhash").collect())
        assert key(native) == key(sketch.shimmers(reads, P, level))
        native = sketch.reduce_native(native, P.r)


def test_hits_find_both_strands(spark):
    rng = random.Random(6)
    genome = dna(rng, 3000)
    back = genome[500:2500][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(0, genome[:2000]), (1, genome[700:2900]), (2, back)], "rid long, seq string")
    pairs = sketch.shimmer_pairs(sketch.shimmers(reads, P))
    hits = candidates.pair_hits(pairs, P)
    clusters = {(r["rid0"], r["rid1"]): r for r in candidates.hit_clusters(hits, P).collect()}
    assert clusters[0, 1]["strand"] == 0 and clusters[0, 1]["bgn"] == clusters[0, 1]["end"] == 700
    assert clusters[1, 0]["bgn"] == -700 and clusters[2, 0]["strand"] == 1 and clusters[2, 0]["bgn"] == 2499
    assert (0, 2) not in clusters  # its reversed pairs stand in one read only, so the index leaves them out
    stats = {r["rid"]: r for r in candidates.read_stats(pairs, candidates.hit_clusters(hits, P), P).collect()}
    assert stats[0]["lookups"] > 3 and stats[0]["clusters"] == 1 and stats[2]["clusters"] == 2
    few = Params(w=16, k=15, r=3, max_postings=2)
    assert candidates.pair_hits(pairs, few).count() == 0


def test_long_lists_meet_in_cells_of_bounded_size(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, 5, 9, k % 7, k % 7 + 20, 15) for k in range(400)] + [(k % 30, 9, 5, k, k + 11, 15) for k in range(90)] + [(k, 5, 5, 3, 9, 15) for k in range(3)] + [(7, 1, 2, 0, 4, 15)]
    rows += [(rng.randrange(9), rng.randrange(4), rng.randrange(4), rng.randrange(50), 60, 15) for _ in range(200)]
    pairs = spark.createDataFrame(rows, "rid long, h0 long, h1 long, p0 int, p1 int, span int")
    size = Counter((r[1], r[2]) for r in rows)
    met = lambda h, most: 2 <= size[h] < most
    for grid, most in ((16, 12000), (512, 300)):
        monkeypatch.setattr(candidates, "GRID", grid)
        p = Params(w=16, k=15, r=3, max_postings=most)
        want = Counter((a[0], b[0], False, a[3] - b[3]) for a in rows for b in rows if a[1] != a[2] and a[1:3] == b[1:3] and a[0] != b[0] and met(b[1:3], most))
        want += Counter((a[0], b[0], True, a[4] + b[3] - a[5] + 1) for a in rows for b in rows if a[1] != a[2] and a[1:3] == b[2:0:-1] and a[0] != b[0] and met(b[1:3], most))
        assert Counter(tuple(r) for r in candidates.pair_hits(pairs, p).collect()) == want
    monkeypatch.setattr(candidates, "GRID", 16)
    cells = candidates._gridded(candidates.sized_pairs(pairs).where("h0 = 5 and h1 = 9"), "postings", "postings", "i", "j").groupBy("i", "j").count().collect()
    assert len(cells) == (-(-size[5, 9] // 16)) ** 2 and max(r["count"] for r in cells) <= 3 * 16


def test_cluster_counts(spark):
    offs = {0: [0, 1, 2], 1: [0, 1, 2, 3], 2: [0, 1, 2, 100, 101, 102, 103]}
    hits = spark.createDataFrame([(0, r, False, o) for r, xs in offs.items() for o in xs], "rid0 long, rid1 long, rev boolean, off int")
    got = lambda p: sorted((r["rid1"], r["bgn"], r["end"], r["count"]) for r in candidates.hit_clusters(hits, p).collect())
    assert got(P) == [(0, 0, 2, 3), (1, 0, 3, 4), (2, 0, 2, 3), (2, 100, 103, 4)]
    assert got(Params(w=16, k=15, r=3, compat=True)) == [(1, 0, 3, 3), (2, 0, 2, 3), (2, 100, 103, 3)]
    assert hits.where(F.lit(False)).transform(lambda h: candidates.hit_clusters(h, P)).count() == 0


def test_clusters_of_pairs_are_those_of_their_hits(spark):
    """Reads in copies, turned round and with tandem runs; hits of equal offsets are counted, and each pair is met once."""
    rng = random.Random(11)
    base = [dna(rng, 400) for _ in range(3)]
    seqs = [base[rng.randrange(3)][rng.randrange(60) :] + "ACGGT" * rng.randrange(30) for _ in range(30)]
    seqs += [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in seqs[:8]]
    pairs = sketch.shimmer_pairs(sketch.shimmers(spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string"), P)).cache()
    for p in (P, Params(w=16, k=15, r=3, compat=True), Params(w=16, k=15, r=3, max_postings=12, gap=5)):
        want = Counter(tuple(r) for r in candidates.hit_clusters(candidates.pair_hits(pairs, p), p).collect())
        assert len(want) > 50 and {r[2] for r in want} == {0, 1}
        assert Counter(tuple(r) for r in candidates.pair_clusters(pairs, p).collect()) == want
    naive = [(r["rid0"], r["rid1"], r["rev"], r["off"]) for r in candidates.pair_hits(pairs, P).collect()]
    runs = Counter()
    for key in {x[:3] for x in naive}:
        at = sorted(x[3] for x in naive if x[:3] == key)
        cuts = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] > P.gap), len(at)]
        runs.update((*key[:2], int(key[2]), at[a], at[b - 1], b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b - a >= P.min_hits)
    assert Counter(tuple(r) for r in candidates.pair_clusters(pairs, P).collect()) == runs


def test_equal_reads_are_met_once(spark):
    """Clusters, the first of each read and their numbers are the same, whether or not equal reads are met once."""
    rng = random.Random(12)
    base = [dna(rng, 300) for _ in range(2)]
    seqs = [base[k % 2][rng.randrange(60) :] + "ACGGT" * rng.randrange(9) for k in range(8)]
    seqs += [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in seqs[:3]] + [dna(rng, 40) * 9]
    seqs = [s for k, s in enumerate(seqs) for _ in range(1 + 4 * (k % 3 == 2))]
    rng.shuffle(seqs)
    reads = spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string").cache()
    pairs, same = sketch.shimmer_pairs(sketch.shimmers(reads, P)).cache(), candidates.copies(reads)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    for p in (Params(w=16, k=15, r=3, max_tries=5), Params(w=16, k=15, r=3, max_tries=2, compat=True), Params(w=16, k=15, r=3, max_postings=14, max_tries=40)):
        whole, once = candidates.pair_clusters(pairs, p).cache(), candidates.group_clusters(pairs, p, same).cache()
        assert rows(candidates.pair_clusters(pairs, p, same)) == rows(whole) and once.count() < whole.count() / 2
        top = candidates.top_clusters(whole, p)
        assert rows(candidates.top_group_clusters(once, same, p).select(top.columns)) == rows(top)
        assert rows(candidates.read_stats(pairs, candidates.clusters_of_reads(once, same), p)) == rows(candidates.read_stats(pairs, whole, p))


def test_lists_that_follow_each_other_meet_as_one(spark):
    """Near copies: hits of one offset come in few rows, and a pair of reads has them in one place from one shuffle on."""
    rng = random.Random(13)
    base = dna(rng, 3000)
    seqs = [base[k * 7 : 2000 + rng.randrange(900)] for k in range(12)]
    seqs = [s[:900] + dna(rng, 1) + s[900 + k % 3 :] for k, s in enumerate(seqs)] + [base[::-1].translate(str.maketrans("ACGT", "TGCA"))] * 2
    reads = spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string").cache()
    pairs = sketch.read_pairs(reads, P).cache()
    assert Counter(tuple(r) for r in pairs.collect()) == Counter(tuple(r) for r in sketch.shimmer_pairs(sketch.shimmers(reads, P)).collect())
    every = Counter(tuple(r) for r in candidates.pair_hits(pairs, P).collect())
    rows = candidates.chained(pairs, P)
    hits = candidates.forward_hits(rows, P).unionByName(candidates.reverse_hits(rows, P))
    found = hits.collect()
    summed = Counter()
    for *hit, n in found:
        summed[tuple(hit)] += n
    assert summed == every and 4 * len(found) < sum(every.values()) and {h[2] for h in every} == {False, True}
    few = rows.count()
    assert 4 * few < pairs.count() * 3 and rows.where("role = 0").groupBy("crid", "block", "sub").count().count() < pairs.select("h0", "h1").distinct().count() / 4
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(candidates._runs(candidates.cut_lineage(hits), P)) == 1 and shuffles(candidates.sized_pairs(candidates.cut_lineage(pairs))) == 1
