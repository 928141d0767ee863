"""Mapping of contigs by shared shimmer pairs: interval maps, range queries, chains, duplicates, haplotype relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.sequences import compressed
from strandloom.operators.align import align, oriented
from strandloom.operators.sketch import shimmer_pairs, shimmers
from strandloom.params import Params
from strandloom.plans.lineage import cut_lineage

INTERVAL = ["sid0", "b0", "e0", "sid1", "b1", "e1", "orient"]
#: Fixed values of the chain rules.
AHEAD, DRIFT, SPAN, LEAST_CHAIN = 25, 0.2, 100_000, 4


def interval_map(mm0: DataFrame, mm1: DataFrame, max_hits: int = 32) -> DataFrame:
    """Intervals of two sets of sequences that share an adjacent pair of shimmers on consistent strands.

    orient 0: same direction; 1: reversed.  Pairs in more than max_hits places of the second set are skipped.
    """
    b = cut_lineage(shimmer_pairs(mm1))
    few = b.groupBy("h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") <= max_hits).select("h0", "h1")
    b = b.join(few, ["h0", "h1"], "left_semi")
    # a pair stands under both directions in the second set, so the first set is sketched and met once
    side = lambda h0, h1, st0, st1, orient: b.select(F.col(h0).alias("h0"), F.col(h1).alias("h1"), st0.alias("st0"), st1.alias("st1"), F.col("rid").alias("sid1"), F.col("p0").alias("b1"), F.col("p1").alias("e1"), F.lit(orient).alias("orient"))
    sides = side("h0", "h1", F.col("st0"), F.col("st1"), 0).unionByName(side("h1", "h0", 1 - F.col("st1"), 1 - F.col("st0"), 1))
    a = shimmer_pairs(mm0).select("h0", "h1", "st0", "st1", F.col("rid").alias("sid0"), F.col("p0").alias("b0"), F.col("p1").alias("e0"))
    return a.join(cut_lineage(sides), ["h0", "h1", "st0", "st1"]).select(*INTERVAL)


def interval_query(intervals: DataFrame, queries: DataFrame, sid: str = "sid", bgn: str = "bgn", end: str = "end", width: float = 3600) -> DataFrame:
    """Pairs of intervals (i_*) and queries (q_*) of one sid that overlap.

    Both are spread over bins of a fixed width and meet in an equi-join; a pair counts in its first common bin only.
    """
    a = intervals.select(*[F.col(c).alias(f"i_{c}") for c in intervals.columns])
    b = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    cell = lambda c: F.floor(F.col(c) / width)
    spread = lambda rows, x: rows.where(F.col(f"{x}_{bgn}") < F.col(f"{x}_{end}")).withColumn(f"{x}_cell", F.explode(F.sequence(cell(f"{x}_{bgn}"), cell(f"{x}_{end}"))))
    a, b = spread(a, "i"), spread(b, "q")
    first = F.greatest(cell(f"i_{bgn}"), cell(f"q_{bgn}"))
    near = (F.col(f"i_{sid}") == F.col(f"q_{sid}")) & (F.col("i_cell") == F.col("q_cell")) & (F.col("i_cell") == first)
    over = (F.col(f"i_{bgn}") < F.col(f"q_{end}")) & (F.col(f"i_{end}") > F.col(f"q_{bgn}"))
    return a.join(b, near & over).drop("i_cell", "q_cell")


def sketch_containment(mm: DataFrame, most: int = 10) -> DataFrame:
    """(rid0, rid1, shared, s0, s1, r0, r1): shimmers in common, with multiplicity, by hashes in 2 to `most` places."""
    mm = cut_lineage(mm)
    used = mm.join(mm.groupBy("mhash").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most)).select("mhash"), "mhash", "left_semi").select("rid", "mhash")
    a, b = used.toDF("rid0", "mhash"), used.toDF("rid1", "mhash")
    shared = a.join(b, "mhash").where("rid0 <> rid1").groupBy("rid0", "rid1").agg(F.count("*").alias("shared"))
    sizes = mm.groupBy("rid").agg(F.count("*").alias("s"))
    both = shared.join(sizes.toDF("rid0", "s0"), "rid0").join(sizes.toDF("rid1", "s1"), "rid1")
    return both.select("rid0", "rid1", "shared", "s0", "s1", (F.col("shared") / F.col("s0")).alias("r0"), (F.col("shared") / F.col("s1")).alias("r1"))


def associates(relations: DataFrame) -> DataFrame:
    """(rid0, rid1): contigs of which a larger one has more than half; the one that shares most, then the smallest id."""
    order = Window.partitionBy("rid0").orderBy(F.desc("shared"), "rid1")
    return relations.where("r0 > 0.5 and s1 > s0").withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").select("rid0", "rid1")


def _whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a pair of sequences ends."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        sid0, sid1 = table.column("sid0").to_numpy(), table.column("sid1").to_numpy()
        at = int(np.searchsorted((sid0 == sid0[-1]) & (sid1 == sid1[-1]), True))  # where the last pair of the batch begins
        if at:
            yield pa.concat_tables([*held, table.slice(0, at)])
            held = [table.slice(at)]
            continue
        last = held[-1].slice(held[-1].num_rows - 1) if held else None
        if last is not None and (last.column("sid0")[0], last.column("sid1")[0]) != (table.column("sid0")[0], table.column("sid1")[0]):
            yield pa.concat_tables(held)
            held = []
        held.append(table)
    if held:
        yield pa.concat_tables(held)


def _link_labels(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole pairs, in order: the place in its pair of each row's chain's first member, and which rows have a link."""
    sid0, sid1, b0, b1, orient = (table.column(c).to_numpy().astype(np.int64) for c in ("sid0", "sid1", "b0", "b1", "orient"))
    first = np.concatenate([[True], (sid0[1:] != sid0[:-1]) | (sid1[1:] != sid1[:-1])])
    cuts, pair = np.flatnonzero(first), np.cumsum(first) - 1
    large = (np.diff(np.append(cuts, len(pair))) >= LEAST_CHAIN)[pair]
    diagonal = np.where(orient == 1, b0 + b1, b0 - b1)
    v, w = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, min(AHEAD, len(pair) - 1) + 1):
        gap = b0[step:] - b0[:-step]
        met = large[step:] & (pair[step:] == pair[:-step]) & (orient[step:] == orient[:-step]) & (gap != 0) & (gap < SPAN)
        met = np.flatnonzero(met)
        met = met[np.abs(diagonal[met] - diagonal[met + step]) / np.abs(gap[met]) < DRIFT]
        v.append(met)
        w.append(met + step)
    v, w = np.concatenate(v), np.concatenate(w)
    label, linked = np.arange(len(pair)), np.zeros(len(pair), bool)
    linked[v] = linked[w] = True
    while len(v):
        a, b = label[v], label[w]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        apart = label[v] != label[w]
        v, w = v[apart], w[apart]
    return label - cuts[pair], linked


def chains(intervals: DataFrame) -> DataFrame:
    """Intervals in collinear chains, with `chain`, the place of the chain's first member in its pair of sequences.

    Each interval is compared with the 25 after it in its pair; near ones on a similar diagonal are linked, and chains are
    the connected components.  Intervals without a link are left out.  A pair's intervals come to a task in order, so its
    chains are found in memory, pairs of a batch at a time; nothing but the intervals is shuffled, and once.
    """
    rows = intervals.select(*INTERVAL).where("sid0 is not null and sid1 is not null")
    dealt = rows.repartition("sid0", "sid1").sortWithinPartitions("sid0", "sid1", "b0", "e0", "b1", "e1", "orient")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pairs(batches):
            chain, linked = _link_labels(table)
            yield from table.append_column("chain", pa.array(chain.astype(np.int32))).filter(pa.array(linked)).to_batches()

    return dealt.mapInArrow(link, T.StructType([*dealt.schema.fields, T.StructField("chain", T.IntegerType())]))


_CHAIN_TYPES = "sid0 long, b0 int, e0 int, sid1 long, b1 int, e1 int, orient int, deltas int"
_CHAIN_SCHEMA = pa.schema([("sid0", pa.int64()), ("b0", pa.int32()), ("e0", pa.int32()), ("sid1", pa.int64()), ("b1", pa.int32()), ("e1", pa.int32()), ("orient", pa.int32())])


def unique_chains(chained: DataFrame) -> DataFrame:
    """Intervals of chains that stay when the largest chains of a sequence pair take each interval once.

    Chains of four or more; one keeps its untaken intervals if they are more than half of it.  A target has intervals of
    its own, so pairs are independent.
    """

    def pick(table: pa.Table) -> pa.Table:
        groups: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            groups.setdefault(r.pop("chain"), []).append(r)
        left, right, out = set(), set(), []
        for _, rows in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(rows) < LEAST_CHAIN:
                continue
            new = []
            for r in sorted(rows, key=lambda r: (r["b0"], r["e0"], r["b1"], r["e1"])):
                a, b = (r["b0"], r["e0"]), (r["b1"], r["e1"])
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    new.append(r)
            if 2 * len(new) > len(rows):
                out += new
        return pa.Table.from_pylist(out, schema=_CHAIN_SCHEMA)

    return chained.groupBy("sid0", "sid1").applyInArrow(pick, _CHAIN_TYPES.rpartition(",")[0])


def interval_deltas(intervals: DataFrame, seqs0: DataFrame, seqs1: DataFrame, k: int) -> DataFrame:
    """intervals with deltas, the differences between their run-compressed sequences; none where they don't align."""
    joined = intervals.join(seqs0.select(F.col("rid").alias("sid0"), F.col("seq").alias("seq0")), "sid0").join(seqs1.select(F.col("rid").alias("sid1"), F.col("seq").alias("seq1")), "sid1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = r.pop("seq0").encode()[r["b0"] : r["e0"]]
                b, lead = r.pop("seq1").encode(), k - 2 if r["orient"] else 0
                b = oriented(b[max(0, r["b1"] - lead) : max(0, r["e1"] - lead)], r["orient"])
                x, y = compressed(a)[0], compressed(b)[0]
                m = align(x, y, 0.02, 32, 24) if min(len(x), len(y)) >= 32 else None
                out.append({**r, "deltas": m.dist if m else 0})
            yield pa.RecordBatch.from_pylist(out, schema=_CHAIN_SCHEMA.append(pa.field("deltas", pa.int32())))

    return joined.select(*INTERVAL, "seq0", "seq1").mapInArrow(run, _CHAIN_TYPES)


def linear_hits(intervals: DataFrame) -> DataFrame:
    """Intervals of each pair that advance on both sequences along the pair's majority strand.

    Those up to and with the first on that strand are kept whatever they are.
    """

    def walk(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["b0"], r["sid1"], r["b1"]))
        turned = sum(1 if r["orient"] else -1 for r in rows) > 0
        out, last = [], None
        for r in rows:
            on = bool(r["orient"]) == turned
            if last is None:
                out.append(r)
                if on:
                    last = (r["e0"], r["b1"] if turned else r["e1"])
            elif on and r["e0"] > last[0] and (r["b1"] < last[1] if turned else r["e1"] > last[1]):
                out.append(r)
                last = (r["e0"], r["b1"] if turned else r["e1"])
        return pa.Table.from_pylist(out, schema=_CHAIN_SCHEMA.append(pa.field("deltas", pa.int32())))

    return intervals.groupBy("sid0", "sid1").applyInArrow(walk, _CHAIN_TYPES)


def duplicate_targets(hits: DataFrame, lens0: DataFrame, lens1: DataFrame, most_left: int = 2000) -> DataFrame:
    """(sid1) of targets that a reference holds: no difference, and at most so many bases unaligned.

    Of sequences of equal length only the one with the larger id is a duplicate.
    """
    sums = hits.groupBy("sid0", "sid1", "orient").agg(F.sum(F.col("e1") - F.col("b1")).alias("aligned"), F.sum("deltas").alias("deltas"))
    both = sums.join(lens0.toDF("sid0", "len0"), "sid0").join(lens1.toDF("sid1", "len1"), "sid1")
    same = both.where("deltas = 0").where(F.col("len1") - F.col("aligned") <= most_left)
    return same.where("len0 <> len1 or sid1 > sid0").select("sid1").distinct()


def drop_duplicates(reference: DataFrame, target: DataFrame, p: Params) -> DataFrame:
    """Targets (rid, name, seq) that no reference contig holds and whose sequence has one upper-case run; that run."""
    mapped = interval_map(shimmers(reference, p), shimmers(target, p))
    hits = linear_hits(interval_deltas(unique_chains(chains(mapped)), reference, target, p.k))
    size = lambda rows: rows.select("rid", F.length("seq"))
    gone = duplicate_targets(hits, size(reference), size(target)).select(F.col("sid1").alias("rid"))
    runs = F.regexp_extract_all("seq", F.lit("[ACGT]+"), F.lit(0))
    return target.join(gone, "rid", "left_anti").withColumn("runs", runs).where(F.size("runs") == 1).select("rid", "name", F.col("runs")[0].alias("seq"))
