import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import graph as G
from strandloom.operators import overlaps


def edges(spark, pairs):
    return spark.createDataFrame([(v, w, x) for v, w, x in pairs], "v long, w long, weight long")


def pairs_of(df):
    return sorted((r["v"], r["w"]) for r in df.collect())


def test_reduction_spurs_and_bridges(spark, monkeypatch):
    rng = random.Random(1)
    rows = {(v, w): rng.randrange(9) for v in range(30) for w in range(v + 1, 30) if rng.random() < 0.15}
    df = edges(spark, [(v, w, x) for (v, w), x in rows.items()])
    out, into = {}, {}
    for v, w in rows:
        out.setdefault(v, set()).add(w)
        into.setdefault(w, set()).add(v)
    n = lambda d, k: len(d.get(k, ()))
    witness = {e for e in rows if any((e[0], x) in rows and (x, e[1]) in rows for x in range(30))}
    spur = {(v, w) for v, w in rows if (not n(into, v) and n(into, w) >= 2 and n(out, w)) or (not n(out, w) and n(out, v) >= 2 and n(into, v))}
    assert pairs_of(G.reducible_edges(df)) == sorted(witness) and pairs_of(G.spur_edges(df)) == sorted(spur)
    monkeypatch.setattr(G, "MOST_BROADCAST", 0)
    assert pairs_of(G.reducible_edges(df)) == sorted(witness)
    monkeypatch.undo()
    assert pairs_of(G.transitive_reduction(df)) == sorted(set(rows) - witness - spur)
    assert pairs_of(G.bridge_candidates(df, 5)) == sorted((v, w) for (v, w), x in rows.items() if x < 5 and n(out, v) >= 2 and n(into, v) and n(out, w) and n(into, w) >= 2)
    assert pairs_of(G.remove_weak_spurs(df, 3)) == sorted(e for e in rows if not (e in spur and rows[e] <= 3))


def test_reduction_in_cells(spark, monkeypatch):
    """Parts by hash and by ranges, bit rows and look-ups give the witnessed edges, and no way of two edges is made."""
    rng = random.Random(3)
    near = {(100 * c + v, 100 * c + w) for c in range(12) for v in range(40) for w in range(v + 1, 40) if rng.random() < 0.2}
    far = {(rng.randrange(90), rng.randrange(90)) for _ in range(900)}
    copies = {}
    for name, rows in (("near", near), ("far", {(v, w) for v, w in far if v != w})):
        out = {}
        for v, w in rows:
            out.setdefault(v, set()).add(w)
        want = sorted((v, w) for v, w in rows if any(w in out.get(x, ()) for x in out[v]))
        df = edges(spark, [(v, w, 1) for v, w in rows])
        monkeypatch.setattr(G, "MOST_BROADCAST", 0)
        for cell, cost in ((1 << 20, 64), (300, 10**9), (300, 0)):
            monkeypatch.setattr(G, "CELL", cell)
            monkeypatch.setattr(G, "PROBE_COST", cost)
            assert pairs_of(G.reducible_edges(df)) == want
        copies[name] = G._in_cells(df.select("v", "w"), len(rows)).count() / len(rows)
        monkeypatch.undo()
    assert copies["near"] < copies["far"] <= 3 * 3


def test_greedy_bridges_rechecks():
    rows = [(0, 1, 9), (1, 2, 9), (3, 4, 9), (4, 5, 9), (1, 4, 1), (4, 1, 2)]
    left = G.greedy_bridges([(2 * v, 2 * w, x) for v, w, x in rows])
    assert (2, 8) not in left and {(0, 2), (2, 4), (6, 8), (8, 10)} <= left


def naive_unitigs(rows):
    out, into = {}, {}
    for v, w in rows:
        out.setdefault(v, []).append(w)
        into.setdefault(w, []).append(v)
    inner = {x for x in out if len(out[x]) == 1 and len(into.get(x, ())) == 1}
    got = []
    for v, w in rows:
        if v not in inner:
            path = [v, w]
            while path[-1] in inner:
                path.append(out[path[-1]][0])
            got += [(v, w, x, i) for i, x in enumerate(path)]
    return sorted(got)


def test_unitigs_and_components(spark):
    rng = random.Random(2)
    for k in range(3):
        rows = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(30 + 6 * k)} | {(100 + i, 101 + i) for i in range(21)} | {(200, 201), (201, 202), (202, 200)})
        rows = [(v, w) for v, w in rows if v != w]
        df = edges(spark, [(v, w, 1) for v, w in rows])
        assert sorted(tuple(r) for r in G.unitigs(df).select("begin", "second", "node", "ord").collect()) == naive_unitigs(rows)
        label = {x: x for e in rows for x in e}
        for _ in label:
            for v, w in rows:
                label[v] = label[w] = min(label[v], label[w])
        assert {r["node"]: r["component"] for r in G.components(df).collect()} == label


def test_components_read_the_edges_once(spark):
    """Long ways in order, a clique and a loop; the edges given are computed once, whatever the number of rounds."""
    rows = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + j) for i in range(9) for j in range(i)] + [(2000, 2000), (2100, 1500), (1500, 2200), (2200, 1400)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "v long, w long").mapInArrow(count, "v long, w long")
    got = {r["node"]: r["component"] for r in G.components(df).collect()}
    assert got == {x: 0 for x in range(301)} | {x: 1000 for x in range(1000, 1009)} | {2000: 2000} | {x: 1400 for x in (2100, 1500, 2200, 1400)}
    assert read.value == len(rows)


def test_links_and_reach(spark):
    df = edges(spark, [(1, 2, 5), (2, 1, 4), (1, 3, 9), (3, 4, 1), (4, 5, 1)])
    assert pairs_of(G.best_links(df)) == [(1, 3), (2, 1), (3, 4), (4, 5)] and pairs_of(G.reciprocal(df)) == [(1, 2), (2, 1)]
    assert pairs_of(G.without_short_cycles(df)) == [(1, 3), (3, 4), (4, 5)]
    seen = G.reach(df, spark.createDataFrame([(1,)], "node long"), 2).collect()
    assert sorted((r["node"], r["step"]) for r in seen) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert pairs_of(G.with_twins(edges(spark, [(0, 2, 1)]))) == [(0, 2), (3, 1)]


def test_clearest_links(spark):
    df = spark.createDataFrame([(1, 2, 9, 1), (1, 3, 5, 0), (1, 4, 5, 0), (2, 5, 1, 3)], "v long, w long, weight long, dist_c int")
    assert pairs_of(G.clearest_links(df)) == [(1, 3), (2, 5)]


def test_overlap_algebra(spark):
    row = (7, 9, 1, 100, 80, 30, 10, 30, 100, 5, 75, 3, 97.5, 0, 0, 100.0, 0)
    kinds = ", ".join(f"{c} {'double' if c.startswith('idt') else 'int'}" for c in overlaps.COLUMNS)
    df = spark.createDataFrame([row, (7, 9, 0, 100, 80, -30, -50, 0, 50, 30, 80, 3, 99.5, 0, 0, 100.0, 0)], kinds)
    for turn in (overlaps.swap,):
        assert sorted(tuple(r) for r in turn(turn(df)).select(df.columns).collect()) == sorted(tuple(r) for r in df.collect())
    back = overlaps.reverse_strand(df).collect()[0]
    assert (back["d_left"], back["d_right"], back["strand1"], back["bgn0"], back["flag"]) == (-10, -30, 0, 0, 0x80)
    lines = overlaps.format_overlap(df)
    assert sorted(tuple(r) for r in overlaps.parse_overlaps(lines).collect()) == sorted(tuple(r) for r in df.collect())
    assert overlaps.best_per_pair(df).collect()[0]["idt"] == 99.5 and overlaps.graph_input(df).count() == 2


def test_markers(spark):
    kinds = ", ".join(f"{c} {'double' if c.startswith('idt') else 'int'}" for c in overlaps.COLUMNS)
    rows = [(0, 10 + k, 0, 1000, 1000, k, k, 0, 900, 0, 900, 1, 99.0, 0, 0, 0.0, 0) for k in range(12)]
    deltas = [(0, 10 + k, 0, k, 400, 1) for k in range(6)] + [(0, 10, 0, 0, 500, 2)] + [(0, 10 + k, 0, k, 600, 1) for k in range(9)]
    ovlp, diff = spark.createDataFrame(rows, kinds), spark.createDataFrame(deltas, "rid0 int, rid1 int, strand1 int, d_left int, x int, kind int")
    assert [(r["x"], r["n"], r["depth"]) for r in overlaps.markers(ovlp, diff).collect()] == [(400, 6, 12)]
    got = {r["rid1"]: (r["dist_c"], r["max_dist_c"], r["flag"]) for r in overlaps.with_markers(ovlp, diff).collect()}
    assert got[10] == (1, 1, 0) and got[21] == (0, 1, overlaps.COMPATIBLE)


def test_read_filters(spark):
    rows = [(0, 1, 10, 10), (1, 0, -10, -10), (1, 2, 10, 10), (2, 1, -10, -10), (2, 3, 10, 10), (3, 2, -10, -10), (1, 4, 5, -5), (4, 1, -5, 5), (4, 2, 5, 5), (4, 0, -5, -5)]
    df = spark.createDataFrame([(a, b, 100, x, y, 0) for a, b, x, y in rows], "rid0 long, rid1 long, len0 int, d_left int, d_right int, dist_c int")
    dead = overlaps.dead_ends(df)
    ids = lambda d: sorted(r["rid"] for r in d.collect())
    assert ids(dead) == [0, 1, 2, 3] or ids(dead) == [0, 3]
    assert 0 in ids(overlaps.chimeras(df)) and 3 in ids(overlaps.chimeras(df)) and 1 not in ids(overlaps.chimeras(df))
    none = df.select(F.col("rid0").alias("rid")).where(F.lit(False))
    assert ids(overlaps.contained_reads(df, none)) == [4] and overlaps.without_reads(df, spark.createDataFrame([(4,)], "rid long")).count() == 6


def test_bridges_go_by_rounds_as_one_by_one(spark):
    rng = random.Random(12)
    for k in range(3):
        rows = {}
        for _ in range(60):
            v, w = rng.randrange(24), rng.randrange(24)
            if v >> 1 != w >> 1:
                x = rng.randrange(6)
                rows[v, w] = rows[w ^ 1, v ^ 1] = x
        df = edges(spark, [(v, w, x) for (v, w), x in rows.items()])
        assert set(pairs_of(G.without_bridges(df, 5))) == G.greedy_bridges([(v, w, x) for (v, w), x in rows.items()], 5)


def test_cross_candidates_hold_the_best_links(spark):
    """A customer has two candidates at most, and the best links are those of all pairs."""
    from strandloom.operators import layout
    from strandloom.plans import algebra

    customers = spark.createDataFrame([(i, i % 2, "ab"[i % 3 > 0]) for i in range(1, 1800)], "c_custkey long, c_nationkey int, c_mktsegment string")
    unitigs = spark.createDataFrame([(i, i + 1, node, ord_) for i in range(1, 1790) for ord_, node in enumerate((i, i + 7))], "begin long, second long, node long, ord long")
    links = algebra._cross_candidates(customers, unitigs).cache()
    assert links.groupBy("v").count().agg({"count": "max"}).first()[0] <= 2
    a, b = customers.alias("a"), customers.alias("b")
    every = a.join(b, "c_nationkey").where("a.c_mktsegment = b.c_mktsegment and a.c_custkey <> b.c_custkey").selectExpr("a.c_custkey v", "b.c_custkey w", "(a.c_custkey * 7 + b.c_custkey) % 101 weight")
    want = {tuple(r) for r in layout.cross_edges(every, unitigs).collect()}
    assert want and {tuple(r) for r in layout.cross_edges(links, unitigs).collect()} == want


def test_marker_statistics_shuffle_the_overlaps_once(spark):
    rows = [(1, i, i % 2, 100, 100, i, i, 10, 90, 10, 90, 1, 99.0, 0, 0, 0.0, 0) for i in range(2, 14)]
    ovlp = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c.startswith('idt') else 'long' if c.startswith('rid') else 'int'}" for c in overlaps.COLUMNS))
    diff = spark.createDataFrame([(1, i, i % 2, i, 50, 1) for i in range(2, 8) for _ in range(2)] + [(1, 8, 1, 8, 50, 1)], "rid0 long, rid1 long, strand1 int, d_left int, x int, kind int")
    found = overlaps.with_markers(ovlp, diff)
    # the last difference is of no overlap kept, and ones given twice count once
    assert {r["rid1"]: (r["dist_c"], r["max_dist_c"], r["flag"]) for r in found.collect()} == {i: (int(i < 8), 1, 2 * (i >= 8)) for i in range(2, 14)}
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("Exchange ") == 1


def test_packed_edges_take_few_bytes_and_come_back(spark):
    """Cells get packed edges: the same ones, whatever the ids are, in a third of the bytes at most."""
    rng = random.Random(7)
    far = {(rng.randrange(1_200_000), rng.randrange(1_200_000)) for _ in range(20_000)}
    odd = {(-(1 << 63), (1 << 63) - 1), ((1 << 63) - 1, -(1 << 63)), (0, 0), (5, 4), (-3, 1 << 40)}
    for rows in (far, odd, {(7, 7)}):
        v, w = np.array(sorted(rows), np.int64).T
        packed = G._packed(v.copy(), w.copy())
        assert [tuple(x) for x in np.stack(G._unpacked(packed), 1).tolist()] == sorted(rows)
        assert rows is not far or len(packed) < 16 * len(rows) / 3
    df = spark.createDataFrame(sorted(far)[:3000], "v long, w long")
    cells = lambda pack: G._in_cells(df, 3000, pack)
    got = sorted((r["cell"], r["role"], v, w) for r in cells(True).collect() for v, w in zip(*(x.tolist() for x in G._unpacked(r["edges"])), strict=True))
    assert got == sorted(tuple(r) for r in cells(False).collect())
