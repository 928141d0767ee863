"""Searches and steps against repeats, against loops over a graph in memory."""

import random
from collections import defaultdict, deque
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from strandloom.operators import search
from strandloom.operators.graph import unitigs
from strandloom.operators.layout import reduce_by_unitigs
from strandloom.plans.lineage import cut_lineage

SCHEMA = "v long, w long, weight long"


class Loop:
    def __init__(self, edges):
        self.out = defaultdict(list)
        for v, w in sorted(set(edges)):
            self.out[v].append(w)

    def near(self, start, most):
        seen, queue = {start: None}, deque([start])
        while queue and len(seen) < most:
            for w in self.out[queue.popleft()]:
                if w not in seen:
                    seen[w] = None
                    queue.append(w)
        return list(seen)[:most]

    def branching(self, most):
        found = []
        for v in sorted(self.out):
            reach = [set(self.near(w, most)) for w in self.out[v]]
            if any(not a & b for i, a in enumerate(reach) for b in reach[:i]):
                found.append(v)
        return found

    def route(self, start, goal, weight):
        before, done, queue = {}, set(), [(0, start, -1)]
        while queue:
            far, v, by = heappop(queue)
            if v in done:
                continue
            done.add(v)
            before[v] = by
            for w in self.out[v]:
                if w not in done:
                    heappush(queue, (far + weight[v, w], w, v))
        path = [goal]
        while path[-1] != start:
            path.append(before[path[-1]])
        return path[::-1]

    def nearest(self, start, reads, longest):
        paths, queue = {start: [start]}, deque([start])
        while queue:
            v = queue.popleft()
            for w in self.out[v] if len(paths[v]) < longest else ():
                if w not in paths:
                    paths[w] = paths[v] + [w]
                    queue.append(w)
        hits = [(len(p), w) for w, p in paths.items() if w != start and w >> 1 in reads]
        return paths[min(hits)[1]] if hits else None


def graph(rng, reads, edges, heaviest=9):
    """Random edges with their twins."""
    out = {}
    for _ in range(edges):
        v, w = rng.randrange(2 * reads), rng.randrange(2 * reads)
        if v >> 1 != w >> 1:
            out[v, w] = out[w ^ 1, v ^ 1] = rng.randrange(1, heaviest)
    return out


def detours(weight, sink_nodes=15, light=5):
    loop = Loop(weight)
    branching = loop.branching(24)
    sinks, gone = {v ^ 1 for v in branching if loop.out[v ^ 1]}, set()
    for v in branching:
        ways = {}
        for w in loop.out[v]:
            if w == v:
                continue
            routes = [[v, w]] if w in sinks else [[v, *loop.route(w, x, weight)] for x in loop.near(w, sink_nodes) if x in sinks]
            steps = [e for r in routes if sum(weight[e] for e in zip(r, r[1:], strict=False)) < light for e in zip(r, r[1:], strict=False)]
            if steps:
                ways[w] = steps
        if ways and len(ways) == len([w for w in loop.out[v] if w != v]):
            ways.pop(max(ways, key=lambda w: (weight[v, w], -w)))
        for steps in ways.values():
            gone |= set(steps) | {(b ^ 1, a ^ 1) for a, b in steps}
    left = set(weight) - gone
    out, into = {v for v, _ in left}, {w for _, w in left}
    return {(v, w) for v, w in gone & set(weight) if v in out or w in into}


def branches(weight, most):
    left = set(weight)
    for v in Loop(weight).branching(most):
        ways = sorted((-weight[x, w], w) for x, w in left if x == v)
        for _, w in ways[1:]:
            left -= {(v, w), (w ^ 1, v ^ 1)}
    return left


def bridges(edges, most, longest):
    left, open_ = set(edges), Loop(edges).branching(most)
    reads = {v >> 1 for v in open_}
    while open_:
        loop, touched = Loop(left), {}
        routes = {v: p for v in open_ if (p := loop.nearest(v, reads, longest))}
        for v, p in routes.items():
            for x in p:
                touched[x >> 1] = min(v, touched.get(x >> 1, v))
        now = [v for v, p in routes.items() if all(touched[x >> 1] == v for x in p)]
        for v in now:
            for a, b in zip(routes[v], routes[v][1:], strict=False):
                left -= {(a, b), (b ^ 1, a ^ 1)}
        open_ = sorted(set(routes) - set(now))
    return left


@pytest.fixture(autouse=True)
def one_task(spark):
    """Rounds over a few rows need no more tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def both(spark):
    """Many small graphs side by side, and a hub, as a dictionary and as edges."""
    weight = {(0, w): 1 for w in range(2, 60, 2)} | {(w ^ 1, 1): 1 for w in range(2, 60, 2)}
    for k in range(1, 15):
        rng = random.Random(k)
        n = rng.randrange(5, 11)
        weight |= {(v + 100 * k, w + 100 * k): x for (v, w), x in graph(rng, n, rng.randrange(n, 2 * n)).items()}
    return weight, cut_lineage(spark.createDataFrame([(v, w, x) for (v, w), x in weight.items()], SCHEMA))


def pairs(df):
    return {(r["v"], r["w"]) for r in df.collect()}


def test_bounded_search_and_branching(both):
    weight, edges = both
    loop, nodes = Loop(weight), sorted({v for e in weight for v in e})
    found = defaultdict(dict)
    for r in search.near_nodes(edges, edges.select(F.col("w").alias("node")).union(edges.select("v")), 9).collect():
        found[r["start"]][r["rank"]] = r["node"]
    assert {v: [found[v][k] for k in sorted(found[v])] for v in found} == {v: loop.near(v, 9) for v in nodes}
    for most in (2, 24):
        assert sorted(r["node"] for r in search.branching_nodes(edges, most).collect()) == loop.branching(most)


def test_detours(both):
    weight, edges = both
    assert pairs(search.repeat_detours(edges, light=7)) == detours(weight, light=7)


def test_repeats(both):
    weight, edges = both
    assert pairs(search.without_repeat_branches(edges, 6)) == branches(weight, 6)
    assert pairs(search.without_repeat_bridges(edges, 6, 4)) == bridges(weight, 6, 4)


def test_two_chains_are_cut_apart(spark):
    chain = lambda start, n: [(start + 2 * i, start + 2 * i + 2) for i in range(n)]
    with_twins = lambda es: es + [(w ^ 1, v ^ 1) for v, w in es]
    one, two = chain(0, 12), chain(100, 12)
    bridged = spark.createDataFrame([(v, w, 1 if (v, w) in {(12, 112), (113, 13)} else 9) for v, w in with_twins(one + two + [(12, 112)])], SCHEMA)
    assert pairs(search.without_repeat_branches(bridged, 4)) == set(with_twins(one + two))


def test_unitig_reduction_keeps_and_cuts(spark):
    main = {(0, 10): 40, (10, 20): 40, (0, 30): 3, (30, 40): 40, (11, 1): 40, (21, 11): 40, (31, 1): 3, (41, 31): 40}
    paths = spark.createDataFrame([(v, w, x) for (v, w), x in main.items()], SCHEMA)
    assert pairs(search.repeat_detours(paths)) == set()
    none = spark.createDataFrame([], SCHEMA)
    assert pairs(search.repeat_detours(none)) == set() and pairs(search.without_repeat_branches(none)) == set() and pairs(search.without_repeat_bridges(none)) == set()
    rng = random.Random(8)
    weight = graph(rng, 30, 28)
    edges = spark.createDataFrame([(v, w, x) for (v, w), x in weight.items()], SCHEMA)
    found = unitigs(edges)
    rows = defaultdict(dict)
    for r in found.collect():
        rows[r["begin"], r["second"]][r["ord"]] = r["node"]
    lists = {k: [x[i] for i in sorted(x)] for k, x in rows.items()}
    heavy = {(k[0], x[-1]): len(x) for k, x in sorted(lists.items())}
    gone = detours(heavy)
    stay = {e for k, x in lists.items() if (k[0], x[-1]) not in gone for e in zip(x, x[1:], strict=False)}
    assert pairs(reduce_by_unitigs(edges, found)) == stay & set(weight)
