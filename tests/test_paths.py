"""Paths through components: the rule in memory on plain cases, and the same rule by joins on random graphs."""

import random

import pytest

from strandloom.operators import layout, path_rounds, paths
from strandloom.operators.graph import components


def with_twins(edges):
    return sorted({*edges, *((w ^ 1, v ^ 1) for v, w in edges)})


def chain(*nodes):
    return list(zip(nodes, nodes[1:], strict=False))


def run(start, n):
    return chain(*range(start, start + 2 * n + 2, 2))


def test_one_chain_gives_one_strand():
    (tag, nodes), *rest = paths.paths_of(with_twins(run(0, 12)))
    assert tag == "P" and nodes == list(range(0, 26, 2)) and not rest
    assert paths.paths_of([(0, 2), (2, 4)]) == [] and paths.paths_of([]) == [] and paths.paths_of([(4, 4)]) == []


def test_the_longer_side_of_a_bubble_is_taken():
    (tag, nodes), *rest = paths.paths_of(with_twins(run(0, 6) + chain(4, 100, 102, 104, 8)))
    assert (tag, nodes) == ("P", [0, 2, 4, 100, 102, 104, 8, 10, 12]) and not rest  # the short side has too few edges


def test_a_cycle_is_walked_once():
    found = paths.paths_of(with_twins([*run(0, 11), (22, 0)]))
    assert [(tag, sorted(n)) for tag, n in found] == [("P", list(range(0, 24, 2)))]


def test_a_side_path_that_rejoins_is_an_associate():
    found = paths.paths_of(with_twins(run(0, 20) + chain(10, 100, 102, 104, 106, 20)))
    assert [(tag, len(n)) for tag, n in found] == [("P", 21), ("A", 6)]


def test_true_branches_stop_a_path():
    fork = with_twins(run(0, 30) + [(20, 200)] + run(200, 25))
    assert [len(n) for _, n in paths.paths_of(fork, 15)] == [11, 27, 21]
    assert [len(n) for _, n in paths.paths_of(fork, 40)] == [37, 21]


def test_inverted_repeats_are_not_walked_twice():
    """A path that turns round and comes back on its own other strand ends where it turns."""
    there = run(0, 10)
    turn = with_twins([*there, (20, 21)])
    found = paths.paths_of(turn)
    assert [sorted({v >> 1 for v in n}) == list(range(11)) and len(n) == 11 for _, n in found] == [True]


def random_graph(rng, kind):
    """Chains with forks, bubbles, cycles and turns to the other strand."""
    edges, heads, new = [], [0], 2
    for _ in range(kind["runs"]):
        at = rng.choice(heads)
        n = rng.randrange(1, kind["longest"])
        nodes = [at, *range(new, new + 2 * n, 2)]
        new += 2 * n
        nodes = [nodes[0], *(v ^ (rng.random() < kind["turn"]) for v in nodes[1:])]
        edges += chain(*nodes)
        heads += [nodes[-1], rng.choice(nodes)]
        if rng.random() < kind["join"]:
            edges.append((nodes[-1], rng.choice(heads) ^ (rng.random() < kind["turn"])))
        if rng.random() < kind["new"]:
            heads.append(new)
            new += 2
    return with_twins((v, w) for v, w in edges if v >> 1 != w >> 1)


KINDS = [
    dict(runs=4, longest=4, turn=0.0, join=0.7, new=0.2),
    dict(runs=3, longest=4, turn=0.3, join=0.9, new=0.1),
]


@pytest.fixture(autouse=True)
def one_task(spark):
    """Rounds over a few rows need no more tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_joins_equal_the_rule(spark):
    graphs = [random_graph(random.Random(f"{i}-{k}"), kind) for i, kind in enumerate(KINDS) for k in range(9)]
    edges, want, branch = [], [], 3
    for k, g in enumerate(graphs):  # many graphs side by side, so that each is decided apart from the others
        edges += [(v + 10_000 * k, w + 10_000 * k) for v, w in g]
    df = spark.createDataFrame(edges, "v long, w long")
    member = components(df.union(df.selectExpr("v ^ 1", "w ^ 1")).union(df.selectExpr("v", "v ^ 1")))
    of = {r["node"]: r["component"] for r in member.collect()}
    for c in sorted(set(of.values())):
        found = paths.paths_of([e for e in edges if of[e[0]] == c], branch)
        want += [(c, k, tag, i, v) for k, (tag, nodes) in enumerate(found) for i, v in enumerate(nodes)]
    got = [(r["component"], r["path"], r["tag"], r["ord"], r["node"]) for r in path_rounds.paths_by_rounds(df, member, branch).collect()]
    assert sorted(got) == sorted(want) and len(want) > 60


def test_small_and_large_components(spark):
    small, big = with_twins(run(0, 9)), with_twins(run(1000, 20) + chain(1010, 2000, 2002, 2004, 1020))
    df = spark.createDataFrame(small + big, "v long, w long")
    rows = lambda d: sorted((r["component"], r["path"], r["tag"], r["ord"], r["node"]) for r in d.collect())
    assert rows(layout.layouts(df, 30)) == rows(layout.layouts(df)) and len(rows(layout.layouts(df))) == 10 + 21 + 5
    assert layout.layouts(df.limit(0)).collect() == []
