"""Bounded searches from many nodes of a graph at once, and the steps against repeats that rest on them.

All searches go in rounds of joins on edge lists (v, w).  Each source has a budget of nodes, so its rows are bounded; what
is decided about one source never needs another task's graph.  A node is rid * 2 + strand, its twin the other strand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import twin
from strandloom.plans.lineage import cut_lineage


def near_nodes(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, rank): the first `most` nodes that breadth-first search finds from each start (column node).

    Nodes of a round go by the rank of the node that found them, then by number.  Of a node's ways out the 2 * most
    smallest can matter at most, so a hub adds no more than that to a source.
    """
    order = Window.partitionBy("v").orderBy("w")
    ways = edges.select("v", "w").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * most)
    ways = cut_lineage(ways.select(F.col("v").alias("node"), "w"))
    front = cut_lineage(starts.select(F.col("node").alias("start"), "node", F.lit(1).alias("rank"), F.lit(1).alias("found")).distinct())
    seen = front
    while most > 1:
        hop = front.join(ways, "node").groupBy("start", F.col("w").alias("node")).agg(F.min("rank").alias("by"), F.max("found").alias("found"))
        new = hop.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("start").orderBy("by", "node"))
        new = new.withColumn("rank", F.col("found") + turn).where(F.col("rank") <= most)
        new = new.withColumn("found", F.col("found") + F.count("*").over(Window.partitionBy("start")).cast("int"))
        front = cut_lineage(new.select("start", "node", "rank", "found"))
        if not front.head(1):
            break
        seen = cut_lineage(seen.unionByName(front))
        front = front.where(F.col("found") < most)
    return seen.select("start", "node", "rank")


def branching_nodes(edges: DataFrame, most: int = 24) -> DataFrame:
    """(node): nodes with two ways out that don't meet within so many nodes of each.

    A node's ways out are compared in its own row, as lists of `most` nodes.
    """
    edges = cut_lineage(edges.select("v", "w").distinct())
    forks = edges.groupBy("v").agg(F.count("*").alias("n")).where("n >= 2").select("v")
    ways = cut_lineage(edges.join(forks, "v", "left_semi"))
    if not ways.head(1):
        return ways.select(F.col("v").alias("node"))
    found = near_nodes(edges, ways.select(F.col("w").alias("node")), most).groupBy(F.col("start").alias("w")).agg(F.collect_list("node").alias("reach"))
    sets = ways.join(found, "w").groupBy("v").agg(F.collect_list("reach").alias("sets"))
    apart = F.exists("sets", lambda a: F.exists("sets", lambda b: ~F.arrays_overlap(a, b)))
    return sets.where(apart).select(F.col("v").alias("node"))


def light_routes(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(start, goal, v, w): the steps of the lightest route of less than `most` from start to goal, for the pairs that have one.

    edges: v, w, weight; weights are 1 or more, so rounds end at most - 1 steps.  Of routes as light, each node keeps the
    smallest node before it.
    """
    ways = cut_lineage(edges.groupBy(F.col("v").alias("node"), "w").agg(F.max("weight").alias("weight")).where(F.col("weight") < most))
    best = cut_lineage(pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("far"), F.lit(-1).cast("long").alias("by")))
    front = best
    while True:
        hop = front.join(ways, "node").select("start", F.col("w").alias("node"), (F.col("far") + F.col("weight")).alias("far"), F.col("node").alias("by")).where(F.col("far") < most)
        both = best.withColumn("old", F.lit(True)).unionByName(hop.withColumn("old", F.lit(False)))
        merged = both.groupBy("start", "node").agg(F.min(F.struct("far", "by", ~F.col("old"))).alias("b"), F.min(F.when(F.col("old"), F.col("far"))).alias("before"))
        merged = cut_lineage(merged.select("start", "node", "b.far", "b.by", (F.col("before").isNull() | (F.col("b.far") < F.col("before"))).alias("new")))
        best, front = merged.drop("new"), merged.where("new").drop("new")
        if not front.head(1):
            break
    at = pairs.select("start", "goal", F.col("goal").alias("node")).where("start <> goal")
    steps = None
    while True:
        at = cut_lineage(at.join(best.where("by >= 0").select("start", "node", "by"), ["start", "node"]))
        if not at.head(1):
            break
        some = at.select("start", "goal", F.col("by").alias("v"), F.col("node").alias("w"))
        steps = some if steps is None else steps.unionByName(some)
        at = at.where("by <> start").select("start", "goal", F.col("by").alias("node"))
    return steps if steps is not None else at.select("start", "goal", F.col("node").alias("v"), F.col("node").alias("w"))


def repeat_detours(paths: DataFrame, sink_nodes: int = 15, light: int = 5) -> DataFrame:
    """(v, w): edges of the graph of unitigs that light detours by repeats use; paths: v, w, weight.

    From each branching node, ways out that reach a sink (the other strand of a branching node) by a route lighter than
    `light` are taken away with their twins, but a node keeps one way out: if all are light, the heaviest.  Then edges
    between a node left without ways out and one left without ways in stay after all.
    """
    paths = cut_lineage(paths.select("v", "w", "weight"))
    branching = cut_lineage(branching_nodes(paths))
    if not branching.head(1):
        return paths.select("v", "w").where(F.lit(False))
    outs = paths.select(F.col("v").alias("node")).distinct()
    sinks = cut_lineage(branching.select(twin(F.col("node")).alias("node")).join(outs, "node", "left_semi"))
    ways = cut_lineage(paths.join(branching.select(F.col("node").alias("v")), "v", "left_semi").where("v <> w"))
    straight = ways.join(sinks.select(F.col("node").alias("w")), "w", "left_semi")
    around = cut_lineage(ways.join(sinks.select(F.col("node").alias("w")), "w", "left_anti"))
    near = near_nodes(paths, around.select(F.col("w").alias("node")), sink_nodes).join(sinks, "node", "left_semi")
    routes = cut_lineage(light_routes(paths, near.select("start", F.col("node").alias("goal")), light))
    routes = routes.select("start", "goal", F.col("v").alias("a"), F.col("w").alias("b")).join(paths.toDF("a", "b", "step"), ["a", "b"])
    cost = F.col("weight") + F.sum("step").over(Window.partitionBy("v", "w", "goal"))
    by_routes = around.join(routes.withColumnRenamed("start", "w"), "w").withColumn("cost", cost).where(F.col("cost") < light)
    first = by_routes.select("v", "w", "weight", F.col("v").alias("a"), F.col("w").alias("b")).distinct()
    taken = straight.where(F.col("weight") < light).select("v", "w", "weight", F.col("v").alias("a"), F.col("w").alias("b"))
    taken = cut_lineage(taken.unionByName(first).unionByName(by_routes.select("v", "w", "weight", "a", "b")).distinct())
    light_ways = taken.select("v", "w", "weight").distinct().groupBy("v").agg(F.count("*").alias("light"), F.max_by("w", F.struct("weight", -F.col("w"))).alias("keep"))
    all_ways = ways.groupBy("v").agg(F.count("*").alias("ways"))
    spared = light_ways.join(all_ways, "v").where("light = ways").select("v", F.col("keep").alias("w"))
    steps = taken.join(spared, ["v", "w"], "left_anti").select(F.col("a").alias("v"), F.col("b").alias("w"))
    gone = cut_lineage(steps.union(steps.select(twin(F.col("w")), twin(F.col("v")))).distinct().join(paths.select("v", "w"), ["v", "w"], "left_semi"))
    left = paths.join(gone, ["v", "w"], "left_anti")
    return _still_gone(gone, left)


def _still_gone(gone: DataFrame, left: DataFrame) -> DataFrame:
    """gone without the edges that go from a node without ways out in left to one without ways in."""
    out, into = left.select("v", F.lit(True).alias("out")).distinct(), left.select("w", F.lit(True).alias("into")).distinct()
    return gone.join(out, "v", "left").join(into, "w", "left").where("out or into").select("v", "w")


def without_repeat_branches(edges: DataFrame, most: int = 64) -> DataFrame:
    """edges (v, w, weight) when every branching node, in order of nodes, keeps its heaviest way out only; twins go together.

    Rounds: a node is decided when it is smaller than all undecided ones whose ways out have twins among its own, so
    the result is that of going one by one.
    """
    edges = cut_lineage(edges)
    open_ = cut_lineage(branching_nodes(edges, most).select(F.col("node").alias("v")))
    while open_.head(1):
        ways = edges.join(open_, "v", "left_semi").withColumn("other", twin(F.col("w")))
        waits = ways.where("other < v").join(open_.toDF("other"), "other", "left_semi").select("v").distinct()
        now = cut_lineage(open_.join(waits, "v", "left_anti"))
        order = Window.partitionBy("v").orderBy(F.desc("weight"), "w")
        gone = edges.join(now, "v", "left_semi").withColumn("k", F.row_number().over(order)).where("k > 1").select("v", "w")
        gone = gone.union(gone.select(twin(F.col("w")), twin(F.col("v"))))
        edges = cut_lineage(edges.join(gone, ["v", "w"], "left_anti"))
        open_ = cut_lineage(open_.join(now, "v", "left_anti"))
    return edges


def nearest_routes(edges: DataFrame, sources: DataFrame, reads: DataFrame, longest: int = 8) -> DataFrame:
    """(source, path): from each source (column node) the nodes to the nearest other node on one of the reads (column read).

    Nearest: fewest edges, then the smallest node; of routes as short, the one with the smaller nodes first.  Paths have
    `longest` nodes at most; a source without such a path has no row.
    """
    ways = cut_lineage(edges.select(F.col("v").alias("node"), "w").distinct())
    front = cut_lineage(sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path")).distinct())
    seen, done = front.select("source", "node"), None
    for _ in range(longest - 1):
        hop = front.join(ways, "node").select("source", F.col("w").alias("node"), F.concat("path", F.array("w")).alias("path"))
        new = cut_lineage(hop.join(seen, ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path")))
        hits = new.withColumn("read", F.shiftright("node", 1)).join(reads, "read", "left_semi")
        hits = cut_lineage(hits.groupBy("source").agg(F.min_by("path", "node").alias("path")))
        done = hits if done is None else done.unionByName(hits)
        front = cut_lineage(new.join(hits.select("source"), "source", "left_anti"))
        if not front.head(1):
            break
        seen = cut_lineage(seen.unionByName(front.select("source", "node")))
    return done


def without_repeat_bridges(edges: DataFrame, most: int = 32, longest: int = 8) -> DataFrame:
    """edges when short ways between branching nodes go, for each such node the way to the nearest one; twins go together.

    Rounds of independent removals: each undecided node looks for its way among the edges that are left; ways that come
    first (by their node) at every read they touch go, and their nodes are decided, as are nodes that find none.
    """
    edges = cut_lineage(edges)
    open_ = cut_lineage(branching_nodes(edges, most))
    reads = cut_lineage(open_.select(F.shiftright("node", 1).alias("read")).distinct())
    while open_.head(1):
        routes = cut_lineage(nearest_routes(edges, open_, reads, longest))
        touched = routes.select("source", F.explode(F.array_distinct(F.transform("path", lambda v: F.shiftright(v, 1)))).alias("read"))
        turns = touched.join(touched.groupBy("read").agg(F.min("source").alias("least")), "read")
        now = cut_lineage(turns.groupBy("source").agg(F.bool_and(F.col("source") == F.col("least")).alias("now")).where("now").select("source"))
        pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("v"), F.get("path", i + 1).alias("w")))
        steps = routes.join(now, "source", "left_semi").select(F.explode(pairs).alias("e")).select("e.v", "e.w")
        edges = cut_lineage(edges.join(steps.union(steps.select(twin(F.col("w")), twin(F.col("v")))), ["v", "w"], "left_anti"))
        open_ = cut_lineage(routes.join(now, "source", "left_anti").select(F.col("source").alias("node")))
    return edges
