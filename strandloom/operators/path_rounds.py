"""The rule of `paths` by joins: paths through components of any size, with no component in one task.

Chains and vertices of all components go through each round together.  Scores spread from the ends in rounds of joins;
choices make a forest of pointers, on which pointer doubling tells every vertex the best begin above it, its tree and its
depth; the best begin's path goes on where paths meet.  Ways off are searched for all vertices of all paths at once.
Paths that would use each other's strands are decided in rounds: those first that are before all undecided ones they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import components, twin, unitigs
from strandloom.operators.paths import BRANCH, PRIMARY, SHORT
from strandloom.plans.lineage import cut_lineage


def chain_nodes(edges: DataFrame) -> DataFrame:
    """(begin, second, node, ord) of the chains; a cycle without vertices is one chain from its smallest node to itself."""
    found = cut_lineage(unitigs(edges))
    steps = found.select(F.lag("node").over(Window.partitionBy("begin", "second").orderBy("ord")).alias("v"), F.col("node").alias("w")).where("v is not null")
    rest = cut_lineage(edges.select("v", "w").join(steps, ["v", "w"], "left_anti"))
    if not rest.head(1):
        return found
    opened = rest.join(components(rest).withColumnRenamed("node", "w"), "w").where("w <> component").select("v", "w")
    round_ = cut_lineage(unitigs(cut_lineage(opened)))
    closing = round_.groupBy("begin", "second").agg(F.max("ord").alias("ord")).select("begin", "second", F.col("begin").alias("node"), (F.col("ord") + 1).alias("ord"))
    return cut_lineage(found.unionByName(round_).unionByName(closing))


def _settled(chains: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """(node, score, chain, whole, inner, level) of all vertices; chains: component, begin, second, end, k, sign, pal, end_sign."""
    part = F.when(F.col("pal"), F.floor(F.col("k") / 2)).when(F.col("sign") < 0, F.lit(0)).otherwise(F.col("k")).cast("long")
    waiting = chains.select("component", "begin", "second", "end", "pal", (F.col("k") * F.col("sign") + F.col("end_sign")).alias("gain"), part.alias("part"))
    begins = chains.select(F.col("begin").alias("node")).distinct()
    sinks = chains.select(F.col("end").alias("node")).distinct().join(begins, "node", "left_anti")
    none = {"score": F.lit(0).cast("long"), "chain": F.lit(None).cast("long"), "whole": F.lit(False), "inner": F.lit(0).cast("long"), "level": F.lit(0)}
    done = [cut_lineage(sinks.select("node", *(c.alias(n) for n, c in none.items())))]
    waiting = cut_lineage(waiting.join(done[0].select(F.col("node").alias("end"), F.col("score").alias("ahead")), "end", "left"))
    level = 0
    while waiting.head(1):
        level += 1
        full = F.when(F.col("ahead").isNotNull() & ~F.col("pal"), F.col("gain") + F.col("ahead"))
        whole = F.coalesce(full >= F.col("part"), F.lit(False))
        ways = waiting.withColumn("best", F.struct(F.when(whole, full).otherwise(F.col("part")).alias("value"), (-F.col("second")).alias("second"), whole.alias("whole"), F.col("part").alias("inner")))
        nodes = ways.groupBy("component", "begin").agg(F.max("best").alias("best"), F.bool_and(F.col("ahead").isNotNull() | (F.col("end") == F.col("begin"))).alias("ready"))
        nodes = cut_lineage(nodes)
        now = nodes.where("ready")
        stuck = nodes.join(now.select("component").distinct(), "component", "left_anti")
        if stuck.head(1):
            far = far if far is not None else _far(chains)
            last = F.max_by(F.struct("begin", "best"), F.struct(F.coalesce("far", F.lit(-1)), -F.col("begin"))).alias("x")
            last_ = stuck.join(far.withColumnRenamed("node", "begin"), "begin", "left").groupBy("component").agg(last).select("component", "x.begin", "x.best")
            now = now.select("component", "begin", "best").unionByName(last_)
        chosen = F.col("best.value") > 0
        new = now.select(F.col("begin").alias("node"), F.greatest(F.col("best.value"), F.lit(0)).alias("score"), F.when(chosen, -F.col("best.second")).alias("chain"), (chosen & F.col("best.whole")).alias("whole"), F.col("best.inner").alias("inner"), F.lit(level).alias("level"))
        done.append(cut_lineage(new) if far is not None else new)
        fresh = done[-1].select(F.col("node").alias("end"), F.col("score").alias("new"))
        waiting = waiting.join(done[-1].select(F.col("node").alias("begin")), "begin", "left_anti").join(fresh, "end", "left")
        waiting = cut_lineage(waiting.withColumn("ahead", F.coalesce("ahead", "new")).drop("new"))
    return cut_lineage(reduce(DataFrame.unionByName, done))


def _seeds(chains: DataFrame) -> DataFrame:
    """(component, node): begins without incoming chains; in components without any, the smallest begin."""
    begins = chains.select("component", F.col("begin").alias("node")).distinct()
    free = begins.join(chains.select(F.col("end").alias("node")).distinct(), "node", "left_anti").select("component", "node")
    free = cut_lineage(free)
    closed = begins.join(free.select("component").distinct(), "component", "left_anti").groupBy("component").agg(F.min("node").alias("node"))
    return free.unionByName(closed)


def _far(chains: DataFrame) -> DataFrame:
    """(node, far): chains from the nearest seed."""
    front = cut_lineage(_seeds(chains).select("node", F.lit(0).alias("far")))
    seen, steps, far = front, chains.select(F.col("begin").alias("node"), "end"), 0
    while front.head(1):
        far += 1
        new = front.join(steps, "node").select(F.col("end").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut_lineage(new.select("node", F.lit(far).alias("far")))
        seen = cut_lineage(seen.unionByName(front))
    return seen


def _signed(chains: DataFrame) -> DataFrame:
    """chains with sign and end_sign: -1 where a read's second strand stands, if both strands hang together."""
    label = components(chains.select(F.col("begin").alias("v"), F.col("end").alias("w")))
    both = cut_lineage(label.join(label.select(twin(F.col("node")).alias("node"), "component"), ["node", "component"], "left_semi").select("node"))
    plain = chains.withColumn("sign", F.lit(1)).withColumn("end_sign", F.lit(1))
    if not both.head(1):
        return plain
    level = _settled(plain).select("node", "level")
    other = level.select(twin(F.col("node")).alias("node"), F.col("level").alias("other"))
    later = F.struct("level", -F.col("node")) < F.struct(F.coalesce("other", F.lit(0)).alias("level"), -twin(F.col("node")))
    second = cut_lineage(level.join(other, "node", "left").join(both, "node").where(later).select(F.col("node").alias("end"), F.lit(-1).alias("end_sign_")))
    key = plain.join(other.select(F.col("node").alias("begin"), "other"), "begin", "left").select("begin", "second", "twin_begin", "twin_second", F.struct(F.coalesce("other", F.lit(0)).alias("level"), "begin", "second").alias("key"))
    key = cut_lineage(key)
    pair = key.join(key.select(F.col("begin").alias("twin_begin"), F.col("second").alias("twin_second"), F.col("key").alias("twin_key")), ["twin_begin", "twin_second"])
    back = cut_lineage(pair.where("key > twin_key").join(both.withColumnRenamed("node", "begin"), "begin", "left_semi").select("begin", "second", F.lit(-1).alias("sign_")))
    joined = plain.join(second, "end", "left").join(back, ["begin", "second"], "left")
    return joined.withColumn("sign", F.coalesce("sign_", "sign")).withColumn("end_sign", F.coalesce("end_sign_", "end_sign")).drop("sign_", "end_sign_")


def _trees(settled: DataFrame, chains: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, best, depth, next, chain, whole, inner): the best begin above each vertex and the choices down to its root."""
    ends = chains.select(F.col("begin").alias("node"), F.col("second").alias("chain"), "end")
    tree = settled.join(ends, ["node", "chain"], "left").withColumn("next", F.when(F.col("whole"), F.col("end")))
    own = seeds.join(settled.select("node", "score"), "node").select("node", F.struct("score", (-F.col("node")).alias("seed")).alias("best"))
    tree = cut_lineage(tree.join(own, "node", "left").select("node", "score", "chain", "whole", "inner", "next", F.col("next").alias("jump"), F.col("next").isNotNull().cast("long").alias("depth"), "best"))
    while tree.where("jump is not null").head(1):
        up = tree.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.max("best").alias("above"))
        ahead = tree.select(F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("depth").alias("more"))
        joined = tree.join(up, "node", "left").join(ahead, "jump", "left")
        tree = cut_lineage(joined.select("node", "score", "chain", "whole", "inner", "next", F.col("further").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.greatest("best", "above").alias("best")))
    return tree.drop("jump")


def _passed(tree: DataFrame) -> DataFrame:
    """(seed, label, top): path seed has the vertices of path label whose depth is top or less."""
    named = tree.where("best is not null").select("node", "next", "depth", (-F.col("best.seed")).alias("label"))
    named = cut_lineage(named)
    starts = named.where("node = label").select(F.col("label").alias("seed"), "label", F.col("depth").alias("top"))
    last = named.join(named.select(F.col("node").alias("next"), F.col("label").alias("onto"), F.col("depth").alias("at")), "next").where("label <> onto")
    last = cut_lineage(last.select("label", "onto", "at"))
    rows = front = cut_lineage(starts)
    while True:
        front = cut_lineage(front.join(last, "label").select("seed", F.col("onto").alias("label"), F.col("at").alias("top")))
        if not front.head(1):
            return rows
        rows = cut_lineage(rows.unionByName(front))


def _branching(arrivals: DataFrame, chains: DataFrame, tree: DataFrame, passed: DataFrame, branch: int) -> DataFrame:
    """(seed, index): the arrivals (seed, index, node) at vertices where a way off the path goes on for long.

    Each way off is searched chain by chain for all paths at once; it ends where it meets the path, has counted more
    than `branch` nodes, or has nowhere to go.
    """
    place = tree.where("best is not null").select("node", (-F.col("best.seed")).alias("label"), "depth", "chain")
    shape = chains.select("begin", "second", "end", "k", "twin_begin", "twin_second")
    many = chains.groupBy(F.col("begin").alias("node")).agg(F.count("*").alias("n")).where("n >= 2").select("node")
    at = arrivals.unionByName(arrivals.withColumn("node", twin(F.col("node")))).join(many, "node", "left_semi")
    first = cut_lineage(at.join(shape.withColumnRenamed("begin", "node"), "node").select("seed", "index", "node", "second", F.col("node").alias("begin"), "end", "k", "twin_begin", "twin_second"))
    if not first.head(1):
        return first.select("seed", "index")

    def on_vertex(rows: DataFrame, column: str) -> DataFrame:
        """The ways (seed, node, second) of rows whose vertex, on either strand, is on the path."""
        either = rows.select("seed", "node", "second", F.explode(F.array(F.col(column), twin(F.col(column)))).alias("x"))
        met = either.join(place.select(F.col("node").alias("x"), "label", "depth"), "x").join(passed, ["seed", "label"]).where("depth <= top")
        return met.select("seed", "node", "second").distinct()

    def on_chain(rows: DataFrame) -> DataFrame:
        """The ways of rows whose chain (begin, by), on either strand, is on the path."""
        either = rows.select("seed", "node", "second", F.explode(F.array(F.struct("begin", F.col("by").alias("chain")), F.struct(F.col("twin_begin").alias("begin"), F.col("twin_second").alias("chain")))).alias("c"))
        met = either.select("seed", "node", "second", F.col("c.begin").alias("x"), F.col("c.chain").alias("chain"))
        met = met.join(place.select(F.col("node").alias("x"), "label", "depth", "chain"), ["x", "chain"]).join(passed, ["seed", "label"]).where("depth <= top")
        return met.select("seed", "node", "second").distinct()

    way = ["seed", "node", "second"]
    front = first.withColumn("by", F.col("second"))
    skip = on_chain(front.where("k > 0")).unionByName(on_vertex(front.where("k = 0"), "end")).distinct()
    front = front.join(skip, way, "left_anti").select(*way, "begin", "by", "end", "k", "twin_begin", "twin_second", F.lit(0).cast("long").alias("count")).distinct()
    front = cut_lineage(front)
    seen = cut_lineage(front.select(*way, F.col("node").alias("x")).distinct())
    long_ = None
    while front.head(1):
        ends = front.where(F.col("count") + F.col("k") <= branch).select(*way, F.col("end").alias("x")).distinct().join(seen, [*way, "x"], "left_anti")
        ends = cut_lineage(ends)
        met = on_chain(front.where("k > 0")).unionByName(on_vertex(ends, "x")).distinct()
        sums = front.groupBy(*way).agg(F.max("count").alias("count"), F.sum("k").alias("inner")).join(ends.groupBy(*way).agg(F.count("*").alias("ends")), way, "left")
        sums = cut_lineage(sums.join(met, way, "left_anti").select(*way, (F.col("count") + F.col("inner") + F.coalesce("ends", F.lit(0))).alias("count")))
        far = sums.where(F.col("count") > branch).select(*way)
        long_ = far if long_ is None else long_.unionByName(far)
        on = ends.join(sums.where(F.col("count") <= branch), way)
        seen = cut_lineage(seen.unionByName(ends))
        front = cut_lineage(_onward(on, shape, way))
    if long_ is None:
        return first.select("seed", "index").limit(0)
    return first.join(long_.distinct(), way, "left_semi").select("seed", "index").distinct()


def _onward(ends: DataFrame, shape: DataFrame, way: list[str]) -> DataFrame:
    """The chains that begin at the ends (x) of ways."""
    ahead = shape.select(F.col("begin").alias("x"), F.col("second").alias("by"), "end", "k", "twin_begin", "twin_second")
    return ends.join(ahead, "x").select(*way, F.col("x").alias("begin"), "by", "end", "k", "twin_begin", "twin_second", "count")


def _decided(used: DataFrame, cuts: DataFrame) -> DataFrame:
    """(seed, cut): how many of its chains each path keeps.

    used: seed, score, index, begin, second, twin_begin, twin_second; cuts: seed, cut, before strands are compared.  A path stops where it would use
    the other strand of a chain that a path before it, by score and begin, or it itself uses.
    """
    a = used.select("seed", "score", "index", "twin_begin", "twin_second")
    b = used.select(F.col("seed").alias("seed_"), F.col("score").alias("score_"), F.col("index").alias("index_"), F.col("begin").alias("twin_begin"), F.col("second").alias("twin_second"))
    met = cut_lineage(a.join(b, ["twin_begin", "twin_second"]).drop("twin_begin", "twin_second"))
    own = met.where("seed = seed_ and index > index_").groupBy("seed").agg(F.min("index").alias("own"))
    open_ = cut_lineage(cuts.join(own, "seed", "left").select("seed", F.least("cut", "own").cast("long").alias("cut")))
    before = F.struct((-F.col("score_")).alias("s"), F.col("seed_").alias("x")) < F.struct((-F.col("score")).alias("s"), F.col("seed").alias("x"))
    met = cut_lineage(met.where(F.col("seed") != F.col("seed_")).where(before))
    done = None
    while open_.head(1):
        live = met.join(open_, "seed").where("index < cut").drop("cut")
        waits = live.join(open_.select(F.col("seed").alias("seed_"), F.col("cut").alias("cut_")), "seed_").where("index_ < cut_").select("seed").distinct()
        now = cut_lineage(open_.join(waits, "seed", "left_anti"))
        done = now if done is None else done.unionByName(now)
        stop = met.join(now.select(F.col("seed").alias("seed_"), F.col("cut").alias("cut_")), "seed_").where("index_ < cut_").groupBy("seed").agg(F.min("index").alias("stop"))
        open_ = cut_lineage(open_.join(now, "seed", "left_anti").join(stop, "seed", "left").select("seed", F.least("cut", "stop").alias("cut")))
    return done


def paths_by_rounds(edges: DataFrame, member: DataFrame, branch: int = BRANCH) -> DataFrame:
    """(component, path, tag, ord, node) as `paths.paths_of` gives them; member: node, component, with twins in one."""
    left = cut_lineage(edges.where("v <> w").select("v", "w").distinct())
    out, number = None, None
    owner = None
    turn = 0
    while left.head(1):
        turn += 1
        nodes = cut_lineage(chain_nodes(left))
        by_ord = nodes.groupBy("begin", "second").agg(F.max_by("node", "ord").alias("end"), (F.max("ord") - 1).alias("k"), F.max("ord").alias("last"))
        before = nodes.join(by_ord.select("begin", "second", (F.col("last") - 1).alias("ord")), ["begin", "second", "ord"]).select("begin", "second", F.col("node").alias("before"))
        chains = by_ord.drop("last").join(before, ["begin", "second"]).join(member.withColumnRenamed("node", "begin"), "begin")
        chains = chains.select("component", "begin", "second", "end", "k", twin(F.col("end")).alias("twin_begin"), twin(F.col("before")).alias("twin_second"))
        chains = cut_lineage(chains.withColumn("pal", (F.col("twin_begin") == F.col("begin")) & (F.col("twin_second") == F.col("second"))))
        signed = cut_lineage(_signed(chains))
        tree = _trees(_settled(signed), chains, cut_lineage(_seeds(chains)))
        passed = cut_lineage(_passed(tree))
        seeds = tree.where("best is not null and -best.seed = node").select(F.col("node").alias("seed"), "score", F.col("depth").alias("whole_depth"))
        named = tree.where("best is not null and chain is not null").select("node", (-F.col("best.seed")).alias("seed"), "chain", "whole", "inner", "next", "depth").join(seeds, "seed")
        used = named.select("seed", "score", (F.col("whole_depth") - F.col("depth")).alias("index"), F.col("node").alias("begin"), F.col("chain").alias("second"), "whole", "inner", "next")
        used = cut_lineage(used.join(chains.select("begin", "second", "twin_begin", "twin_second"), ["begin", "second"]))
        off = _branching(used.where("whole").select("seed", "index", F.col("next").alias("node")), chains, tree, passed, branch)
        cuts = used.groupBy("seed").agg(F.count("*").alias("n")).join(off.groupBy("seed").agg(F.min(F.col("index") + 1).alias("cut")), "seed", "left").select("seed", F.least("n", "cut").alias("cut"))
        cut = _decided(used, cut_lineage(cuts))
        if cut is None:
            break
        kept = cut_lineage(used.join(cut, "seed").where("index < cut"))
        if not kept.head(1):
            break
        spread = nodes.join(kept.select("seed", "score", "index", "begin", "second", "whole", "inner"), ["begin", "second"]).join(by_ord.select("begin", "second", "last"), ["begin", "second"])
        final = Window.partitionBy("seed")
        spread = spread.withColumn("ends", F.col("index") == F.max("index").over(final)).where((F.col("whole") & ((F.col("ord") < F.col("last")) | F.col("ends"))) | (~F.col("whole") & (F.col("ord") <= F.col("inner"))))
        rows = spread.withColumn("at", F.row_number().over(final.orderBy("index", "ord")) - 1).withColumn("steps", F.count("*").over(final) - 1)
        rows = cut_lineage(rows.select("seed", "score", "node", F.col("at").cast("int").alias("ord"), "steps"))
        pairs = rows.withColumn("w", F.lead("node").over(final.orderBy("ord"))).where("w is not null").select(F.col("node").alias("v"), "w")
        left = cut_lineage(left.join(pairs.union(pairs.select(twin(F.col("w")), twin(F.col("v")))), ["v", "w"], "left_anti"))
        found = rows.where(F.col("steps") >= SHORT).select("seed", "score", "steps").distinct().join(member.withColumnRenamed("node", "seed"), "seed")
        base = F.lit(0) if number is None else F.coalesce("base", F.lit(0))
        found = found if number is None else found.join(number, "component", "left")
        order = Window.partitionBy("component").orderBy(F.desc("score"), "seed")
        found = cut_lineage(found.withColumn("path", (base + F.row_number().over(order) - 1).cast("int")).select("component", "path", "seed", "steps"))
        if not found.head(1):
            continue
        read = F.shiftright("node", 1).alias("read")
        placed = rows.join(found.select("component", "path", "seed"), "seed")
        mine = placed.where(F.col("steps") >= PRIMARY).select("component", read, "path")
        owner = cut_lineage((mine if owner is None else owner.unionByName(mine)).groupBy("component", "read").agg(F.min("path").alias("path")))
        of = placed.where(F.col("steps") < PRIMARY).select("component", "path", "ord", read).join(owner.select("component", "read", F.col("path").alias("whose")), ["component", "read"])
        again = of.where("ord > 0").select("component", "path", "whose").join(of.where("ord = 0").select("component", "path", "whose"), ["component", "path", "whose"], "left_semi").select("component", "path").distinct()
        tagged = found.join(again.withColumn("again", F.lit(True)), ["component", "path"], "left")
        tag = F.when(F.col("steps") >= PRIMARY, "P").when(F.col("again"), "A").otherwise("D").alias("tag")
        new = cut_lineage(rows.select("seed", "ord", "node").join(tagged.select("component", "path", "seed", tag), "seed").select("component", "path", "tag", "ord", "node"))
        out = new if out is None else out.unionByName(new)
        number = cut_lineage(out.groupBy("component").agg((F.max("path") + 1).alias("base")))
    if out is None:
        return edges.sparkSession.createDataFrame([], "component long, path int, tag string, ord int, node long")
    return out
