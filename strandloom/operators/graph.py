"""String-graph operators on edge lists: v, w and weight; a node is rid * 2 + strand, its twin the other strand."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.lineage import cut_lineage

#: Neighbour lists of so many edges at most, 8 bytes a neighbour and side, are broadcast.
MOST_BROADCAST = 1 << 21
#: Edges in a cell of three parts of the nodes, about, and ranges of ids tried at most.
CELL, MOST_RANGES = 3 << 20, 256
#: Edges that a task packs at a time.
PACKED = 1 << 20
#: Bytes of the flags from which a cell's bit rows are made at a time; what looking up a neighbour costs in words of bits.
BITS, PROBE_COST = 1 << 26, 64


def twin(node: Column) -> Column:
    return node.bitwiseXOR(F.lit(1))


def dovetail_edges(ovlp: DataFrame) -> DataFrame:
    """Edges of dovetail overlaps: from the read that ends first to the one that reaches further; with their twins."""
    a, b = F.col("rid0") * 2, F.col("rid1") * 2 + F.col("strand1")
    right = F.col("d_left") > 0
    edges = ovlp.select(F.when(right, a).otherwise(b).alias("v"), F.when(right, b).otherwise(a).alias("w"), (F.col("end0") - F.col("bgn0")).alias("weight"))
    return with_twins(edges)


def with_twins(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "w", "weight").union(edges.select(twin(F.col("w")), twin(F.col("v")), "weight"))
    return both.groupBy("v", "w").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    out = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("w").alias("node")).agg(F.count("*").alias("n_in"))
    return into.join(out, "node", "full").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def _packed(v: np.ndarray, w: np.ndarray) -> bytes:
    """Edges sorted by v and w, as steps of v and of w - v in the bytes they need, the bytes of one weight together."""
    parts = [np.array([len(v)], np.int64).tobytes()]
    for x in (np.diff(v, prepend=v[:1]), w - v):
        low = x.min()
        steps = (x - low).view(np.uint64)
        width = max(1, (int(steps.max()).bit_length() + 7) // 8)
        parts += [np.array([low, width], np.int64).tobytes(), steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return np.int64(v[0]).tobytes() + zlib.compress(b"".join(parts), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed[8:])
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(2):
        low, width = np.frombuffer(raw, np.int64, 2, at)
        steps = np.zeros((n, 8), np.uint8)
        steps[:, :width] = np.frombuffer(raw, np.uint8, n * int(width), at + 16).reshape(int(width), n).T
        out.append(steps.view(np.int64).ravel() + low)
        at += 16 + n * int(width)
    v = np.frombuffer(packed, np.int64, 1)[0] + np.cumsum(out[0])
    return v, v + out[1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, edges): the edges (i, j, v, w) from part i to part j, packed, some PACKED of a task at a time."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        i, j, v, w = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("i", "j", "v", "w"))
        order = np.lexsort((w, v, j, i))
        i, j, v, w = i[order], j[order], v[order], w[order]
        cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        first = np.concatenate([[0], cuts])
        packed = [_packed(a, b) for a, b in zip(np.split(v, cuts), np.split(w, cuts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(i[first], pa.int32()), pa.array(j[first], pa.int32()), pa.array(packed, pa.binary())], names=["i", "j", "edges"])

    rows, n = [], 0
    for batch in batches:
        if batch.num_rows:
            rows.append(batch)
            n += batch.num_rows
        if n >= PACKED:
            yield flush(rows)
            rows, n = [], 0
    if rows:
        yield flush(rows)


def _with_degrees(edges: DataFrame) -> DataFrame:
    deg = cut_lineage(degrees(edges))
    left = deg.toDF("v", "v_in", "v_out")
    return edges.join(left, "v").join(deg.toDF("w", "w_in", "w_out"), "w")


def _hits(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], x: int, ends: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int]) -> np.ndarray:
    """Which pairs of ends (v, w) have an x with (v, x) on the left and (w, x) on the right, by bit rows over the x's."""
    found = np.zeros(len(ends[0]), bool)
    wide = max(64, BITS // sum(sizes) // 64 * 64)
    for low in range(0, x, wide):
        bits = []
        for (node, mid), n in zip((left, right), sizes, strict=True):
            here = (mid >= low) & (mid < low + wide)
            flags = np.zeros((n, min(wide, -(-(x - low) // 64) * 64)), bool)
            flags[node[here], mid[here] - low] = True
            bits.append(np.packbits(flags, axis=1).view(np.uint64))
        left_to = np.flatnonzero(~found)
        for k in range(0, len(left_to), 1 << 14):
            rows = left_to[k : k + (1 << 14)]
            found[rows] = (bits[0][ends[0][rows]] & bits[1][ends[1][rows]]).any(axis=1)
    return found


def _looked_up(near: tuple[np.ndarray, np.ndarray], far: tuple[np.ndarray, np.ndarray], x: int, ends: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The same, by looking up the x's of the near end one by one among the pairs (far node, x); n: near nodes."""
    order = np.argsort(near[0], kind="stable")
    mids, first = near[1][order], np.searchsorted(near[0][order], np.arange(n + 1))
    keys, count = np.sort(far[0] * x + far[1]), first[ends[0] + 1] - first[ends[0]]
    found, upto = np.zeros(len(count), bool), np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 21), "right")) - 1)
        row = np.repeat(np.arange(a, b), count[a:b])
        mid = mids[np.arange(len(row)) - (upto[row] - upto[a]) + first[ends[0][row]]]
        key = ends[1][row] * x + mid
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found[row[keys[at] == key]] = True
        a = b
    return found


def _witnessed(table: pa.Table) -> pa.Table:
    """Of a cell's edges from v to w (role 2), those with a way from v to x (role 0) and from x to w (role 1)."""
    role, v, w = (table.column(c).to_numpy() for c in ("role", "v", "w"))
    targets = (v[role == 2], w[role == 2])
    vs, ws, xs = np.unique(targets[0]), np.unique(targets[1]), np.intersect1d(w[role == 0], v[role == 1])
    left, right = (v[role == 0], w[role == 0]), (w[role == 1], v[role == 1])
    left, right = ((node[k], mid[k]) for (node, mid), names in ((left, vs), (right, ws)) for k in (np.isin(node, names) & np.isin(mid, xs),))
    left, right = ((np.searchsorted(names, node), np.searchsorted(xs, mid)) for (node, mid), names in ((left, vs), (right, ws)))
    ends = np.searchsorted(vs, targets[0]), np.searchsorted(ws, targets[1])
    ahead, back = np.bincount(left[0], minlength=len(vs))[ends[0]], np.bincount(right[0], minlength=len(ws))[ends[1]]
    some = np.flatnonzero((ahead > 0) & (back > 0))
    found = np.zeros(len(ends[0]), bool)
    probes = np.minimum(ahead, back)[some]
    if len(some) * (len(xs) // 64 + 1) <= PROBE_COST * int(probes.sum()):
        found[some] = _hits(left, right, len(xs), (ends[0][some], ends[1][some]), (len(vs), len(ws)))
    else:
        for rows, near, far, one, other, n in ((some[ahead[some] <= back[some]], left, right, 0, 1, len(vs)), (some[ahead[some] > back[some]], right, left, 1, 0, len(ws))):
            found[rows] = _looked_up(near, far, len(xs), (ends[one][rows], ends[other][rows]), n)
    return pa.table({"v": targets[0][found], "w": targets[1][found]})


def _witnessed_packed(table: pa.Table) -> pa.Table:
    """_witnessed() of a cell's packed edges."""
    sides = [_unpacked(edges) for edges in table.column("edges").to_pylist()]
    role = np.repeat(table.column("role").to_numpy(), [len(v) for v, _ in sides])
    return _witnessed(pa.table({"role": role, "v": np.concatenate([v for v, _ in sides]), "w": np.concatenate([w for _, w in sides])}))


def _ranged(node: str, cuts: list[int], first: int = 0) -> Column:
    """The number of cuts up to the node, by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(F.col(node) < cuts[half], _ranged(node, cuts[:half], first)).otherwise(_ranged(node, cuts[half + 1 :], first + half + 1))


def _copies(counts: np.ndarray) -> tuple[int, int]:
    """Edges of all cells and of the largest one, by the counts of edges from part to part."""
    there = (counts > 0).astype(np.int64)
    whole = int((counts * (there @ there.T + there.T @ there + there @ there)).sum())
    most = max(int(((counts[i][:, None] + counts + counts[i]) * (there[i][:, None] & there & there[i])).max()) for i in range(len(counts)))
    return whole, most


def _in_cells(edges: DataFrame, n: int, pack: bool = False) -> DataFrame:
    """(cell, role, v, w): each edge in all cells of three parts of the nodes that it can be a side of; pack: (cell, role, edges).

    Where ids that are near each other are linked, parts are ranges of ids: most cells are empty then, and an edge goes to
    few of them.  Else parts are by hash, fewer and in cells of the same size, and the edges of all cells together grow
    with the power 1.5 of the edges.
    """

    def counted(parts: DataFrame, of: int) -> np.ndarray:
        out = np.zeros((of, of), np.int64)
        for r in parts.groupBy("i", "j").count().collect():
            out[r["i"], r["j"]] = r["count"]
        return out

    by_hash = max(1, ceil(sqrt(3 * n / CELL)))
    chosen = edges.withColumns({k: F.pmod(F.xxhash64(c), F.lit(by_hash)).cast("int") for k, c in (("i", "v"), ("j", "w"))})
    counts = np.full((by_hash, by_hash), n // by_hash**2 + 1)
    if by_hash > 1:
        ranges = min(MOST_RANGES, ceil(6 * n / CELL))
        cuts = edges.select(F.col("v").alias("x")).union(edges.select("w")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
        cuts = sorted({int(x) for x in cuts})
        parts = edges.withColumns({"i": _ranged("v", cuts), "j": _ranged("w", cuts)})
        local = counted(parts, len(cuts) + 1)
        whole, most = _copies(local)
        if most <= 2 * CELL and whole < 3 * by_hash * n:
            chosen, counts = parts, local
        else:
            counts = counted(chosen, by_hash)
    there = counts > 0
    rows = []
    for cell, (i, j, k) in enumerate((i, j, k) for i, j in np.argwhere(there).tolist() for k in np.flatnonzero(there[i] & there[j]).tolist()):
        rows += [(i, j, cell, 0), (j, k, cell, 1), (i, k, cell, 2)]
    if not rows:
        rows = [(0, 0, 0, 2)]
    kinds = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("cell", pa.int32()), ("role", pa.int8())])
    cells = edges.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds))
    sides = cells.groupBy("i", "j").agg(F.collect_list(F.struct("cell", "role")).alias("sides"))
    kept = ["v", "w"]
    if pack:
        chosen, kept = chosen.select("i", "j", "v", "w").mapInArrow(_pack, "i int, j int, edges binary"), ["edges"]
    return chosen.join(F.broadcast(sides), ["i", "j"]).select(*kept, F.explode("sides").alias("side")).select("side.cell", "side.role", *kept)


def reducible_edges(edges: DataFrame, stored: bool = False) -> DataFrame:
    """Edges v to w with a witness x: v to x and x to w; stored: edges are read from a table and are not stored again.

    The neighbours of v and of w are gathered once and compared at each edge.  Where all neighbour lists together are
    too large to broadcast, the nodes are cut into parts, and the edges of any three parts meet in a cell of bounded size,
    where neighbours are compared in memory; no way of two edges becomes a row.  Edges are packed before they are copied
    to cells.
    """
    edges = edges.select("v", "w") if stored else cut_lineage(edges.select("v", "w"))
    n = edges.count()
    if n <= MOST_BROADCAST:
        outs, ins = edges.groupBy("v").agg(F.collect_list("w").alias("outs")), edges.groupBy("w").agg(F.collect_list("v").alias("ins"))
        return edges.join(F.broadcast(outs), "v").join(F.broadcast(ins), "w").where(F.arrays_overlap("outs", "ins")).select("v", "w")
    ids = edges.selectExpr("cast(v as long) v", "cast(w as long) w")
    return _in_cells(ids, n, pack=True).groupBy("cell").applyInArrow(_witnessed_packed, "v long, w long").distinct()


def spur_edges(edges: DataFrame) -> DataFrame:
    """Edges of spurs at a start (v without incoming edges) or at an end (w without outgoing ones).

    Nodes that can be the one end and the other are found first, so few edges are looked up where few nodes are an end.
    """
    deg = cut_lineage(degrees(edges))
    found = []
    for end, other, here, there in (("v", "w", "n_in = 0", "n_in >= 2 and n_out >= 1"), ("w", "v", "n_out = 0", "n_out >= 2 and n_in >= 1")):
        ends = cut_lineage(deg.where(here).select(F.col("node").alias(end)))
        mine = edges.select("v", "w").join(ends, end, "left_semi")
        found.append(mine.join(deg.where(there).select(F.col("node").alias(other)), other, "left_semi").select("v", "w"))
    return found[0].union(found[1])


def transitive_reduction(edges: DataFrame, spurs: bool = True) -> DataFrame:
    """edges without those that have a witness, and without spurs, both judged on the input."""
    edges = cut_lineage(edges)
    gone = reducible_edges(edges, stored=True)
    if spurs:
        gone = gone.union(spur_edges(edges))
    return edges.join(cut_lineage(gone.distinct()), ["v", "w"], "left_anti")


def remove_weak_spurs(edges: DataFrame, most: int = 0) -> DataFrame:
    """edges without spurs of this weight or less."""
    weak = edges.join(spur_edges(edges), ["v", "w"], "left_semi").where(F.col("weight") <= most)
    return edges.join(weak.select("v", "w"), ["v", "w"], "left_anti")


def bridge_candidates(edges: DataFrame, most: int = 1 << 30) -> DataFrame:
    """Edges between a branching node and a joining one, lighter than most."""
    return _with_degrees(edges).where(F.col("weight") < most).where("v_out >= 2 and v_in >= 1 and w_out >= 1 and w_in >= 2").select("v", "w", "weight")


def greedy_bridges(edges: Iterable[tuple[int, int, int]], most: int = 1 << 30) -> set[tuple[int, int]]:
    """Edges that remain when bridges go one by one, lightest first, each judged on what is left; twins go together."""
    left = {(v, w): x for v, w, x in edges}
    into, out = {}, {}
    for v, w in left:
        out.setdefault(v, set()).add(w)
        into.setdefault(w, set()).add(v)
    size = lambda of, node: len(of.get(node, ()))
    bridge = lambda v, w: size(out, v) >= 2 and size(into, v) >= 1 and size(out, w) >= 1 and size(into, w) >= 2
    for x, v, w in sorted((x, v, w) for (v, w), x in left.items() if x < most and bridge(v, w)):
        if (v, w) in left and bridge(v, w):
            for a, b in ((v, w), (w ^ 1, v ^ 1)):
                if left.pop((a, b), None) is not None:
                    out[a].discard(b)
                    into[b].discard(a)
    return set(left)


def without_bridges(edges: DataFrame, most: int = 1 << 30) -> DataFrame:
    """What `greedy_bridges` leaves, by rounds: in each, candidates that come first at all reads they touch are decided.

    Candidates that share no read don't change each other's degrees, so the rounds decide as the lightest-first order
    does.  A candidate and its twin are one.
    """
    edges = cut_lineage(edges)
    first = F.least(F.struct("v", "w"), F.struct(twin(F.col("w")).alias("v"), twin(F.col("v")).alias("w")))
    left = cut_lineage(bridge_candidates(edges, most).select(F.struct("weight", first.alias("edge")).alias("rank")).distinct())
    while left.head(1):
        reads = lambda c: (F.shiftright(f"rank.edge.{c}", 1)).alias("read")
        touched = left.select("rank", reads("v")).union(left.select("rank", reads("w")))
        turns = touched.join(touched.groupBy("read").agg(F.min("rank").alias("least")), "read")
        now = cut_lineage(turns.groupBy("rank").agg(F.bool_and(F.col("rank") == F.col("least")).alias("now")).where("now").select("rank"))
        pair = now.select(F.col("rank.edge.v").alias("v"), F.col("rank.edge.w").alias("w"))
        still = bridge_candidates(edges, most).join(pair, ["v", "w"], "left_semi").select("v", "w")
        gone = still.union(still.select(twin(F.col("w")), twin(F.col("v"))))
        edges = cut_lineage(edges.join(gone, ["v", "w"], "left_anti"))
        left = cut_lineage(left.join(now, "rank", "left_anti"))
    return edges


def patch_ends(reduced: DataFrame, ovlp_edges: DataFrame) -> DataFrame:
    """reduced plus all overlap edges into the nodes that begin paths in it, reduced twice again."""
    begins = degrees(reduced).where("n_in = 0 and n_out > 0").select(F.col("node").alias("w"))
    more = with_twins(ovlp_edges.join(begins, "w", "left_semi"))
    both = reduced.select("v", "w", "weight").union(more).groupBy("v", "w").agg(F.max("weight").alias("weight"))
    return transitive_reduction(transitive_reduction(both))


def best_links(edges: DataFrame) -> DataFrame:
    """The heaviest edge of each node."""
    order = Window.partitionBy("v").orderBy(F.desc("weight"), "w")
    return edges.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def clearest_links(edges: DataFrame) -> DataFrame:
    """The best edge of each node where edges have dist_c: ones without a difference at markers, then the heaviest."""
    order = Window.partitionBy("v").orderBy(F.when(F.col("dist_c") == 0, 0).otherwise(1), F.desc("weight"), "w")
    return edges.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose reverse, w to v, is in the list too."""
    return edges.join(edges.select(F.col("w").alias("v"), F.col("v").alias("w")).distinct(), ["v", "w"], "left_semi")


def mutual_links(edges: DataFrame) -> DataFrame:
    """Edges whose twin, the same overlap seen from the other read, is in the list too."""
    return edges.join(edges.select(twin(F.col("w")).alias("v"), twin(F.col("v")).alias("w")).distinct(), ["v", "w"], "left_semi")


def strongest_links(edges: DataFrame) -> DataFrame:
    """Edges that are the heaviest, ties included, of both of their nodes."""
    out, into = Window.partitionBy("v").orderBy(F.desc("weight")), Window.partitionBy("w").orderBy(F.desc("weight"))
    ranked = edges.withColumn("a_", F.rank().over(out)).withColumn("b_", F.rank().over(into))
    return ranked.where("a_ = 1 and b_ = 1").drop("a_", "b_")


def without_short_cycles(edges: DataFrame) -> DataFrame:
    """edges without those that have their reverse in the list, then without edges between two-way nodes."""
    back = edges.select(F.col("w").alias("v"), F.col("v").alias("w"))
    left = edges.join(back, ["v", "w"], "left_anti")
    double = _with_degrees(left).where("v_out >= 2 and w_in >= 2").select("v", "w")
    return left.join(double, ["v", "w"], "left_anti")


def unitigs(edges: DataFrame) -> DataFrame:
    """(begin, second, node, ord): the nodes of each maximal unbranched path, in order.

    Nodes with one edge in and one out are inside a path.  Each edge points to the edge before it in its path and, by
    pointer doubling, learns the path's first edge and its distance from it, in as many rounds as the logarithm of the
    longest path.  Pure cycles have no start and give no path.
    """
    edges = cut_lineage(edges.select("v", "w"))
    inner = cut_lineage(degrees(edges).where("n_in = 1 and n_out = 1").select("node"))
    a, b = edges.select("v", "w"), edges.select(F.col("v").alias("pv"), F.col("w").alias("v"))
    before = b.join(inner.select(F.col("node").alias("v")), "v", "left_semi")
    hop = a.join(before, "v", "left").select("v", "w", F.coalesce("pv", "v").alias("jv"), F.when(F.col("pv").isNull(), F.col("w")).otherwise(F.col("v")).alias("jw"), F.col("pv").isNotNull().cast("long").alias("dist"))
    hop, settled = cut_lineage(hop), -1
    inside = inner.select(F.col("node").alias("jv"))
    while True:
        ends = hop.join(inside, "jv", "left_anti")
        now = ends.count()
        if now == settled:  # what still moves is on pure cycles
            break
        there = hop.select(F.col("v").alias("jv"), F.col("w").alias("jw"), F.col("jv").alias("kv"), F.col("jw").alias("kw"), F.col("dist").alias("more"))
        hop, settled = cut_lineage(hop.join(there, ["jv", "jw"]).select("v", "w", F.col("kv").alias("jv"), F.col("kw").alias("jw"), (F.col("dist") + F.col("more")).alias("dist"))), now
    first = ends.where("dist = 0").select(F.col("jv").alias("begin"), F.col("jw").alias("second"), F.col("v").alias("node"), F.lit(0).cast("long").alias("ord"))
    return first.union(ends.select(F.col("jv").alias("begin"), F.col("jw").alias("second"), F.col("w").alias("node"), F.col("dist") + 1))


def reach(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(start, node, step): what breadth-first search finds from each start (column node) within so many steps."""
    seen = cut_lineage(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("step")).distinct())
    front = seen
    for step in range(1, steps + 1):
        hop = front.join(edges.select(F.col("v").alias("node"), "w"), "node").select("start", F.col("w").alias("node")).distinct()
        front = cut_lineage(hop.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("step", F.lit(step)))
        if not front.head(1):
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def _flat(hook: DataFrame) -> DataFrame:
    """hook (node, component) with every node's component the end of the way that the hooks make from it."""
    while True:
        moved = hook.where("node <> component")
        deep = cut_lineage(moved.join(moved.toDF("component", "top"), "component").select("node", "top"))
        if not deep.head(1):
            return hook
        hook = cut_lineage(hook.join(deep, "node", "left").select("node", F.coalesce("top", "component").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each connected component.

    In a round each node hangs on its smallest neighbour, and the trees made so become the nodes of a smaller graph; only
    edges between trees go on, each once.  The smallest node of a component stays itself in all rounds.  The rounds' labels
    are put together at the end, from the last and smallest one, so the many nodes of the first are looked up once.
    """
    edges, rounds = cut_lineage(edges.select("v", "w")), []
    while not rounds or edges.head(1):
        least = edges.union(edges.select("w", "v")).groupBy(F.col("v").alias("node")).agg(F.min("w").alias("component"))
        rounds.append(_flat(cut_lineage(least.select("node", F.least("node", "component").alias("component")))))
        for end, other in (("w", "v"), ("v", "w")):
            edges = edges.join(rounds[-1].toDF(end, "top"), end).select(other, F.col("top").alias(end)).where("v <> w").distinct()
        edges = cut_lineage(edges.select("v", "w"))
    label = rounds.pop()
    while rounds:
        label = rounds.pop().join(label.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return label
