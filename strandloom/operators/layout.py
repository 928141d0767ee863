"""Paths through reduced string graphs and the contigs they spell.

Graphs are reduced and split into components in DataFrame operations; small components are walked in a task each, large
ones by joins.  An edge v to w carries `off`, where read w starts in coordinates of read v.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import reverse_complement
from strandloom.operators.catalog import dense_ids
from strandloom.operators.consensus import polished_contigs
from strandloom.operators.graph import components, twin, without_short_cycles
from strandloom.operators.path_rounds import paths_by_rounds
from strandloom.operators.paths import paths_of
from strandloom.operators.search import repeat_detours
from strandloom.operators.sketch import sketch_offset
from strandloom.plans.lineage import cut_lineage

#: Edges of a component that one task walks, at most.
IN_TASK = 100_000
#: Bases at the begin of an overlap in which the cut is looked for.
WINDOW = 100


def placed_edges(ovlp: DataFrame, *also: str) -> DataFrame:
    """(v, w, weight, off) of dovetail overlaps, with the twins of all edges; of equal edges the heaviest.

    Offsets come from the aligned ranges, as d_left may be off by a base or two.  `also`: more columns, those of the
    overlap, or from0 and from1, where the aligned range begins on v and on w as they stand in the edge.
    """
    a, b = F.col("rid0") * 2, F.col("rid1") * 2 + F.col("strand1")
    right = F.col("d_left") > 0
    rows = ovlp.where("(d_left > 0 and d_right > 0) or (d_left < 0 and d_right < 0)")
    first, last = (F.col("bgn0"), F.col("bgn1")), (F.col("len0") - F.col("end0"), F.col("len1") - F.col("end1"))
    edges = rows.select(
        F.when(right, a).otherwise(b).alias("v"), F.when(right, b).otherwise(a).alias("w"), (F.col("end0") - F.col("bgn0")).alias("weight"), *(c for c in also if c not in ("from0", "from1")),
        F.when(right, first[0]).otherwise(first[1]).alias("from0"), F.when(right, first[1]).otherwise(first[0]).alias("from1"),
        F.when(right, last[1]).otherwise(last[0]).alias("back0"), F.when(right, last[0]).otherwise(last[1]).alias("back1"),
    )
    more = lambda x, y: [F.col(x).alias(c) if c == "from0" else F.col(y).alias(c) if c == "from1" else F.col(c) for c in also]
    ahead = edges.select("v", "w", "weight", (F.col("from0") - F.col("from1")).alias("off"), *more("from0", "from1"))
    both = ahead.union(edges.select(twin(F.col("w")), twin(F.col("v")), "weight", F.col("back0") - F.col("back1"), *more("back0", "back1")))
    return both.groupBy("v", "w").agg(F.max(F.struct("weight", "off", *also)).alias("best")).select("v", "w", "best.weight", "best.off", *(f"best.{c}" for c in also))


def layouts(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(component, path, tag, ord, node): the paths of each component of a reduced graph.

    Components up to `in_task` edges are walked in a task each; larger ones go through the same rule by joins.
    """
    member = cut_lineage(components(edges.select("v", "w").union(edges.select(twin(F.col("v")), twin(F.col("w")))).union(edges.select("v", twin(F.col("v"))))))
    split = edges.select("v", "w").join(member.withColumnRenamed("node", "v"), "v")
    large = cut_lineage(split.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("component"))

    def walk(table: pa.Table) -> pa.Table:
        component = table.column("component")[0].as_py()
        found = paths_of(list(zip(table.column("v").to_pylist(), table.column("w").to_pylist(), strict=True)))
        out = [(component, k, tag, i, v) for k, (tag, nodes) in enumerate(found) for i, v in enumerate(nodes)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("component", "path", "tag", "ord", "node"), columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)})

    small = split.join(large, "component", "left_anti").select("component", "v", "w")
    done = small.groupBy("component").applyInArrow(walk, "component long, path int, tag string, ord int, node long")
    if not large.head(1):
        return done
    rest = split.join(large, "component", "left_semi").select("v", "w")
    return done.unionByName(paths_by_rounds(rest, member.join(large, "component", "left_semi")))


def _cuts(steps: DataFrame) -> DataFrame:
    """steps (with seq, next_seq and off) with end, where the read is cut, and skip, where the next one goes on from.

    The cut is at the first minimizer that the reads share where the overlap begins, so that both agree on it; without
    one it is where the aligned ranges say that the next read starts.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, end, skip = batch.column("off").to_pylist(), [], []
            for at, a, b in zip(off, batch.column("seq"), batch.column("next_seq"), strict=True):
                found = None if at is None else sketch_offset(a.as_py()[max(at, 0) : max(at, 0) + WINDOW].encode(), b.as_py()[:WINDOW].encode())
                x, y = found or (0, 0)
                end.append(None if at is None else at + x)
                skip.append(y)
            keep = batch.select(["component", "path", "tag", "ord", "seq"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(end, pa.int32()), pa.array(skip, pa.int32())], names=[*keep.schema.names, "end", "skip"])

    columns = ("component", "path", "tag", "ord", "seq", F.col("off").cast("int").alias("off"), F.coalesce("next_seq", F.lit("")).alias("next_seq"))
    return steps.select(*columns).mapInArrow(cut, "component long, path int, tag string, ord int, seq string, end int, skip int")


def tiles(layout: DataFrame, edges: DataFrame, reads: DataFrame) -> DataFrame:
    """(component, path, tag, ord, seq, at, length): the reads of each path, as they stand on it.

    seq is the read from the place on that the contig takes it up, at the contig's place `at`, and its first `length`
    bases are the contig's.
    """
    order = Window.partitionBy("component", "path").orderBy("ord")
    turned = F.when(F.col("node") % 2 == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    seqs = layout.withColumn("rid", F.shiftright("node", 1)).join(reads.select("rid", "seq"), "rid").withColumn("seq", turned)
    steps = seqs.withColumn("next", F.lead("node").over(order)).withColumn("next_seq", F.lead("seq").over(order))
    placed = steps.join(edges.select(F.col("v").alias("node"), F.col("w").alias("next"), "off"), ["node", "next"], "left")
    cut = _cuts(placed).withColumn("begin", F.coalesce(F.lag("skip").over(order), F.lit(0)))
    cut = cut.withColumn("length", F.greatest(F.coalesce("end", F.length("seq")) - F.col("begin"), F.lit(0)))
    at = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return cut.select("component", "path", "tag", "ord", F.expr("substring(seq, begin + 1)").alias("seq"), at.alias("at"), "length")


def contig_name(number: Column) -> Column:
    """The name of a contig, from its number and its tag."""
    return F.concat(F.lit("ctg"), F.lpad(number.cast("string"), 6, "0"), F.lit("_"), F.col("tag"))


def spell(tiled: DataFrame) -> DataFrame:
    """(component, path, tag, n_reads, seq): what the tiles of each path spell."""
    parts = tiled.select("component", "path", "tag", F.struct("ord", F.expr("substring(seq, 1, length)").alias("piece")).alias("part"))
    made = parts.groupBy("component", "path", "tag").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return made.select("component", "path", "tag", F.size("parts").alias("n_reads"), F.array_join("parts.piece", "").alias("seq"))


def contigs(layout: DataFrame, edges: DataFrame, reads: DataFrame, polish: bool = True, min_len: int = 1200) -> DataFrame:
    """(ctg, tag, n_reads, seq) of the paths, rewritten by the majority of their reads; names are numbered by component and path.

    Contigs with too large a share of bases that few reads cover are left out, unless polish is off.
    """
    tiled = cut_lineage(tiles(layout, edges, reads))
    raw = cut_lineage(spell(tiled))
    paths = raw.select("component", "path").withColumn("ord", F.col("component") * (1 << 20) + F.col("path"))
    named = cut_lineage(raw.join(dense_ids(paths, "ord", "number"), ["component", "path"]).withColumn("ctg", contig_name(F.col("number"))))
    if not polish:
        return named.select("ctg", "tag", "n_reads", "seq")
    laid = tiled.join(named.select("component", "path", "ctg"), ["component", "path"]).select("ctg", F.col("at").alias("bgn"), "seq")
    better = polished_contigs(named.select("ctg", "seq"), laid, min_len)
    return named.drop("seq").join(better.select("ctg", "seq"), "ctg").select("ctg", "tag", "n_reads", "seq")


def reduce_by_unitigs(edges: DataFrame, unitigs: DataFrame) -> DataFrame:
    """edges on the unitigs (begin, second, node, ord) that `repeat_detours` leaves.

    The graph of unitigs has an edge for each pair of ends, as heavy as the unitig has nodes (of several, the one with the
    largest second node); it is searched and cut by joins.
    """
    ends = cut_lineage(unitigs.groupBy("begin", "second").agg(F.max_by("node", "ord").alias("end"), F.count("*").alias("n")))
    paths = ends.groupBy(F.col("begin").alias("v"), F.col("end").alias("w")).agg(F.max_by("n", "second").alias("weight"))
    gone = repeat_detours(paths)
    stay = cut_lineage(ends.join(gone.toDF("begin", "end"), ["begin", "end"], "left_anti").select("begin", "second"))
    order = Window.partitionBy("begin", "second").orderBy("ord")
    steps = unitigs.join(stay, ["begin", "second"], "left_semi").withColumn("w", F.lead("node").over(order)).where("w is not null").select(F.col("node").alias("v"), "w").distinct()
    return edges.join(steps, ["v", "w"], "left_semi")


def cross_edges(links: DataFrame, unitigs: DataFrame) -> DataFrame:
    """Of the links (v, w, weight) between unitigs, the heaviest out of each unitig's end that is also the heaviest in."""
    ends = unitigs.groupBy("begin", "second").agg(F.max_by("node", "ord").alias("end"))
    begins = ends.select(F.col("begin").alias("w")).distinct()
    between = links.join(ends.select(F.col("end").alias("v")).distinct(), "v", "left_semi").join(begins, "w", "left_semi")
    best = between.groupBy("v").agg(F.max_by("w", F.struct("weight", -F.col("w"))).alias("w"), F.max("weight").alias("weight"))
    return best.groupBy("w").agg(F.max_by("v", F.struct("weight", -F.col("v"))).alias("v"), F.max("weight").alias("weight")).select("v", "w", "weight")


def unitig_links(edges: DataFrame, unitigs: DataFrame) -> DataFrame:
    """(v, w, weight): edges from the end of a unitig to the begin of another that are the heaviest at both.

    Judged on the graph of unitigs, without pairs that link both ways and links between two-way unitigs.  Each node is on
    one unitig at most, which its first node names.
    """
    ends = cut_lineage(unitigs.groupBy("begin").agg(F.max_by("node", "ord").alias("end")))
    between = edges.join(ends.select(F.col("end").alias("v"), F.col("begin").alias("from")), "v").join(ends.select(F.col("begin").alias("w")), "w", "left_semi")
    between = cut_lineage(between.where("from <> w").select("from", "v", "w", "weight"))
    kept = without_short_cycles(between.select(F.col("from").alias("v"), "w", "weight"))
    between = between.join(kept.select(F.col("v").alias("from"), "w"), ["from", "w"], "left_semi")
    return cross_edges(between.select("v", "w", "weight"), unitigs)
