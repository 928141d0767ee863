"""The whole sequence pipeline: reads to sketches, overlaps, corrected reads, string graph, contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import align, candidates, consensus, contig_map, graph, layout, overlaps, search, sketch
from strandloom.params import Params
from strandloom.plans.lineage import cut_lineage


def find_overlaps(reads: DataFrame, p: Params, min_len: int = 1200) -> DataFrame:
    """Overlaps, with marker statistics, of reads (rid, seq)."""
    pairs = sketch.read_pairs(reads, p)
    same = candidates.copies(reads)
    clusters = candidates.top_group_clusters(candidates.group_clusters(pairs, p, same), same, p)
    aligned = cut_lineage(align.align_groups(clusters, reads, p, min_len))
    return cut_lineage(overlaps.with_markers(aligned.drop("deltas"), align.delta_rows(aligned)))


def correct(reads: DataFrame, ovlp: DataFrame, p: Params, min_len: int = 1200) -> DataFrame:
    return consensus.corrected_reads(ovlp, reads, p.tol, p.min_ec_cov, min_len)


#: Edges this heavy are no bridges.
HEAVY = 1_000_000
#: What layout texts tell of an edge's overlap.
ALIGNED = ("from0", "from1", "dist", "dist_c")


def string_graph(ovlp: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reduced edges, all edges with offsets, unitigs before the last step) of the overlaps.

    Transitive edges, spurs and bridges go, the begins of paths get their overlaps back, and light detours between
    unitigs go.
    """
    used = overlaps.graph_input(ovlp)
    dead = cut_lineage(overlaps.dead_ends(used))
    bad = cut_lineage(overlaps.chimeras(used).union(overlaps.contained_reads(used, dead)).distinct())
    sound = cut_lineage(overlaps.without_reads(used, bad))
    kept = overlaps.best_n_per_side(overlaps.without_reads(sound, dead), p.bestn)
    placed = cut_lineage(layout.placed_edges(sound, *ALIGNED))
    bare = lambda edges: edges.select("v", "w", "weight")
    reduced = graph.remove_weak_spurs(cut_lineage(graph.transitive_reduction(bare(layout.placed_edges(kept)))))
    patched = cut_lineage(graph.patch_ends(graph.without_bridges(reduced, HEAVY), bare(placed)))
    found = cut_lineage(graph.unitigs(patched))
    return cut_lineage(layout.reduce_by_unitigs(patched, found)), placed, found


def simple_graph(ovlp: DataFrame, bestn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, all edges with offsets, unitigs) of the older graph.

    Unitigs are made of each node's clearest link where both reads agree on it.  Between them the heaviest links that are
    so at both unitigs are added, short cycles and double links left out.  Then short ways between branching nodes and
    the lighter ways out of branching nodes go, the begins of paths get their overlaps back, and the same goes again.
    """
    used = overlaps.graph_input(ovlp, older=True)
    dead = cut_lineage(overlaps.dead_ends(used))
    bad = cut_lineage(overlaps.chimeras(used).union(overlaps.contained_reads(used, dead)).distinct())
    sound = cut_lineage(overlaps.without_reads(used, bad))
    placed = cut_lineage(layout.placed_edges(sound, *ALIGNED))
    first = cut_lineage(layout.placed_edges(overlaps.best_n_per_side(sound, bestn), "dist_c"))
    links = cut_lineage(graph.mutual_links(graph.clearest_links(first)).select("v", "w", "weight"))
    found = cut_lineage(graph.unitigs(links))
    edges = links.unionByName(layout.unitig_links(first, found)).distinct()
    edges = search.without_repeat_branches(search.without_repeat_bridges(edges))
    edges = cut_lineage(graph.patch_ends(edges, placed.select("v", "w", "weight")))
    for _ in range(3):
        edges = search.without_repeat_bridges(edges)
    return search.without_repeat_branches(edges), placed, found


def assemble(reads: DataFrame, p: Params, fast: bool = True, min_len: int = 1200, polish: bool = False) -> DataFrame:
    """Contigs (ctg, tag, n_reads, seq) of reads (rid, name, seq); not fast: the reads are corrected first.

    polish: contigs are rewritten by the majority of their reads; bases that few of them cover are lower-case then.
    """
    reads, ovlp = corrected_overlaps(reads, p, fast, min_len)
    reduced, placed, _ = string_graph(ovlp, p)
    return layout.contigs(layout.layouts(reduced), placed, reads, polish, min_len)


def corrected_overlaps(reads: DataFrame, p: Params, fast: bool = True, min_len: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(reads, their overlaps); not fast: those of the corrected reads."""
    ovlp = find_overlaps(reads, p, min_len)
    if not fast:
        reads = cut_lineage(correct(reads, ovlp, p, min_len))
        ovlp = find_overlaps(reads, p, min_len)
    return reads, ovlp


def resolve(contigs: DataFrame, p: Params) -> DataFrame:
    """contigs (rid, name, seq) with kind P or A, and for A the contig that holds most of it."""
    partner = contig_map.associates(contig_map.sketch_containment(sketch.shimmers(contigs, p)))
    joined = contigs.join(partner.select(F.col("rid0").alias("rid"), F.col("rid1").alias("partner")), "rid", "left")
    return joined.withColumn("kind", F.when(F.col("partner").isNull(), "P").otherwise("A"))
