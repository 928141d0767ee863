"""Commands of the sequence pipeline over Parquet stage tables: python -m strandloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import align, candidates, catalog, consensus, contig_map, graph, layout, overlaps, sketch
from strandloom.params import Params
from strandloom.plans import assemble
from strandloom.plans.lineage import clear_tables
from strandloom.sources import fastx


#: What a path may begin with in a listing or in Spark's names.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*:)?/*"


def _params(a: argparse.Namespace) -> Params:
    known = {k: getattr(a, k) for k in ("w", "k", "r", "tol", "min_ec_cov", "bestn") if hasattr(a, k)}
    return Params(**known)


def _load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def reads_of(spark: SparkSession, listing: str, least_file: int = fastx.LEAST_FILE) -> DataFrame:
    """Reads (rid, name, seq) of the listed files, long enough, with dense ids in file and record order."""
    paths = fastx.file_list(spark, listing)
    raw = fastx.read_fastx(spark, paths, least_file)
    bare = lambda p: re.sub(SCHEME, "", p)
    place = F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (bare(p), i)])
    kept = assemble.cut_lineage(catalog.long_reads(raw.withColumn("file_no", F.element_at(place, F.regexp_replace("file", SCHEME, "")))))
    # places without large holes: a file's records follow those of the files before it
    sizes = kept.groupBy("file_no").agg(F.max("ord").alias("last"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file_no", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("offset"))
    ordered = kept.join(F.broadcast(offsets), "file_no").withColumn("ord", F.col("ord") + F.col("offset"))
    return catalog.dense_ids(ordered, "ord").select("rid", "name", "seq")


def build_sdb(spark, a):
    reads_of(spark, a.input, a.least_file).write.parquet(a.out)


def build_idx(spark, a):
    fastx.write_shimmers(sketch.shimmers(_load(spark, a.reads), _params(a)), a.out, a.nchunks)


def ovlp(spark, a):
    """Overlaps as Parquet, and as text in blocks by read beside them (.ovlp)."""
    reads, p = _load(spark, a.reads), _params(a)
    pairs = assemble.cut_lineage(sketch.shimmer_pairs(_load(spark, a.shimmers)))
    clusters = assemble.cut_lineage(candidates.pair_clusters(pairs, p))
    aligned = assemble.cut_lineage(align.align_clusters(candidates.top_clusters(clusters, p), reads, p))
    overlaps.with_markers(aligned.drop("deltas"), align.delta_rows(aligned)).write.parquet(a.out)
    fastx.overlap_blocks(_load(spark, a.out), assemble.cut_lineage(candidates.read_stats(pairs, clusters, p))).write.text(f"{a.out}.ovlp")


def ovlp_ec(spark, a):
    """Corrected reads as Parquet, and as FASTA beside them (.fa)."""
    consensus.corrected_reads(_load(spark, a.overlaps), _load(spark, a.reads), a.tol, a.min_ec_cov).write.parquet(a.out)
    fastx.write_fasta(_load(spark, a.out), f"{a.out}.fa", F.concat_ws(" ", "name", F.col("rid").cast("string")))


def dp_graph(spark, a):
    write_graph(_load(spark, a.overlaps), _params(a), a.out)


def write_graph(ovlp: DataFrame, p: Params, out: str) -> tuple[DataFrame, DataFrame]:
    """Write the graph's tables and texts; (layout, edges) as stored."""
    reduced, placed, before = assemble.string_graph(ovlp, p)
    found = assemble.cut_lineage(graph.unitigs(reduced))
    for name, rows in (("edges", placed), ("reduced", reduced), ("unitigs", found), ("layout", layout.layouts(reduced))):
        rows.write.parquet(f"{out}/{name}")
    laid, edges = (placed.sparkSession.read.parquet(f"{out}/{name}") for name in ("layout", "edges"))
    lens = ovlp.select(F.col("rid0").alias("rid"), F.col("len0").alias("len")).union(ovlp.select("rid1", "len1")).distinct()
    fastx.edge_lines(reduced).write.text(f"{out}/g.dat")
    fastx.unitig_lines(before, before.join(found.select("begin", "second").distinct(), ["begin", "second"], "left_semi")).write.text(f"{out}/utg0.dat")
    fastx.unitig_lines(found, found).write.text(f"{out}/utg.dat")
    fastx.gfa_lines(before, lens, placed, found).write.text(f"{out}/utg.gfa")
    fastx.layout_lines(laid, edges).write.text(f"{out}/layout.dat")
    return laid, edges


def simple_graph(spark, a):
    write_simple_graph(_load(spark, a.overlaps), a.out, _params(a).bestn)


def write_simple_graph(ovlp: DataFrame, out: str, bestn: int) -> None:
    """The older graph, its unitigs before the steps against repeats, and its layout."""
    edges, placed, found = assemble.simple_graph(ovlp, bestn)
    for name, rows in (("edges", placed), ("reduced", edges), ("unitigs", found), ("layout", layout.layouts(edges))):
        rows.write.parquet(f"{out}/{name}")
    fastx.edge_lines(edges).write.text(f"{out}/g.dat")


def make_contigs(spark, a):
    write_contigs(layout.contigs(_load(spark, f"{a.graph}/layout"), _load(spark, f"{a.graph}/edges"), _load(spark, a.reads), not a.raw), a.out)


def write_contigs(contigs: DataFrame, out: str) -> DataFrame:
    """Write contigs as Parquet and as FASTA, primary ones (_m.fa) and others (_e0.fa); they are returned as stored."""
    contigs.write.parquet(out)
    stored = contigs.sparkSession.read.parquet(out)
    fastx.write_fasta(stored.where("tag = 'P'"), f"{out}_m.fa", F.col("ctg"))
    fastx.write_fasta(stored.where("tag <> 'P'"), f"{out}_e0.fa", F.col("ctg"))
    return stored


def dedup(spark, a):
    write_unique(_load(spark, a.reference), _load(spark, a.target), Params(w=a.w, k=a.k, r=a.r), a.out)


def write_unique(reference: DataFrame, target: DataFrame, p: Params, out: str) -> DataFrame:
    """Write the targets that no reference contig holds, as Parquet and as FASTA (.fa); they are returned as stored."""
    contig_map.drop_duplicates(reference, target, p).write.parquet(out)
    stored = reference.sparkSession.read.parquet(out)
    fastx.write_fasta(stored, f"{out}.fa", F.col("name"))
    return stored


def resolve(spark, a):
    write_resolved(_load(spark, a.contigs), _params(a), a.out)


def write_resolved(contigs: DataFrame, p: Params, out: str) -> None:
    """Write contigs with their kinds, as Parquet and as FASTA (_p.fa, _a.fa), and the relations as text (.rel)."""
    assemble.resolve(contigs, p).write.parquet(out)
    stored = contigs.sparkSession.read.parquet(out)
    for kind in ("P", "A"):
        fastx.write_fasta(stored.where(F.col("kind") == kind), f"{out}_{kind.lower()}.fa", F.col("name"))
    names = contigs.select(F.col("rid").alias("partner"), F.col("name").alias("other"))
    kinds = stored.join(names, "partner", "left").select(F.concat_ws(" ", "kind", "name", F.coalesce("other", "name")).alias("value"))
    fastx.relation_lines(contig_map.sketch_containment(sketch.shimmers(contigs, p))).union(kinds).write.text(f"{out}.rel")


def getreads(spark, a):
    ids = spark.read.text(a.ids).select(F.col("value").cast("long").alias("rid"), F.monotonically_increasing_id().alias("ord"))
    fastx.fasta_lines(catalog.read_lookup(_load(spark, a.reads), ids), fastx.read_header()).write.text(a.out)


def asm(spark, a):
    p = _params(a)
    reads, found = assemble.corrected_overlaps(assemble.cut_lineage(reads_of(spark, a.input, a.least_file)), p, a.fast)
    if a.layout == 1:
        write_simple_graph(found, f"{a.out}/graph", p.bestn)
        laid, edges = _load(spark, f"{a.out}/graph/layout"), _load(spark, f"{a.out}/graph/edges")
    else:
        laid, edges = write_graph(found, p, f"{a.out}/graph")
    contigs = write_contigs(layout.contigs(laid, edges, reads, not a.raw), f"{a.out}/contigs")
    named = assemble.cut_lineage(catalog.dense_ids(contigs.withColumn("ord", F.substring("ctg", 4, 6).cast("long")), "ord").select("rid", F.col("ctg").alias("name"), "seq", "tag"))
    # duplicates among the other contigs go by the primary ones, then what is left is related
    main, rest = (named.where(f"tag {sign} 'P'").drop("tag") for sign in ("=", "<>"))
    unique = write_unique(main, rest, Params(w=min(48, p.w), k=p.k, r=min(4, p.r)), f"{a.out}/unique")
    if not a.no_resolve:
        write_resolved(main.unionByName(unique), p, f"{a.out}/resolved")
    catalog.assembly_summary(contigs.select(F.length("seq").alias("len"))).write.parquet(f"{a.out}/summary")
    if not a.keep:
        fastx.delete(spark, f"{a.out}/graph")
        clear_tables()


COMMANDS = {
    "asm": (asm, ["input"]), "build-sdb": (build_sdb, ["input"]), "build-idx": (build_idx, ["reads"]), "ovlp": (ovlp, ["reads", "shimmers"]), "ovlp-ec": (ovlp_ec, ["reads", "overlaps"]), "dp-graph": (dp_graph, ["overlaps"]),
    "graph": (simple_graph, ["overlaps"]), "layout": (make_contigs, ["graph", "reads"]), "dedup": (dedup, ["reference", "target"]), "resolve": (resolve, ["contigs"]), "getreads": (getreads, ["reads", "ids"]),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, inputs) in COMMANDS.items():
        c = commands.add_parser(name)
        for x in (*inputs, "out"):
            c.add_argument(x)
        small = name == "dedup"
        c.add_argument("-w", type=int, default=48 if small else 80)
        c.add_argument("-k", type=int, default=56)
        c.add_argument("-r", type=int, default=4 if small else 6)
        c.add_argument("--tol", type=float, default=0.01)
        c.add_argument("--bestn", type=int, default=6)
        c.add_argument("--min_ec_cov", type=int, default=1)
        c.add_argument("--nchunks", type=int, default=8)
        c.add_argument("--least_file", type=int, default=fastx.LEAST_FILE)
        c.add_argument("--fast", action="store_true")
        c.add_argument("--no_resolve", action="store_true")
        c.add_argument("--raw", action="store_true", help="leave the contigs as the reads spell them")
        c.add_argument("-l", "--layout", type=int, choices=(1, 2), default=2, help="the older graph (1) or the string graph (2)")
        c.add_argument("--keep", action="store_true", help="keep the graph's tables")
    a = parser.parse_args(args)
    COMMANDS[a.command][0](spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
