"""Algebra of overlaps: orientation, classes, best ones, markers, and read filters.

An overlap has rid0, rid1, strand1, len0, len1, d_left, d_right, bgn0, end0, bgn1, end1, dist, idt, dist_c, max_dist_c,
idt_c and flag.  d_left is where read 1 starts in coordinates of read 0, d_right by how much it reaches beyond its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["rid0", "rid1", "strand1", "len0", "len1", "d_left", "d_right", "bgn0", "end0", "bgn1", "end1", "dist", "idt", "dist_c", "max_dist_c", "idt_c", "flag"]
COMPATIBLE, REVERSED = 0x02, 0x80
#: Half the free space kept around an overlap's ends when markers are counted.
MARGIN = 5


def from_clusters(clusters: DataFrame, reads: DataFrame) -> DataFrame:
    """Unaligned overlaps of clusters: d_left and d_right from the first diagonal and the lengths."""
    lens = reads.select("rid", F.length("seq").alias("len"))
    a, b = lens.toDF("rid0", "len0"), lens.toDF("rid1", "len1")
    left = F.when(F.col("strand") == 1, F.col("bgn") - F.col("len1")).otherwise(F.col("bgn"))
    joined = clusters.join(a, "rid0").join(b, "rid1").withColumn("d_left", left)
    return joined.select("rid0", "rid1", F.col("strand").alias("strand1"), "len0", "len1", "d_left", (F.col("d_left") + F.col("len1") - F.col("len0")).alias("d_right"), "count")


def overlap_class(left: Column, right: Column) -> Column:
    """right or left dovetail, containment of read 1 or of read 0, or tie where an end coincides."""
    return (
        F.when((left > 0) & (right > 0), "right").when((left < 0) & (right < 0), "left").when((left > 0) & (right < 0), "contains1").when((left < 0) & (right > 0), "contained0").otherwise("tie")
    )


def swap(ovlp: DataFrame) -> DataFrame:
    """Each overlap as seen from its other read."""
    turned = F.col("strand1") == 1
    pick = lambda same, turn: F.when(turned, turn).otherwise(same)
    mirror = lambda length, at: F.col(length) - F.col(at)
    rest = [c for c in ovlp.columns if c not in COLUMNS[:11]]
    return ovlp.select(
        F.col("rid1").alias("rid0"), F.col("rid0").alias("rid1"), "strand1", F.col("len1").alias("len0"), F.col("len0").alias("len1"),
        pick(-F.col("d_left"), F.col("d_right")).alias("d_left"), pick(-F.col("d_right"), F.col("d_left")).alias("d_right"),
        pick(F.col("bgn1"), mirror("len1", "end1")).alias("bgn0"), pick(F.col("end1"), mirror("len1", "bgn1")).alias("end0"),
        pick(F.col("bgn0"), mirror("len0", "end0")).alias("bgn1"), pick(F.col("end0"), mirror("len0", "bgn0")).alias("end1"), *rest,
    )


def reverse_strand(ovlp: DataFrame) -> DataFrame:
    """Each overlap with both reads turned round; the flag says so."""
    mirror = lambda length, at: (F.col(length) - F.col(at)).alias
    rest = [c for c in ovlp.columns if c not in (*COLUMNS[:11], "flag")]
    return ovlp.select(
        "rid0", "rid1", (1 - F.col("strand1")).alias("strand1"), "len0", "len1", (-F.col("d_right")).alias("d_left"), (-F.col("d_left")).alias("d_right"),
        mirror("len0", "end0")("bgn0"), mirror("len0", "bgn0")("end0"), mirror("len1", "end1")("bgn1"), mirror("len1", "bgn1")("end1"), *rest, F.col("flag").bitwiseOR(F.lit(REVERSED)).alias("flag"),
    )


def overlap_line() -> Column:
    """An overlap as text, in the fixed column order, identities with two decimals."""
    return F.format_string("O " + " ".join("%.2f" if c.startswith("idt") else "%d" for c in COLUMNS), *COLUMNS)


def format_overlap(ovlp: DataFrame) -> DataFrame:
    return ovlp.select(overlap_line().alias("value"))


def parse_overlaps(lines: DataFrame) -> DataFrame:
    """Overlaps from text lines that start with O; other lines are skipped."""
    parts = F.split("value", r"\s+")
    kinds = ["double" if c.startswith("idt") else "int" for c in COLUMNS]
    return lines.where(F.col("value").startswith("O ")).select(*[F.get(parts, F.lit(i + 1)).cast(k).alias(c) for i, (c, k) in enumerate(zip(COLUMNS, kinds, strict=True))])


def graph_input(ovlp: DataFrame, older: bool = False) -> DataFrame:
    """Overlaps that the graph uses; the older graph asks for few differences at markers only."""
    return ovlp.where("dist_c <= 2" if older else "not (dist >= 12 and max_dist_c = 0) and dist_c <= 2")


def best_per_pair(ovlp: DataFrame) -> DataFrame:
    """Of the overlaps of two reads the one with the best identity."""
    order = Window.partitionBy("rid0", "rid1").orderBy(F.desc("idt"), "strand1", "bgn0", "end0")
    return ovlp.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def coverage_sweep(events: DataFrame, keys: list[str], at: str = "at", kind: str = "kind") -> DataFrame:
    """events with depth: opened minus closed intervals so far; at one place opens (0) count first, closes (3) last."""
    order = Window.partitionBy(*keys).orderBy(at, kind).rangeBetween(Window.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum(F.when(F.col(kind) == 0, 1).when(F.col(kind) == 3, -1).otherwise(0)).over(order))


def markers(ovlp: DataFrame, deltas: DataFrame) -> DataFrame:
    """(rid0, x, kind, n, depth) of the differences that tell haplotypes apart.

    deltas: rid0, rid1, strand1, d_left, x, kind (1 or 2).  A difference seen in n of depth overlaps is a marker if more
    than four have it and more than four don't.
    """
    seen = deltas.select("rid0", "rid1", "strand1", "d_left", "x", "kind").distinct().groupBy("rid0", "x", "kind").agg(F.count("*").alias("n"))
    opens = ovlp.select("rid0", F.greatest(F.col("bgn0") - MARGIN, F.lit(0)).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    closes = ovlp.select("rid0", (F.col("end0") + MARGIN).alias("at"), F.lit(3).alias("kind"), F.lit(0).cast("long").alias("n"))
    events = opens.unionByName(closes).unionByName(seen.withColumnRenamed("x", "at"))
    swept = coverage_sweep(events, ["rid0"]).where("kind in (1, 2)")
    return swept.where("n > 4 and depth - n > 4 and n <= depth").select("rid0", F.col("at").alias("x"), "kind", "n", "depth")


def with_markers(ovlp: DataFrame, deltas: DataFrame) -> DataFrame:
    """The best overlap of each pair with dist_c, max_dist_c, idt_c and the flag of compatible pairs.

    Overlaps and differences are shuffled together and once, by read; what follows are windows and sums along each read.
    """
    kept = [c for c in COLUMNS if c not in ("dist_c", "max_dist_c", "idt_c", "flag")]
    rows = ovlp.select(*kept).unionByName(deltas.select("rid0", "rid1", "strand1", "d_left", "x", "kind"), allowMissingColumns=True).repartition("rid0")
    # a pair's best overlap, which comes before its differences, and the different ones of that overlap
    other, pair = F.col("kind").isNotNull(), Window.partitionBy("rid0", "rid1")
    order = pair.orderBy(other, F.desc("idt"), "strand1", "bgn0", "end0")
    ranked = rows.withColumn("rank_", F.row_number().over(order)).withColumn("best", F.first(F.struct(other.alias("other"), "strand1", "d_left")).over(order))
    same = ~F.col("best.other") & (F.col("best.strand1") == F.col("strand1")) & (F.col("best.d_left") == F.col("d_left"))
    own = ranked.where(F.when(other, same).otherwise(F.col("rank_") == 1)).drop("best")
    own = own.withColumn("rank_", F.row_number().over(Window.partitionBy("rid0", "rid1", "x", "kind").orderBy("rank_"))).where("rank_ = 1").drop("rank_")
    # places along the read: 0 and 3 open and close an overlap, 1 and 2 are differences, 4 and 5 its begin and end
    step = lambda at, kind: F.struct(at.cast("int").alias("at"), kind.cast("int").alias("step"))
    begin, end = F.col("bgn0"), F.col("end0")
    ends = F.array(step(F.greatest(begin - MARGIN, F.lit(0)), F.lit(0)), step(end + MARGIN, F.lit(3)), step(begin, F.lit(4)), step(end, F.lit(5)))
    placed = own.select("*", F.inline(F.when(other, F.array(step(F.col("x"), F.col("kind")))).otherwise(ends))).drop("x", "kind")
    swept, place = coverage_sweep(placed, ["rid0"], "at", "step"), Window.partitionBy("rid0", "at", "step")
    counted = swept.withColumn("n", F.count("*").over(place)).withColumn("nth", F.row_number().over(place.orderBy("rid1")))
    found = counted.withColumn("marker", (F.expr("step in (1, 2) and n > 4 and depth - n > 4 and n <= depth")).cast("int"))
    upto = F.sum(F.when(F.col("nth") == 1, F.col("marker")).otherwise(0)).over(Window.partitionBy("rid0").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    at = lambda kind: F.max(F.when(F.col("step") == kind, F.col("upto")))
    both = found.withColumn("upto", upto).groupBy("rid0", "rid1").agg(
        *[F.max(c).alias(c) for c in kept[2:]], F.sum("marker").alias("dist_c"), F.greatest(at(5) - at(4), F.lit(0)).alias("max_dist_c")
    )
    fits = ((F.col("max_dist_c") > 2) & (F.col("dist_c") <= 1)) | ((F.col("max_dist_c") <= 2) & (F.col("dist_c") == 0))
    both = both.withColumn("idt_c", F.when(F.col("end0") > F.col("bgn0"), 100 - 100 * F.col("dist_c") / (F.col("end0") - F.col("bgn0"))))
    return both.withColumn("flag", F.when(fits, COMPATIBLE).otherwise(0)).select(*COLUMNS)


def dead_ends(ovlp: DataFrame) -> DataFrame:
    """Reads that can't be extended on both sides; in the second round, ones whose only neighbours are dead ends too."""
    sides = lambda rows: rows.groupBy("rid0").agg(F.max(F.when(F.col("d_right") > 0, 1).otherwise(0)).alias("r"), F.max(F.when(F.col("d_left") < 0, 1).otherwise(0)).alias("l"))
    every = ovlp.select("rid0").distinct()
    dead = lambda rows: every.join(sides(rows).where("r = 1 and l = 1"), "rid0", "left_anti")
    first = dead(ovlp)
    second = dead(ovlp.join(first.select(F.col("rid0").alias("rid1")), "rid1", "left_anti"))
    return second.select(F.col("rid0").alias("rid"))


def chimeras(ovlp: DataFrame) -> DataFrame:
    """Reads whose left and right overlaps don't meet; reads without overlaps on a side are among them."""
    used = F.col("dist_c") <= 2
    reach = ovlp.groupBy("rid0", "len0").agg(F.min(F.when(used & (F.col("d_right") > 0), F.col("d_left"))).alias("l"), F.max(F.when(used & (F.col("d_left") < 0), F.col("d_right"))).alias("r"))
    high, low = F.lit(2**31 - 1), F.lit(-(2**31))
    return reach.where(F.col("len0").cast("long") + F.coalesce("r", low) < F.coalesce("l", high)).select(F.col("rid0").alias("rid"))


def contained_reads(ovlp: DataFrame, dead: DataFrame) -> DataFrame:
    """Reads that lie within another, where neither is a dead end."""
    live = ovlp.join(dead.select(F.col("rid").alias("rid0")), "rid0", "left_anti").join(dead.select(F.col("rid").alias("rid1")), "rid1", "left_anti")
    one = live.where("d_left > 0 and d_right < 0").select(F.col("rid1").alias("rid"))
    return one.union(live.where("d_left < 0 and d_right > 0").select(F.col("rid0").alias("rid"))).distinct()


def without_reads(ovlp: DataFrame, rids: DataFrame) -> DataFrame:
    """Overlaps of which neither read is listed."""
    for c in ("rid0", "rid1"):
        ovlp = ovlp.join(rids.select(F.col("rid").alias(c)), c, "left_anti")
    return ovlp


def best_n_per_side(ovlp: DataFrame, n: int = 6) -> DataFrame:
    """Dovetail overlaps for the graph: of each read and side, the n longest, and of these the best tier.

    Tiers: no difference; no difference at markers; fewer than five there.
    """
    side = overlap_class(F.col("d_left"), F.col("d_right"))
    sided = ovlp.withColumn("side", side).where("side in ('left', 'right')")
    order = Window.partitionBy("rid0", "side").orderBy(F.desc(F.col("end0") - F.col("bgn0")), "rid1", "strand1", "bgn0")
    top = sided.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    tier = F.when(F.col("dist") == 0, 0).when(F.col("dist_c") == 0, 1).when(F.col("dist_c") < 5, 2)
    tiered = top.withColumn("tier", tier).where("tier is not null")
    return tiered.withColumn("least", F.min("tier").over(Window.partitionBy("rid0", "side"))).where("tier = least").drop("least")
