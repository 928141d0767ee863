"""Read catalogue: length filter, dense ids, offsets, lookups and assembly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import text_to_sequence
from strandloom.plans.lineage import cut_lineage

#: Rows of a piece that is numbered in one task, about.
PIECE = 1 << 18


def long_reads(reads: DataFrame, min_len: int = 500, seq: str = "seq") -> DataFrame:
    return reads.where(F.length(seq) >= min_len)


def _pieces(rows: DataFrame, order: str, most: int) -> DataFrame:
    """rows, stored, with piece_: consecutive ranges of a numeric column of about as many rows each, at most `most` or so.

    The ranges come from a sample of the rows, so a column with gaps and crowds is cut evenly too; the numbers made from
    them rest on exact counts.
    """
    pieces = max(1, -(-rows.count() // most))
    return cut_lineage(rows.repartitionByRange(pieces, order).withColumn("piece_", F.spark_partition_id()))


def dense_ids(rows: DataFrame, order: str, name: str = "rid", most: int = PIECE) -> DataFrame:
    """rows with a dense id from 0 in the order of a numeric column with distinct values.

    Rows are numbered within a piece of the column and offset by the counts of the pieces before, so no task sees all
    rows.
    """
    cut = _pieces(rows, order, most)
    counts = cut.groupBy("piece_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("piece_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    place = F.row_number().over(Window.partitionBy("piece_").orderBy(order)) - 1
    numbered = cut.withColumn(name, place).join(F.broadcast(offsets), "piece_")
    return numbered.withColumn(name, (F.col(name) + F.col("offset_")).cast("long")).drop("piece_", "offset_")


def running_start(reads: DataFrame, length: str = "len", order: str = "rid", most: int = PIECE) -> DataFrame:
    """reads with start, the sum of the lengths of all reads before; a prefix sum in two levels by pieces of the order."""
    cut = _pieces(reads, order, most)
    sums = cut.groupBy("piece_").agg(F.sum(length).alias("sum_"))
    before = Window.orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("piece_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy("piece_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("start", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(F.broadcast(offsets), "piece_")
    return out.withColumn("start", (F.col("start") + F.col("offset_")).cast("long")).drop("piece_", "offset_")


def read_catalog(reads: DataFrame, min_len: int = 500) -> DataFrame:
    """(rid, name, len, start) of the reads (name, seq, in order of the column ord) that are long enough."""
    kept = cut_lineage(long_reads(reads, min_len).select("ord", "name", F.length("seq").alias("len")))
    return running_start(dense_ids(kept, "ord")).select("rid", "name", "len", "start")


def document_reads(docs: DataFrame, min_len: int = 500) -> DataFrame:
    """Documents as reads (rid, name, seq): the id and the letters mapped to bases."""
    reads = docs.select(F.col("doc_id").alias("rid"), F.concat(F.lit("doc"), "doc_id").alias("name"), text_to_sequence(F.col("text")).alias("seq"))
    return long_reads(reads, min_len) if min_len else reads


def read_lookup(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads of the listed ids (columns rid and ord), in list order."""
    return ids.join(reads, "rid").orderBy("ord")


def chunk_of(rid: Column, chunks: int) -> Column:
    """The chunk of a read, by its id modulo the number of chunks."""
    return F.pmod(rid, F.lit(chunks)).cast("int")


def assembly_summary(lengths: DataFrame, column: str = "len", group: list[str] = ()) -> DataFrame:
    """total, longest, n50, n90, n and n_long (over 100,000) of each group's lengths.

    Equal lengths are counted first, so the running sum is over distinct lengths.
    """
    counted = lengths.groupBy(*group, F.col(column).alias("l")).agg(F.count("*").alias("c"))
    down = Window.partitionBy(*group).orderBy(F.desc("l"))
    every = Window.partitionBy(*group)
    summed = counted.select(*group, "l", "c", F.sum(F.col("l") * F.col("c")).over(down).alias("run"), F.sum(F.col("l") * F.col("c")).over(every).alias("total"))
    point = lambda share: F.max(F.when(F.col("run") * 100 > F.col("total") * share, F.col("l"))).alias(f"n{share}")
    return summed.groupBy(*group).agg(
        F.max("total").cast("long").alias("total"), F.max("l").alias("longest"), point(50), point(90), F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("l") > 100_000, F.col("c"))), F.lit(0)).alias("n_long")
    )
