"""Rows by their place (the file and the number in it), and the choice of rows by bitmaps of places.

Steps that decide on whole texts carry places instead of texts, and a decision reaches the texts where they are read: the
chosen places become bitmaps of 32,768 rows, one for each part of a file, which are broadcast and looked up while the
files are scanned.  No text is shuffled to drop or to fetch rows.  Bitmaps of more than MOST_BROADCAST bytes are taken
in shares of whole files, one after another, each with a scan of its own files alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import free_names, materialize

#: Bitmaps up to so many bytes are broadcast at once; one has BITMAP bytes, with its keys and overhead.
MOST_BROADCAST, BITMAP = 32 << 20, 4096 + 64


def _is_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of one scan of files, at most chosen and projected."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with the place of each row in two more columns; rows that aren't a plain scan of Parquet are stored first."""

    def with_places(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))

    if _is_scan(docs):
        try:
            return with_places(docs)
        except AnalysisException:  # a format without row numbers
            pass
    return with_places(materialize(docs, "placed"))


def choose(docs: DataFrame, file: str, row: str, places: DataFrame, drop: bool = False, tag: str = "chosen") -> DataFrame:
    """The rows of docs, which has places in two columns, that are among places (the same two columns), or aren't if drop."""
    file_, part_, bits = free_names(docs, "file_", "part_", "bits")
    number = F.floor(F.col(row) / 32768).cast("long")
    maps = places.select(F.col(file).alias(file_), number.alias(part_), F.pmod(F.col(row), F.lit(32768)).alias("at"))
    maps = materialize(maps.groupBy(file_, part_).agg(F.bitmap_construct_agg("at").alias(bits)), "bitmaps")
    shares = max(1, -(-maps.count() * BITMAP // MOST_BROADCAST))

    def chosen(rows: DataFrame, some: DataFrame) -> DataFrame:
        met = rows.join(F.broadcast(some), (F.col(file) == F.col(file_)) & (number == F.col(part_)), "left" if drop else "inner")
        at = F.pmod(F.col(row), F.lit(32768)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
        return met.where(~F.coalesce(hit, F.lit(False)) if drop else hit).select(*(F.col(f"`{c}`") for c in rows.columns))

    if shares == 1:
        return chosen(docs, maps)
    out = None
    for k in range(shares):
        share = materialize(chosen(docs.where(F.pmod(F.col(file), F.lit(shares)) == k), maps.where(F.pmod(F.col(file_), F.lit(shares)) == k)), tag)
        out = share if out is None else out.unionByName(share)
    return out
