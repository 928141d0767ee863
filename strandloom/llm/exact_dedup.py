"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when their SHA-256 digests are, after each run of white space became one space.  A mergeable
Misra-Gries summary (Spark's approx_top_k keeps a frequent-items sketch of a fixed number of counters) names the digests
that may be frequent; their exact counts and smallest ids are aggregated, and these verified winners, at most half of
`counters` rows, are broadcast, so rows of large groups are settled where they are read.  The summary's error is under
3.5 / counters of the rows, so every other group is smaller than that share (a thousandth by default) and goes through
an ordinary shuffle by digest.

Edge cases: a null text counts as empty, so null and empty texts are one group.  Of rows with the same smallest id one
stays, the others name the same keep_id and are dropped.  A null id sorts after every other id.  An empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SPACE, free_names, materialize
from strandloom.llm.places import choose, placed


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def frequent_digests(rows: DataFrame, counters: int) -> list[str]:
    """At most counters / 2 digests, with all that have a larger share of the rows than the summary's error."""
    summary = rows.agg(F.expr(f"approx_top_k(text_sha256, {counters // 2}, {counters})").alias("top")).first()["top"]
    return [x["item"] for x in summary or [] if x["count"] > 1]


def _grouped(docs: DataFrame, id_col: str, text: str, counters: int) -> DataFrame:
    """doc_id, text_sha256, file, row, first (the order of the row that stays), group_size."""
    file, row = free_names(docs, "file", "row")
    whole = placed(docs, file, row)
    rows = whole.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("text_sha256"), F.col(file).alias("file"), F.col(row).alias("row"))
    rows = materialize(rows, "digests")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")
    frequent = rows.sparkSession.createDataFrame([(x,) for x in frequent_digests(rows, counters)], "text_sha256 string")
    of_groups = (F.min(order).alias("first"), F.count("*").alias("group_size"))
    winners = materialize(rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(*of_groups), "winners")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    return hot.unionByName(rest.join(rest.groupBy("text_sha256").agg(*of_groups), "text_sha256"))


def _stays():
    return (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counters: int = 4096) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    both = _grouped(docs, id_col, text, counters)
    return both.select(F.col("doc_id").alias(id_col), F.col("first.doc_id").alias("keep_id"), "group_size", _stays().alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counters: int = 4096) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the smallest id (of rows that share it, the first).

    Digests alone are shuffled; the texts of copies, of large groups and small, are left out where they are read.
    """
    file, row = free_names(docs, "file", "row")
    whole = placed(docs, file, row)
    copies = _grouped(whole, id_col, text, counters).where(~_stays()).select(F.col("file").alias(file), F.col("row").alias(row))
    return choose(whole, file, row, copies, drop=True).select(*(F.col(f"`{c}`") for c in docs.columns))
