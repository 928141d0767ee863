"""Phrase collocations: phrases of two to four words that stand together more often than their parts suggest, per language.

Texts are cut into pieces at punctuation; equal pieces become one with a multiplicity, in a map-side combined group, so
copies and common lines cost their words once.  Phrases are counted level by level: a phrase can be frequent only if its
first and its last words but one are, so level n takes places whose phrases of n - 1 words the level before found
frequent.  That is looked up in a bitmap of hashes (16 bits a frequent phrase, 64 MB at most, so its size is bounded; it
lets some phrases through and never holds a frequent one back).  Blocks of pieces are counted with Arrow by the phrases
themselves, packed by hash bucket, and each bucket is summed by duckdb, out of core, with its own small memory limit.
Parts of candidates are looked up by shuffled requests: a row for each cut meets the count of its first part, then of the rest.

Counts are of strings, not of hashes, and products are decimals of 38 digits, so the numbers are exact.

Edge cases: a null text counts as empty, a null language as `und`.  Empty and repeated texts, texts without words, and
texts with one piece of any length are whole input; places of a long piece are counted by slices.  Ties are ordered by
phrase.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import BYTE_POWERS, Roll, bound_batches, materialize, mix64, release, text_bytes, word_hashes, word_spans

CUTS, GAPS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Bytes of pieces taken at once, places counted at once, and bytes of pieces for each bucket.
BLOCK, PLACES, BUCKET = 8 << 20, 1 << 19, 8 << 20
#: Bits of the largest bitmap, as a power of two, and of a part of it that is one row.
MOST_BITS, PART = 29, 15
#: Memory that duckdb uses in a task before it writes to its temporary folder, which it empties.
DUCKDB_MEMORY = "256MB"
_gram = Roll(0xA24BAED4963EE407)


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, m): the different pieces of a language, words joined by one space, and how often each stands."""
    lower = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, CUTS)).alias("piece"))
    rows = rows.select("lang", F.trim(F.regexp_replace("piece", GAPS, " ")).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lang_hashes(langs: pa.ChunkedArray) -> np.ndarray:
    coded = langs.combine_chunks().dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(known, np.uint64)[coded.indices.to_numpy()] if known else np.empty(0, np.uint64)


def _freed() -> None:
    """Let go of what idle workers would hold: powers for a whole block, and freed memory."""
    for powers in (BYTE_POWERS, _gram.powers):
        powers.up = powers.down = np.ones(1, np.uint64)
    release()


class Words:
    """The words of a block of texts, each hashed with its language."""

    def __init__(self, table: pa.Table, column: str):
        texts = table.column(column)
        self.bytes, at = text_bytes(texts)
        self.start, self.end, words = word_spans(self.bytes, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(words))
        self.hash = mix64(word_hashes(texts)[0] ^ _lang_hashes(table.column("lang"))[self.doc])

    def places(self, n: int) -> np.ndarray:
        """First words of all runs of n words within a text."""
        return np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1]) if len(self.doc) >= n else np.empty(0, np.int64)

    def keys(self, n: int) -> np.ndarray:
        return _gram(self.hash, n)

    def phrases(self, places: np.ndarray, n: int) -> pa.Array:
        """The bytes from the first to the last word of each run."""
        first = self.start[places]
        ends = np.cumsum(self.end[places + n - 1] - first)
        offsets = np.concatenate([[0], ends])
        data = self.bytes[np.repeat(first - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(data))


def _bit(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the keys' bits are set; a part's bits lie in it from the lowest of its first byte."""
    at = keys >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def frequent_bitmap(frequent: DataFrame, n: int) -> tuple[Broadcast, int]:
    """(bitmap of the hashes of the frequent phrases of n words, its size as a power of two)."""
    bits = min(MOST_BITS, max(PART + 1, int(16 * frequent.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words = Words(block, "phrase")
            at = (words.keys(n)[words.places(n)] >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> PART), pa.array(at & ((1 << PART) - 1))], names=["part", "at"])

    parts = frequent.select("lang", "phrase").mapInArrow(places, "part long, at long").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] << (PART - 3) :][: 1 << (PART - 3)] = np.frombuffer(row["bits"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out), bits


def _packed(counts: pa.Table, buckets: int) -> pa.RecordBatch:
    """One row per bucket, with its phrases and counts as an Arrow stream."""
    bucket = (counts.column("hash_min").to_numpy() % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, counts = bucket[order], counts.select(["lang", "phrase", "weight_sum"]).take(pa.array(order)).combine_chunks()
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    data = []
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, counts.schema) as stream:
            stream.write_table(counts.slice(a, b - a))
        data.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _summed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.large_string()), ("weight_sum", pa.int64())])

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data"):
                    yield from pa.ipc.open_stream(data.as_buffer()).read_all().cast(schema).to_batches()

        with tempfile.TemporaryDirectory(prefix="collocations-") as folder, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder}) as db:
            db.register("parts", pa.RecordBatchReader.from_batches(schema, parts()))
            yield from db.sql(f"SELECT lang, phrase, sum(weight_sum)::BIGINT AS f FROM parts GROUP BY lang, phrase HAVING sum(weight_sum) >= {int(least)}").to_arrow_reader(100_000)
        release()

    return run


def frequent_phrases(rows: DataFrame, n: int, least: int, buckets: int, shorter: tuple[Broadcast, int] | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of n words that stand `least` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words = Words(block, "piece")
            places = words.places(n)
            if shorter is not None and len(places):
                often = _bit(shorter[0].value, words.keys(n - 1), shorter[1])
                places = places[often[places] & often[places + 1]]
            keys, times, lang = words.keys(n), block.column("m").to_numpy(), block.column("lang").combine_chunks()
            for a in range(0, len(places), PLACES):
                at = places[a : a + PLACES]
                doc = words.doc[at]
                found = pa.table({"lang": lang.take(pa.array(doc)), "phrase": words.phrases(at, n), "weight": pa.array(times[doc]), "hash": pa.array(keys[at])})
                yield _packed(found.group_by(["lang", "phrase"]).aggregate([("weight", "sum"), ("hash", "min")]), buckets)
        _freed()

    parts = rows.select("lang", "piece", "m").mapInArrow(count, "bucket int, data binary")
    return materialize(parts.repartition(buckets, "bucket").mapInArrow(_summed(least), "lang string, phrase string, f long"), f"phrases{n}")


def _decimal(c: str):
    return F.col(c).cast("decimal(19,0)")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer phrase stands for."""
    bound_batches(docs.sparkSession)
    whole = materialize(pieces(docs, text, lang), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = materialize(whole.groupBy("lang").agg(F.sum(words * F.col("m")).alias("n"), F.sum(F.octet_length("piece")).alias("bytes")), "totals")
    buckets = max(8, int(totals.agg(F.sum("bytes")).first()[0] or 0) // BUCKET)
    levels: list[DataFrame] = []
    for n in range(1, longest + 1):
        levels.append(frequent_phrases(whole, n, least, buckets, frequent_bitmap(levels[-1], n - 1) if levels else None))
    counts = levels[0].select("lang", "phrase", "f", F.lit(1).alias("words"))
    for n, level in enumerate(levels[1:], 2):
        counts = counts.unionByName(level.select("lang", "phrase", "f", F.lit(n).alias("words")))
    found = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    asked = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = counts.where(F.col("words") < longest)
    answered = asked.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    answered = answered.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    answered = answered.withColumn("l_", _decimal("l")).withColumn("r_", _decimal("r")).withColumn("a_", _decimal("a")).withColumn("score", F.expr("(a_ * cast(2000000 as decimal(7,0))) div (l_ + r_)"))
    scored = answered.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    inner = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (_decimal("f") * 100 < _decimal("a") * 80))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals.select("lang", "n"), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
