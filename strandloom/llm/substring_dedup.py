"""Substring deduplication: words in runs of 50 that also stand in a document with a smaller id are removed.

First pass: each window of 50 words is represented by its smallest hashed run of 16 words (its anchor), so a window is
no more frequent than its anchor, and consecutive windows share one; partitions count anchors in count-min sketches,
which are merged and broadcast.  Second pass: only windows whose anchor is estimated to be in two documents are grouped
exactly, by 128 bits of hash: first within a block of documents, where all but the smallest document are settled at
once, so a window reaches the shuffle at most once a block however often it repeats; then by hash bucket.  Covered
ranges are gathered by document and merged, and applied to the texts.

Edge cases: a null text has no words.  A null id counts as larger than all others.  Rows with the same id never remove
each other's words; those with different texts are told apart by a checksum of the text.  Texts under 50 words are
kept whole; very long ones are read whole.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import sketch
from strandloom.llm.common import Roll, blocks, materialize, mix64, word_hashes

GRAM = 16
#: Words of a block whose windows are grouped in memory.
BLOCK_WORDS = 1 << 19
#: A table of covered ranges up to so many bytes is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 32 << 20
_LAST = np.iinfo(np.int64).max
_gram, _first, _second = Roll(0xD6E8FEB86659FD93), Roll(0xC2B2AE3D27D4EB4F), Roll(0x27D4EB2F165667C5)
_PARTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("doc", "key", "at", "to", "h1", "h2"))])
_PART_TYPES = "kind int, bucket int, doc binary, key binary, at binary, to binary, h1 binary, h2 binary"


@dataclass
class Block:
    """Word hashes of some documents, the word offsets of the documents, their ids and text checksums."""

    words: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    keys: np.ndarray

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, document, anchor) of each window within a document."""
        n = len(self.words) - length + 1
        if n <= 0:
            return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))[:n]
        start = np.flatnonzero(np.arange(length, n + length) <= self.at[doc + 1])
        gram = min(GRAM, length)
        low, wide, span = _gram(self.words, gram), 1, length - gram + 1
        while wide * 2 <= span:
            low, wide = np.minimum(low[:-wide], low[wide:]), wide * 2
        if span > wide:
            low = np.minimum(low[: wide - span], low[span - wide :])
        return start, doc[start], low[start]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, n = [], 0

    def joined() -> Block:
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in held]))])
        return Block(np.concatenate([x[0] for x in held]), at, np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]))

    for batch in batches:
        texts = batch.column("text")
        ids, keys = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in blocks(texts):
            words, at = word_hashes(texts.slice(a, b - a))
            held.append((words, at, ids[a:b], keys[a:b]))
            n += len(words)
            if n >= BLOCK_WORDS:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _runs(changed: np.ndarray) -> np.ndarray:
    """Number of the run that each element is in, from the flags of the elements that begin one after the first."""
    return np.concatenate([[0], np.cumsum(changed)])


def _rows(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket, with the packed values of its elements."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))[: len(cuts)]
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for c in columns]
    packed += [pa.array([b""] * len(cuts), pa.binary())] * (6 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), kind), pa.int32()), pa.array(bucket[cuts], pa.int32()), *packed], schema=_PARTS)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _merged_ranges(doc: np.ndarray, key: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [at, to) of each (doc, key), in order, with overlapping and adjacent ones as one."""
    if not len(doc):
        return doc, key, at, to
    order = np.lexsort((at, key, doc))
    doc, key, at, to = doc[order], key[order], at[order].astype(np.int64), to[order].astype(np.int64)
    group = _runs((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) << 32
    reach = np.maximum.accumulate(to + group)
    first = np.flatnonzero(np.concatenate([[True], (at + group)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], key[first], at[first].astype(np.int32), (reach[last] - group[last]).astype(np.int32)


def _settle(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by window and document, whether a smaller document has the window too, in that order)."""
    order = np.lexsort((doc, h2, h1))
    doc, h1, h2 = doc[order], h1[order], h2[order]
    first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
    return order, doc > least


def covered_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(doc, key, at, to): word ranges of each document that windows of smaller documents cover."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(total // 90)
    buckets = 1 << min(30, max(8, int(total >> 22).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in _blocks(batches):
            _, doc, anchor = block.windows(length)
            if len(doc):
                turn = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
                doc, anchor = doc[turn], anchor[turn]
                order = np.lexsort((doc, anchor))
                doc, anchor = doc[order], anchor[order]
                held.append(anchor[np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])])
                n += len(held[-1])
            if n >= 1 << 22:
                yield from sketch.partial(held, bits)
                held, n = [], 0
        yield from sketch.partial(held, bits)

    bitmap = docs.sparkSession.sparkContext.broadcast(sketch.merged(docs.select("doc", "key", "text").mapInArrow(count, sketch.SCHEMA), bits))
    home = lambda doc, key: (mix64(doc.view(np.uint64) ^ key.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int32)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            start, doc, anchor = block.windows(length)
            if not len(start):
                continue
            turn = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            often = sketch.repeated(bitmap.value, anchor[turn], bits)[np.cumsum(turn) - 1]
            start, doc = start[often], doc[often]
            if not len(start):
                continue
            h1, h2 = _first(block.words, length)[start], _second(block.words, length)[start]
            order, copied = _settle(block.ids[doc], h1, h2)
            at = (start - block.at[doc]).astype(np.int32)
            here = order[copied]
            ranges = _merged_ranges(block.ids[doc[here]], block.keys[doc[here]], at[here], at[here] + length)
            yield _rows(1, home(ranges[0], ranges[1]), list(ranges))
            out = order[~copied]
            yield _rows(0, (h1[out] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32), [block.ids[doc[out]], block.keys[doc[out]], at[out], at[out] + length, h1[out], h2[out]])

    def settle(table: pa.Table) -> pa.Table:
        table = table.select(_PARTS.names)
        if table.column("kind")[0].as_py() == 1:
            return table
        doc, key, at = _column(table, "doc", "<i8"), _column(table, "key", "<i8"), _column(table, "at", "<i4")
        order, copied = _settle(doc, _column(table, "h1", "<u8"), _column(table, "h2", "<u8"))
        here = order[copied]
        ranges = _merged_ranges(doc[here], key[here], at[here], at[here] + np.int32(length))
        return pa.Table.from_batches([_rows(1, home(ranges[0], ranges[1]), list(ranges))])

    def gather(table: pa.Table) -> pa.Table:
        doc, key, at, to = _merged_ranges(*(_column(table, c, k) for c, k in (("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("to", "<i4"))))
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.empty(0, np.int64)
        cuts = pa.array(np.append(first, len(doc)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (at, to)]
        return pa.table({"doc": pa.array(doc[first], pa.int64()), "key": pa.array(key[first], pa.int64()), "at": lists[0], "to": lists[1]})

    parts = docs.select("doc", "key", "text").mapInArrow(windows, _PART_TYPES)
    settled = parts.groupBy("kind", "bucket").applyInArrow(settle, _PART_TYPES)
    return settled.groupBy("bucket").applyInArrow(gather, "doc long, key long, at array<int>, to array<int>")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    if not 1 <= length < 1 << 15:
        raise ValueError("length must be from 1 to 32767 words")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(_LAST))).alias("doc"), F.crc32(value.cast("binary")).alias("key"), value.alias("text"), F.col(f"`{id_col}`").isNull().alias("none"))
    ranges = materialize(covered_ranges(rows, length), "ranges")
    size = ranges.agg(F.count("*") * 32 + F.sum(F.size("at")) * 8).first()[0] or 0
    joined = rows.join(F.broadcast(ranges) if size <= MOST_BROADCAST else ranges.hint("shuffle_hash"), ["doc", "key"], "left")
    names = ["doc", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    types = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, none, value, at, to in zip(*(batch.column(c) for c in ("doc", "none", "text", "at", "to")), strict=True):
                words = value.as_py().encode().split()
                kept, end = [], 0
                for a, b in zip(at.as_py() or (), to.as_py() or (), strict=True):
                    kept += words[end:a]
                    end = b
                kept += words[end:]
                joined_ = b" ".join(kept)
                row = (None if none.as_py() else doc.as_py(), len(words), len(words) - len(kept), hashlib.sha256(joined_).hexdigest())
                out.append((*row, joined_.decode()) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return joined.select("doc", "none", "text", "at", "to").mapInArrow(apply, types).withColumnRenamed("doc", id_col)
