"""Lexical retrieval packing: documents become training sequences of a fixed window with almost no padding.

Every text is tokenised once.  Full windows of a long document are sequences of their own; the rest of each document
(less than a window) is stored as token ids.  Document frequencies and the mean length of all rests are gathered first (a
row for each id of the vocabulary).  A rest's route is made of the least hashes of its best BM25 terms, so related rests,
and copies before all, have routes that lie together wherever they stand in the table; rests are spread in ranges of
routes and sorted by them, and a shard is a bounded number of neighbours in this order.  A shard's rests go to a BM25
inverted index over token ids.
Every unused rest in turn is a seed: the index returns its unused neighbours by score, those that fit are appended, and
the best one that doesn't is cut to fill the window exactly.  Rests of the window left open pass to the next shard; the
last open window of a partition is cut into sequences of power-of-two lengths, which need no padding.

Rests of equal routes are split by their place in the scan, so a hot group of copies fills many shards and partitions.
Memory is bounded by a shard.  Sequence ids hold the partition's number; ranges of routes come from a sample, so running
the query again may give other sequences.

Edge cases: a null or empty text is its end token alone.  Very long texts are tokenised whole and cut; the
string of a special token in a text is that token.  Repeated rows
are packed one by one; their pieces differ by sequence only.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bound_batches, materialize, mix64, trimmed

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


#: Rests in a partition, where there are more than cores to keep busy.
PARTITION = 1 << 17


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, or in four after a leading byte pair if one needs them."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 0xFFFF else b"\xff\xff" + ids.astype("<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, "<u4", offset=2) if data[:2] == b"\xff\xff" else np.frombuffer(data, "<u2")).astype(np.uint32)


class Tokens:
    """Ids of a public byte-level vocabulary; its ranks file gives the same ids as its JSON file, several times faster.

    The strings of the JSON file's special tokens become these tokens wherever they stand in a text, as they do by the
    tokenizer's defaults; with plain they are ordinary text.
    """

    def __init__(self, name: str = "byte_bpe_50k", plain: bool = False):
        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.path, self.exact, self.plain = public.path(f"{name}.json"), None, plain
        with open(self.path, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set() if plain else set(special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype(np.uint32, copy=False)
        except BaseException as error:  # its regex engine gives up on some texts, such as a million spaces
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            from tokenizers import Tokenizer

            if self.exact is None:
                self.exact = Tokenizer.from_file(self.path)
                self.exact.encode_special_tokens = self.plain
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


class Statistics(NamedTuple):
    """What BM25 needs to know of all rests: their number, mean length, and each id's document frequency."""

    n: int
    mean: float
    df: np.ndarray

    def weights(self, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray | int, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        """BM25 weights; terms in half of the documents or more have none."""
        df = self.df[terms]
        return np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes / max(self.mean, 1)))

    def route(self, ids: np.ndarray, best: int = 16) -> int:
        """21 bits of each of the three least hashes among the best terms that other documents have too."""
        terms, tf = np.unique(ids.astype(np.int64), return_counts=True)
        weight = np.where(self.df[terms] > 1, self.weights(terms, tf, len(ids)), 0)
        order = np.lexsort((terms, -weight))[:best]
        least = np.sort(mix64(terms[order[weight[order] > 0]].astype(np.uint64)))[:3] >> np.uint64(43)
        parts = [int(x) for x in least] + [(1 << 21) - 1] * (3 - len(least))
        return parts[0] << 42 | parts[1] << 21 | parts[2]


class Index:
    """A shard's BM25 inverted index, by the statistics of all documents or, without them, of its own."""

    def __init__(self, texts: list[np.ndarray], statistics: Statistics | None = None):
        n = len(texts)
        sizes = np.array([len(t) for t in texts])
        of = np.repeat(np.arange(n), sizes)
        terms = np.concatenate(texts).astype(np.int64) if n else np.empty(0, np.int64)
        pair, tf = np.unique(terms * n + of, return_counts=True)
        term, doc = pair // max(n, 1), pair % max(n, 1)
        _, at, df = np.unique(term, return_index=True, return_counts=True)
        no = np.repeat(np.arange(len(df)), df)
        if statistics is None:
            statistics = Statistics(n, sizes.mean() if n else 0, np.bincount(term))
        self.n, self.first, self.df = n, at, df
        self.weight = statistics.weights(term, tf, sizes[doc])
        self.doc = doc
        keep = self.weight > 0
        order = np.argsort(doc[keep], kind="stable")
        self.by_doc = no[keep][order]
        self.start = np.searchsorted(doc[keep][order], np.arange(n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a weighted term with the seed, best first."""
        terms = self.by_doc[self.start[seed] : self.start[seed + 1]]
        if not len(terms):
            return np.empty(0, np.int64)
        df = self.df[terms]
        ends = np.cumsum(df)
        postings = np.arange(ends[-1]) + np.repeat(self.first[terms] - ends + df, df)
        score = np.bincount(self.doc[postings], self.weight[postings], self.n) * unused
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Packs one partition's rests; out holds the pieces of the sequences that are complete."""

    def __init__(self, window: int, shard: int, base: int, with_ids: bool, statistics: Statistics | None = None):
        self.window, self.shard, self.sequence, self.with_ids, self.statistics = window, shard, base, with_ids, statistics
        self.pool: list[list] = []  # [document, ids, start, tokens of the document]
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray, start: int, total: int) -> None:
        self.pool.append([doc, ids, start, total])
        if len(self.pool) >= self.shard:
            self.pool = self._pack()

    def _emit(self, pieces: list[list]) -> None:
        offset = 0
        for doc, ids, start, total in pieces:
            row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset)
            self.out.append((*row, ids) if self.with_ids else row)
            offset += len(ids)
        self.sequence += 1

    def _pack(self) -> list[list]:
        """Emit full windows; what the last, open window holds is returned."""
        if not self.pool:
            return []
        pool, index = self.pool, Index([p[1] for p in self.pool], self.statistics)
        unused = np.ones(len(pool), bool)
        for seed in range(len(pool)):
            if not unused[seed]:
                continue
            unused[seed] = False
            chosen, room = [pool[seed]], self.window - len(pool[seed][1])
            near = index.neighbours(seed, unused) if room else ()
            for k in near:
                if len(pool[k][1]) <= room:
                    unused[k] = False
                    chosen.append(pool[k])
                    room -= len(pool[k][1])
                    if not room:
                        break
            while room:  # cut the best neighbour that doesn't fit; without one, take any unused document
                k = next((k for k in near if unused[k]), None)
                if k is None:
                    k = next(iter(np.flatnonzero(unused)), None)
                if k is None:
                    return chosen
                doc, ids, start, total = pool[k]
                chosen.append([doc, ids[:room], start, total])
                unused[k] = len(ids) > room
                pool[k] = [doc, ids[room:], start + room, total]
                room -= len(chosen[-1][1])
            self._emit(chosen)
        return []

    def finish(self) -> None:
        left = self._pack()
        room = sum(len(p[1]) for p in left)
        while room:
            size = 1 << (room.bit_length() - 1)
            pieces, need = [], size
            while need:
                doc, ids, start, total = left[0]
                pieces.append([doc, ids[:need], start, total])
                left[0] = [doc, ids[need:], start + len(pieces[-1][1]), total]
                if not len(left[0][1]):
                    left.pop(0)
                need -= len(pieces[-1][1])
            self._emit(pieces)
            room -= size
        self.pool = []


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(rows: DataFrame, window: int, end_token: int, vocabulary: str, plain: bool, with_ids: bool) -> DataFrame:
    """Windows of long documents, which are sequences already, and the rest of each document with its ids (rest)."""
    schema = pa.schema([("doc", pa.int64()), *_SCHEMA, ("rest", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(vocabulary, plain), np.array([end_token], np.uint32)
        place, out, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([tokens(value.as_py() or ""), end])
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    whole = len(part) == window
                    found = (zlib.crc32(part.astype("<u4").tobytes()), None, part if with_ids else None) if whole else (None, pack_ids(part), None)
                    out.append((doc.as_py(), start, len(part), found[0], len(ids), place, 0, *found[1:]))
                    place, held = place + 1, held + 2 * len(part)
                    if held >= 4 << 20:
                        yield _table(out, schema)
                        out, held = [], 0
        yield _table(out, schema)

    return rows.mapInArrow(trimmed(cut), f"doc long, {PIECES}, rest binary, ids array<long>")


def _statistics(rests: DataFrame) -> Statistics:
    """Statistics of all rests; each task adds up its own, the driver gets a row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for rest in batch.column(0):
                terms = np.unique(unpack_ids(rest.as_py()))
                if len(terms) and terms[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(terms[-1]) + 1, np.int64)])
                df[terms] += 1
            n += len(batch)
            size += sum(batch.column(1).to_pylist())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], met])), pa.array(np.concatenate([[n, size], df[met]]))], ["term", "n"])

    rows = rests.select("rest", "length").mapInArrow(trimmed(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    n, size = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, size / max(n, 1), df)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 2048, shard: int = 512, end_token: int = 1, vocabulary: str = "byte_bpe_50k", with_ids: bool = False, plain: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    plain: the strings of special tokens in a text are ordinary text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    cut = materialize(_cut(rows, window, end_token, vocabulary, plain, with_ids), "pieces")
    rests = cut.where("rest is not null")
    statistics = _statistics(rests)

    schema = pa.schema([("doc", pa.int64()), *_SCHEMA] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    types = f"doc long, {PIECES}" + (", ids array<long>" if with_ids else "")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = [statistics.route(unpack_ids(rest.as_py())) for rest in batch.column("rest")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.int64())], [*batch.schema.names, "route"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # windows have the numbers below 2**62
        packer = Packer(window, shard, 1 << 62 | TaskContext.get().partitionId() << 40, with_ids, statistics)
        for batch in batches:
            for doc, start, total, rest in zip(*(batch.column(k) for k in ("doc", "start", "doc_tokens", "rest")), strict=True):
                packer.add(doc.as_py(), unpack_ids(rest.as_py()), start.as_py(), total.as_py())
                if len(packer.out) >= 8192:
                    yield _table(packer.out, schema)
                    packer.out = []
        packer.finish()
        yield _table(packer.out, schema)

    # places, which differ, split the rests of one route
    parts = max(2 * spark.sparkContext.defaultParallelism, statistics.n // PARTITION)
    near = rests.select("doc", "start", "doc_tokens", F.col("sequence_id").alias("place"), "rest").mapInArrow(trimmed(routed), "doc long, start long, doc_tokens long, place long, rest binary, route long")
    near = near.repartitionByRange(parts, "route", "place").sortWithinPartitions("route", "place").drop("route", "place")
    windows = cut.where("rest is null").select(*schema.names)
    return windows.unionByName(near.mapInArrow(trimmed(pack), types)).withColumnRenamed("doc", id_col)
