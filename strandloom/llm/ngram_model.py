"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

The probability of a token is a mixture of its relative frequencies after one word, two words and so on down to its share of
all tokens and to 1 / (V + 1).  The weights of a mixture depend on how often the longest context that was seen stands in
the training texts (by powers of two).  They are learned by expectation-maximisation on held-out counts: the training
texts are four folds, and each fold's tokens are events for the estimates of the other three ("deleted" ones).

Texts become blocks of one fold each, stored as word numbers.  A block asks for each of its different n-grams once, from
the bucket of the n-gram's hash, with its own count; the bucket adds up the folds and answers in the order of the
question.  So a frequent n-gram is one entry a block, however often it stands, and buckets are even by construction.  For the
weights, events are gathered in cells of their context's frequency and their estimates' octaves, with the means of the
logarithms, and each context frequency's weights are learned in a task of its own.  Then every token of every text is
scored with the counts of all training texts.

Equal 64-bit hashes count as equal n-grams.  Edge cases: a null text is empty and has one token, the end; a null id is an
empty text for the choice of the fold; very long texts are blocks of their own; repeated rows are scored one by one and
counted as often.  Without training texts all estimates but the last are nothing.  An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Roll, bound_batches, materialize, mix64, release, text_bytes, word_hashes

ORDER = 2
FOLDS, HELD_OUT = 5, 1
#: Bytes of text in a block, and different n-grams in a bucket, about.
BLOCK, BUCKET = 8 << 20, 1 << 21
#: Rounds of expectation-maximisation, and the events that each weight counts as beforehand.
ROUNDS, PRIOR = 40, 0.5
_START, _STOP = np.uint64(0x8F1BBCDCBFA53E0B), np.uint64(0x5BE0CD19137E2179)
_SALT = 0x9E6C63D0876A9A47
_gram = Roll(0xD1B54A32D192ED03)


def pack(values: np.ndarray) -> bytes:
    """64-bit values by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _salted(grams: np.ndarray, n: int) -> np.ndarray:
    return mix64(grams ^ np.uint64(_SALT * n % 2**64))


class Block:
    """The tokens of some texts, each text led by order - 1 starts and closed by an end.

    `at` are the places of the last start and of all tokens of each text, so the place before a token's is its context's.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, order: int):
        self.order, pads = order, order - 1
        whole = lengths + pads + 1
        first = np.cumsum(whole) - whole
        self.seq = np.full(int(whole.sum()), _START, np.uint64)
        ends = first + whole - 1
        place = np.ones(len(self.seq), bool)
        for k in range(pads):
            place[first + k] = False
        place[ends] = False
        self.seq[place] = words
        self.seq[ends] = _STOP
        place[ends] = place[first + pads - 1] = True
        self.at = np.flatnonzero(place)
        self.token = np.ones(len(self.at), bool)
        self.token[np.cumsum(lengths + 2) - (lengths + 2)] = False
        self.doc = np.repeat(np.arange(len(lengths)), lengths + 2)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(the different n-grams that end at a place, sorted; the number of each place's)."""
        at = self.at if n < self.order else self.at[self.token]
        return np.unique(_salted(_gram(self.seq, n)[at - n + 1], n), return_inverse=True)

    def counts(self, answers: dict[int, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For n = 1 .. order of each token: (count of the n-gram, count of the context of n - 1 words, from n = 2)."""
        tokens, contexts = [], []
        for n in range(1, self.order + 1):
            of_place = answers[n][self.grams(n)[1]].astype(np.float64)
            tokens.append(of_place[self.token] if n < self.order else of_place)
            if n < self.order:
                contexts.append(of_place[np.flatnonzero(self.token) - 1])
        return tokens, contexts


def _stored(order: int, id_type: pa.DataType):
    """Texts to blocks of one fold: ids, words in each, and the words as numbers in a list of hashes, frequent ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        task, made = TaskContext.get().partitionId(), 0

        def block(fold: int) -> pa.RecordBatch:
            nonlocal made
            ids = [x for part in held[fold] for x in part[0].to_pylist()]
            lengths = np.concatenate([part[1] for part in held[fold]])
            words, number, times = np.unique(np.concatenate([part[2] for part in held[fold]]), return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            by = np.argsort(-times, kind="stable")
            rank[by] = np.arange(len(words))
            made += 1
            columns = [pa.array([task << 32 | made], pa.int64()), pa.array([fold], pa.int32()), pa.array([ids], pa.list_(id_type))]
            columns += [pa.array([pack(x)], pa.binary()) for x in (lengths, words[by], rank[number])]
            columns.append(pa.array([int(lengths.sum()) + len(lengths)], pa.int64()))
            held[fold], sizes[fold] = [], 0
            return pa.RecordBatch.from_arrays(columns, names=_STORED)

        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for fold in np.unique(folds).tolist():
                rows = pa.array(np.flatnonzero(folds == fold))
                some, at = batch.take(rows), 0
                _, ends = text_bytes(some.column("text"))
                while at < len(some):
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK - sizes.get(fold, 0), "right")) - 1)
                    part = some.slice(at, to - at)
                    words, offsets = word_hashes(part.column("text"), lower=True)
                    held.setdefault(fold, []).append((part.column("id"), np.diff(offsets), words))
                    sizes[fold] = sizes.get(fold, 0) + int(ends[min(to, len(some))] - ends[at])
                    at = to
                    if sizes[fold] >= BLOCK // 2:
                        yield block(fold)
        for fold in [f for f in held if held[f]]:
            yield block(fold)
        release()

    return run


_STORED = ["block", "fold", "ids", "lengths", "words", "numbers", "tokens"]


def _read(row: dict, order: int) -> Block:
    numbers = unpack(row["numbers"]).astype(np.int64)
    return Block(unpack(row["words"])[numbers], unpack(row["lengths"]).astype(np.int64), order)


def _asked(order: int, bits: int):
    """Each block's different n-grams, with its counts of them, by bucket; held-out blocks count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, out = _read(row, order), []
                for n in range(1, order + 1):
                    keys, number = block.grams(n)
                    times = np.bincount(number, minlength=len(keys)) if row["fold"] != HELD_OUT else np.zeros(len(keys), np.int64)
                    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                    for bucket, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)), strict=True)):
                        if b > a:
                            out.append((bucket, n, row["block"], row["fold"], pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(times[a:b])))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "n", "block", "fold", "keys", "times"])
        release()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Counts in all training folds, and in those but the asking block's, of the n-grams of a bucket, by asking block."""
    out, start = [], _salted(_gram(np.array([_START]), 1), 1)[0]
    for n in sorted(set(table.column("n").to_pylist())):
        rows = [r for r in table.to_pylist() if r["n"] == n]
        keys = [np.cumsum(unpack(r["keys"]), dtype=np.uint64) for r in rows]
        fold = np.repeat([r["fold"] for r in rows], [len(k) for k in keys])
        words, number = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.concatenate([unpack(r["times"]) for r in rows]).astype(np.float64)
        by_fold = np.bincount(number * FOLDS + fold, times, minlength=len(words) * FOLDS).astype(np.int64).reshape(-1, FOLDS)
        total = by_fold.sum(1)
        distinct, at = int(((total > 0) & (words != start)).sum()) if n == 1 else 0, 0
        for r, k in zip(rows, keys, strict=True):
            own = number[at : at + len(k)]
            at += len(k)
            out.append((r["block"], n, r["bucket"], pack(total[own]), pack(total[own] - by_fold[own, r["fold"]]), distinct))
            distinct = 0
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_ANSWER)


_ANSWER = ["block", "n", "bucket", "total", "deleted", "distinct"]


def context_class(contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length of the longest context that was seen, 64 times that and the bits of its frequency)."""
    longest, seen = np.zeros(len(contexts[0]), np.int64), np.zeros(len(contexts[0]))
    for n, count in enumerate(contexts, 1):
        longest, seen = np.where(count > 0, n, longest), np.where(count > 0, count, seen)
    return longest, longest * 64 + np.frexp(seen)[1]


def estimates(tokens: list[np.ndarray], contexts: list[np.ndarray], total: float, unknown: float) -> np.ndarray:
    """One column for 1 / (V + 1) and one for each n; nothing after a context that wasn't seen."""
    shares = [np.full(len(tokens[0]), unknown), tokens[0] / max(total, 1.0)]
    shares += [np.divide(t, c, out=np.zeros(len(t)), where=c > 0) for t, c in zip(tokens[1:], contexts, strict=True)]
    return np.stack(shares, 1)


def learn_weights(shares: np.ndarray, times: np.ndarray, able: int) -> np.ndarray:
    """Mixture weights of the first `able` estimates by expectation-maximisation over events that happened `times` times."""
    weights = np.where(np.arange(shares.shape[1]) < able, 1.0 / able, 0.0)
    for _ in range(ROUNDS):
        parts = shares * weights
        parts *= (times / parts.sum(1))[:, None]
        weights = parts.sum(0) + np.where(weights > 0, PRIOR, 0.0)
        weights /= weights.sum()
    return weights


def _cells(order: int, tokens_by_fold: dict[int, int], unknown: float):
    """Events of a training block in cells: class of the context, octave of each estimate; number and sums of logarithms."""

    def run(table: pa.Table) -> pa.Table:
        row, answers = _gathered(table, "deleted")
        names = ["class", "cell", "times", *(f"log{n}" for n in range(order + 1))]
        if row["fold"] == HELD_OUT:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())] * (order + 1), names=names)
        tokens, contexts = _read(row, order).counts(answers)
        total = sum(v for k, v in tokens_by_fold.items() if k not in (HELD_OUT, row["fold"]))
        shares = estimates(tokens, contexts, total, unknown)
        logs = np.log2(shares, out=np.full_like(shares, -100.0), where=shares > 0)
        kind = context_class(contexts)[1]
        cell = np.zeros(len(kind), np.int64)
        for n in range(1, order + 1):
            cell = cell * 128 + np.rint(-logs[:, n]).astype(np.int64)
        both, number, times = np.unique(kind << 7 * order | cell, return_inverse=True, return_counts=True)
        sums = [np.bincount(number, logs[:, n]) for n in range(order + 1)]
        return pa.table([pa.array(both >> 7 * order), pa.array(both & ((1 << 7 * order) - 1)), pa.array(times.astype(np.int64)), *map(pa.array, sums)], names=names)

    return run


def _learned(order: int):
    def run(table: pa.Table) -> pa.Table:
        kind, times = table.column("class")[0].as_py(), table.column("times").to_numpy().astype(np.float64)
        logs = np.stack([table.column(f"log{n}").to_numpy() for n in range(order + 1)], 1) / times[:, None]
        weights = learn_weights(np.where(logs > -100, np.exp2(logs), 0.0), times, kind // 64 + 2)
        return pa.table([pa.array([kind]), pa.array([weights.tolist()])], names=["class", "weights"])

    return run


def _gathered(table: pa.Table, which: str) -> tuple[dict, dict[int, np.ndarray]]:
    """The stored block of a group, and its answers for each n."""
    rows = table.select([c for c in table.column_names if c != ("total" if which == "deleted" else "deleted")]).to_pylist()
    block = next(r for r in rows if r["numbers"] is not None)
    answers: dict[int, list] = {}
    for r in sorted((r for r in rows if r["n"] is not None), key=lambda r: (r["n"], r["bucket"])):
        answers.setdefault(r["n"], []).append(unpack(r[which]))
    return block, {n: np.concatenate(x) for n, x in answers.items()}


def weights_of(kinds: np.ndarray, learned: dict[int, list[float]], order: int) -> np.ndarray:
    """The weights of each class; one that no event had takes those of the nearest with as long a context, else equal ones.

    Without any event the even share of the vocabulary has all the weight.
    """
    every, number = np.unique(kinds, return_inverse=True)
    rows = []
    for kind in every.tolist():
        near = min((k for k in learned if k // 64 == kind // 64), key=lambda k: (abs(k - kind), k), default=None)
        able = kind // 64 + 2 if learned else 1
        rows.append(learned[near] if near is not None else [1.0 / able] * able + [0.0] * (order + 1 - able))
    return np.array(rows)[number]


def _scored(order: int, train: int, distinct: int, learned: dict[int, list[float]], names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        row, answers = _gathered(table, "total")
        block = _read(row, order)
        tokens, contexts = block.counts(answers)
        doc, n = block.doc[block.token], len(row["ids"])
        shares = estimates(tokens, contexts, train, 1.0 / (distinct + 1))
        score = np.log10((shares * weights_of(context_class(contexts)[1], learned, order)).sum(1))
        base = np.log10((tokens[0] + 0.5) / (train + 0.5 * (distinct + 1)))
        held = np.full(n, row["fold"] == HELD_OUT)
        columns = [table.column("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        values = [row["ids"], held, np.bincount(doc, minlength=n), np.bincount(doc, tokens[0] > 0, minlength=n).astype(np.int64), np.full(n, train), np.bincount(doc, base, minlength=n), np.bincount(doc, score, minlength=n)]
        return pa.table([pa.array(v, k) for v, k in zip(values, columns, strict=True)], names=names)

    return run


class Model:
    """Counts of a table's blocks and the weights learned from them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER):
        if order < 2:
            raise ValueError("the order must be 2 or more")
        bound_batches(docs.sparkSession)
        self.order, self.id_col = order, id_col
        id_ = F.col(f"`{id_col}`")
        fold = F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
        rows = docs.select(id_.alias("id"), F.col(f"`{text}`").alias("text"), fold.alias("fold"))
        self.id_type = rows.schema["id"].dataType.simpleString()
        from pyspark.sql.pandas.types import to_arrow_type

        types = f"block long, fold int, ids array<{self.id_type}>, lengths binary, words binary, numbers binary, tokens long"
        self.blocks = materialize(rows.mapInArrow(_stored(order, to_arrow_type(rows.schema["id"].dataType)), types), "blocks")
        self.by_fold = {r["fold"]: r["tokens"] for r in self.blocks.groupBy("fold").agg(F.sum("tokens").alias("tokens")).collect()}
        self.train = sum(v for k, v in self.by_fold.items() if k != HELD_OUT)
        bits = max(3, int(sum(self.by_fold.values()) * order // BUCKET).bit_length())
        asked = self.blocks.mapInArrow(_asked(order, bits), "bucket int, n int, block long, fold int, keys binary, times binary")
        self.answers = materialize(asked.groupBy("bucket").applyInArrow(_answer, "block long, n int, bucket int, total binary, deleted binary, distinct long"), "answers")
        self.distinct = self.answers.agg(F.sum("distinct")).first()[0] or 0
        logs = "".join(f", log{n} double" for n in range(order + 1))
        cells = self._by_block("deleted").applyInArrow(_cells(order, self.by_fold, 1.0 / (self.distinct + 1)), f"class long, cell long, times long{logs}")
        cells = cells.groupBy("class", "cell").agg(F.sum("times").alias("times"), *(F.sum(f"log{n}").alias(f"log{n}") for n in range(order + 1)))
        #: Weights of each class of contexts: 128 classes a length at most.
        self.weights = {r["class"]: r["weights"] for r in cells.groupBy("class").applyInArrow(_learned(order), "class long, weights array<double>").collect()}

    def _by_block(self, which: str):
        answers = self.answers.select("block", "n", "bucket", which)
        return self.blocks.unionByName(answers, allowMissingColumns=True).groupBy("block")

    def scores(self) -> DataFrame:
        """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
        names = [self.id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = f"`{self.id_col}` {self.id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return self._by_block("total").applyInArrow(_scored(self.order, self.train, self.distinct, self.weights, names), types)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per text: counts of tokens, log10 probabilities by shares of tokens and by the interpolated model."""
    return Model(docs, id_col, text, order).scores()
