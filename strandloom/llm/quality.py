"""Quality classifier: a label model over overlapping heuristics, and a hashed linear scorer trained on its posteriors.

Heuristic labellers vote good, bad or nothing on every document.  Expectation-maximisation over the counts of all vote
patterns (at most 3 to the number of labellers, however many documents there are) estimates each labeller's error rates
and the posterior of "good" for a pattern.  A logistic model over hashed shapes of words, pairs of shapes and repeats
is then trained towards the posteriors, on a sample of at most `sample` documents chosen by a hash of the whole row, and
scores every document.

Edge cases: a null or empty text, or one without words, gets score 0 and is rejected.  Long texts are read whole.
Repeated rows get the same score; columns other than the id and the text are not read by `score_documents` and pass
unchanged in `keep_good`.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Powers, Roll, blocks, mix64, release, text_bytes, word_hashes, word_spans

#: Dimensions of the hashed features, and the largest training sample.
DIMENSIONS, SAMPLE = 1 << 14, 8192
#: Bytes of text taken at once; arrays of about a hundred times as many are made for them.
BLOCK = 1 << 18
_GOOD, _BAD, _NONE = 2, 1, 0
#: Prior rate of objections to bad and to good documents, and the share of all documents that the prior counts as.
OBJECTS, FALSE_ALARM = (0.35, 0.1), (0.01, 1.0)

_CLASS = np.zeros(256, np.uint8)  # lower-case and non-ASCII 0, upper-case 1, digit 2, space 3, others by their value
_CLASS[33:128] = np.arange(33, 128)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers, _five = Powers(0x8CB92BA72F3D8DD7), Roll(0x9FB21C651E98DF25)


class Texts:
    """Word spans, hashes and shapes of a block of texts."""

    def __init__(self, texts: pa.Array):
        self.bytes, self.at = text_bytes(texts)
        self.start, self.end, self.words = word_spans(self.bytes, self.at)
        self.hashes, _ = word_hashes(texts)
        self.n = np.diff(self.words)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.kind = _CLASS[self.bytes]

    def per_doc(self, bytes_flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(bytes_flag, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def per_word(self, word_flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(word_flag, dtype=np.int64)])
        return total[self.words[1:]] - total[self.words[:-1]]

    def again(self) -> np.ndarray:
        """Whether a word equals the one before it, in the same text."""
        out = np.zeros(len(self.hashes), bool)
        out[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.doc[1:] == self.doc[:-1])
        return out

    def shapes(self) -> np.ndarray:
        """A hash of each word's classes of characters, each run of one class counted once."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        turn = np.ones(len(self.kind), bool)
        turn[1:] = self.kind[1:] != self.kind[:-1]
        turn[self.start] = True
        place = np.cumsum(turn)
        up, down = _powers.upto(int(place[-1]) + 2)
        sums = np.zeros(len(turn) + 1, np.uint64)
        np.cumsum(np.where(turn, _VALUES[self.kind] * up[place], np.uint64(0)), out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[place[self.start]])


def _vote(share: np.ndarray, good: float, bad: float, able: np.ndarray) -> np.ndarray:
    """Bad at or beyond one bound, good at or within the other, nothing between or where the labeller can't tell."""
    low = good < bad
    return np.where(~able, _NONE, np.where(share >= bad if low else share <= bad, _BAD, np.where(share <= good if low else share >= good, _GOOD, _NONE)))


def votes(t: Texts) -> np.ndarray:
    """Votes of the labellers, one column each."""
    n = np.maximum(t.n, 1)
    letters, upper = t.per_doc((t.kind <= 1)), t.per_doc(t.kind == 1)
    ink = np.maximum(t.per_doc(t.kind != 3), 1)
    last = t.kind[t.end - 1] if len(t.end) else np.empty(0, np.uint8)
    before = t.kind[np.maximum(t.end - 2, t.start)] if len(t.end) else last
    marked = (last > 3) & (before == last) & (t.end - t.start > 2)
    bare = (last > 3) & (t.kind[t.start] > 3) & (t.end - t.start <= 2) if len(t.end) else marked
    stops = np.isin(last, [ord("."), ord(","), ord("?"), ord("!"), ord(";"), ord(":")]) & ~marked
    other = np.concatenate([[0], np.cumsum(t.kind > 1)])
    plain = other[t.end] == other[t.start]
    repeated = np.zeros(len(t.hashes), bool)
    if len(t.hashes) >= 5:
        run = _five(t.hashes, 5)
        inside = np.flatnonzero(t.doc[4:] == t.doc[:-4])
        order = inside[np.lexsort((run[inside], t.doc[inside]))]
        same = np.flatnonzero((run[order[1:]] == run[order[:-1]]) & (t.doc[order[1:]] == t.doc[order[:-1]])) + 1
        repeated[order[same]] = True
    return np.stack(
        [
            _vote(upper / np.maximum(letters, 1), 0.15, 0.4, t.n >= 5),
            _vote(t.per_word(marked) / n, 0.1, 0.4, t.n >= 5),
            _vote(t.per_word(bare) / n, 0.05, 0.2, t.n >= 5),
            _vote(t.per_word(t.again()) / n, 0.1, 0.35, t.n >= 5),
            _vote(t.per_word(repeated) / n, 0.15, 0.35, t.n >= 20),
            _vote(t.per_word(stops) / n, 0.03, 0.01, t.n >= 40),
            _vote(letters / ink, 0.94, 0.9, t.n >= 5),
            _vote(t.per_word(plain & (t.end - t.start <= 3)) / n, 0.1, 0.04, t.n >= 30),
        ],
        axis=1,
    )


LABELLERS = 8


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(LABELLERS))


def unpack(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(LABELLERS) % 3


def label_model(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> dict[int, float]:
    """Posterior probability of "good" for each vote pattern, by expectation-maximisation.

    Documents are bad in different ways, each of which some labellers only see, so a plain model would count a rare
    way as good.  Hence the start is that any objection makes a document bad, and the rates have priors, worth a share
    of the documents: an objection to a good document is rare, one to a bad document isn't.
    """
    v, count = unpack(pattern), count.astype(float)
    good = np.where((v == _BAD).any(1), 0.1, 0.95)
    for _ in range(rounds):
        rates = []
        for weight, (rate, share) in ((count * (1 - good), OBJECTS), (count * good, FALSE_ALARM)):
            bad_votes = ((v == _BAD) * weight[:, None]).sum(0) + rate * (share * count.sum() + 1)
            rates.append(bad_votes / (((v != _NONE) * weight[:, None]).sum(0) + share * count.sum() + 1))
        prior = ((count * good).sum() + 1) / (count.sum() + 2)
        score = [np.where(v == _BAD, np.log(r), np.where(v == _GOOD, np.log1p(-r), 0)).sum(1) for r in rates]
        new = 1 / (1 + np.exp(np.clip(score[0] + np.log(1 - prior) - score[1] - np.log(prior), -50, 50)))
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
    return {int(p): float(g) for p, g in zip(pattern, good, strict=True)}


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature, value): square roots of the shares of word shapes, pairs of shapes, and repeats."""
    shape, again = t.shapes(), t.again()
    pair = np.flatnonzero(t.doc[1:] == t.doc[:-1])
    spot = [shape, mix64(shape[pair] * np.uint64(3) + shape[pair + 1]), np.where(again, np.uint64(0x51), np.uint64(0x52))]
    doc = np.concatenate([t.doc, t.doc[pair], t.doc])
    key = doc * DIMENSIONS + (np.concatenate(spot) % np.uint64(DIMENSIONS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key // DIMENSIONS, key % DIMENSIONS, np.sqrt(n / np.maximum(t.n[key // DIMENSIONS], 1))


def train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model, by gradient steps with per-weight step sizes."""
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    if not len(target):
        return w
    for _ in range(rounds):
        z = np.bincount(doc, value * w[feature], len(target)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        slope = np.append(np.bincount(feature, value * error[doc], DIMENSIONS), error.sum()) / len(target) + decay * w
        seen += slope * slope
        w -= rate * slope / np.sqrt(seen) * 0.1
    return w


def _each(texts: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    for a, b in blocks(texts, BLOCK):
        yield a, b, Texts(texts.slice(a, b - a))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer, from votes on all documents and a sample of at most `sample` for the features."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{id_col}`").alias("id"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**LABELLERS, np.int64)
        for batch in batches:
            for _, _, t in _each(batch.column(0)):
                total += np.bincount(patterns(votes(t)), minlength=len(total))
        release()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["pattern", "n"])

    counts = rows.select("text").mapInArrow(vote, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    pattern, count = np.array([r["pattern"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    good = label_model(pattern, count)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in _each(batch.column(0)):
                p, (doc, feature, value) = patterns(votes(t)), features(t)
                cuts = np.searchsorted(doc, np.arange(len(t.n) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, k)) for x, k in ((feature, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *lists], names=["pattern", "feature", "value"])

    # rows whose 64-bit hash is under a threshold; a little more than the sample, of which the smallest hashes stay
    share = min(1.0, (sample + 6 * sample**0.5) / max(1, int(count.sum())))
    hashed = rows.withColumn("hash", F.xxhash64("id", "text", F.lit(17)))
    chosen = hashed.where(F.col("hash") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).orderBy("hash").limit(sample)
    got = chosen.select("text").mapInArrow(featurise, "pattern int, feature array<int>, value array<float>").toArrow()
    feature, value = (got.column(c).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())) for c in ("feature", "value"))
    doc = np.repeat(np.arange(got.num_rows), np.diff(feature.offsets.to_numpy()) if got.num_rows else 0)
    target = np.array([good.get(p, 0.5) for p in got.column("pattern").to_pylist()])
    return train(doc, feature.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value.flatten().to_numpy(zero_copy_only=False).astype(float), target)


def score(text: Column, weights: np.ndarray, session) -> Column:
    """Probability that a text is good; 0 without words."""
    shared = session.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for batch in texts:
            out = np.zeros(len(batch))
            for a, b, t in _each(batch):
                doc, feature, value = features(t)
                z = np.bincount(doc, value * w[feature], b - a) + w[-1]
                out[a:b] = np.where(t.n > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0)
            yield pa.array(out, pa.float64())
        release()

    return scored(text)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.35, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, score (0 to 1), keep (score at the threshold or above)."""
    weights = fit(docs, id_col, text, sample)
    out = docs.select(F.col(f"`{id_col}`").alias(id_col), score(F.col(f"`{text}`"), weights, docs.sparkSession).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.35, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    weights = fit(docs, id_col, text, sample)
    return docs.where(score(F.col(f"`{text}`"), weights, docs.sparkSession) >= threshold)
