import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import corpus

from strandloom.llm import ngram_model
from strandloom.llm.ngram_model import Model, learn_weights, score_texts


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), 0]


def fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5


def grams(rows, order, keep):
    """Counts of all n-grams that end at a token, by length, and of contexts that a token follows."""
    counts, contexts = Counter(), Counter()
    for doc, text in rows:
        if keep(fold(doc)):
            seq = [1] * (order - 1) + tokens(text)
            for p in range(order - 1, len(seq)):
                for n in range(1, order + 1):
                    counts[tuple(seq[p - n + 1 : p + 1])] += 1
                    contexts[tuple(seq[p - n + 1 : p])] += 1
    return counts, contexts


def mixed(seq, p, order, counts, contexts, distinct):
    """(class, estimates) of the token at a place."""
    shares, kind = [1 / (distinct + 1)], 0
    for n in range(1, order + 1):
        seen = contexts[tuple(seq[p - n + 1 : p])]
        shares.append(counts[tuple(seq[p - n + 1 : p + 1])] / seen if seen else 0.0)
        if n > 1 and seen:
            kind = 64 * (n - 1) + int(seen).bit_length()
    return kind, shares


def model(rows, order):
    """Base scores, and the weights by expectation-maximisation over every event."""
    counts, contexts = grams(rows, order, lambda f: f != 1)
    total, distinct = contexts[()], sum(len(k) == 1 for k in counts)
    events = {}
    for f in (0, 2, 3, 4):
        rest = grams(rows, order, lambda x, f=f: x not in (1, f))
        for doc, text in rows:
            if fold(doc) == f:
                seq = [1] * (order - 1) + tokens(text)
                for p in range(order - 1, len(seq)):
                    kind, shares = mixed(seq, p, order, *rest, distinct)
                    events.setdefault(kind, []).append(shares)
    weights = {k: learn_weights(np.array(v), np.ones(len(v)), k // 64 + 2) for k, v in events.items()}
    return counts, contexts, total, distinct, weights


def expected(rows, order, weights, counts, contexts, total, distinct):
    out = []
    for doc, text in rows:
        seq = [1] * (order - 1) + tokens(text)
        base = score = known = 0
        for p in range(order - 1, len(seq)):
            c = counts[seq[p],]
            known += c > 0
            base += math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            kind, shares = mixed(seq, p, order, counts, contexts, distinct)
            w = ngram_model.weights_of(np.array([kind]), {k: list(v) for k, v in weights.items()}, order)[0]
            score += math.log10(sum(a * b for a, b in zip(w, shares, strict=True)))
        out.append((str(doc), fold(doc) == 1, len(seq) - order + 1, known, total, base, score))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect())


def same(a, b, tolerance=1e-9):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x[5] == pytest.approx(y[5], rel=1e-9) and x[6] == pytest.approx(y[6], rel=tolerance)


@pytest.mark.parametrize("order,block", [(2, 8 << 20), (2, 3000), (3, 3000)])
def test_matches_brute_force(documents, monkeypatch, order, block):
    monkeypatch.setattr(ngram_model, "BLOCK", block)
    rows = corpus()
    made = Model(documents(rows), order=order)
    *known, weights = model(rows, order)
    scores = got(made.scores())
    same(scores, expected(rows, order, made.weights, *known))  # the counts, given the operator's weights
    assert set(made.weights) == set(weights)
    same(scores, expected(rows, order, weights, *known), 0.01)  # weights learned from single events


def test_probabilities_sum_to_one(documents):
    rows = corpus()
    made = Model(documents(rows))
    counts, contexts, total, distinct, _ = model(rows, 2)
    for context in [1, *[k[0] for k in list(counts) if len(k) == 1][:20]]:
        if context == 0:
            continue
        every = [k[0] for k in counts if len(k) == 1] + ["never seen"]
        mass = 0
        for word in every:
            kind, shares = mixed([context, word], 1, 2, counts, contexts, distinct)
            mass += sum(a * b for a, b in zip(ngram_model.weights_of(np.array([kind]), made.weights, 2)[0], shares, strict=True))
        assert mass == pytest.approx(1)


def test_beats_shares_of_tokens_on_held_out_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = score_texts(rows).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert held["s"] > held["b"] + 0.05 * held["n"]


def test_no_training_texts_and_empty_table(documents):
    alone = [(d, "some text") for d in range(40) if fold(d) == 1][:2]
    assert [r[2:] for r in got(score_texts(documents(alone)))] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert score_texts(documents([])).collect() == []


def test_packing_is_exact():
    rng = random.Random(1)
    values = np.array([rng.randrange(2**64) for _ in range(100)] + [0, 2**64 - 1], np.uint64)
    assert (ngram_model.unpack(ngram_model.pack(values)) == values).all() and not len(ngram_model.unpack(ngram_model.pack(values[:0])))
