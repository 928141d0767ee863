import random

import numpy as np
import pyarrow as pa
from tests.llm.conftest import corpus, prose

from strandloom.llm import quality as Q


def labelled(n=400, seed=2):
    """(text, good): prose, and texts that shout, repeat, carry marks or are tables."""
    rng, out = random.Random(seed), []
    sentence = lambda k: " ".join(rng.choice(["the", "of", "a", "in", "to"]) if rng.random() < 0.35 else prose(rng, 1) for _ in range(k)).capitalize() + "."
    for k in range(n):
        text = " ".join(sentence(rng.randrange(5, 15)) for _ in range(rng.randrange(3, 12)))
        kind = k % 10
        if kind == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif kind == 1:
            text = " ".join(f"{w} " * 9 for w in text.split()[:9])
        elif kind == 2:
            text = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in text.split())
        elif kind == 3:
            text = " | ".join(w for w in text.split() if len(w) > 3)
        out.append((text, kind > 3))
    return out


def test_held_out_accuracy(documents):
    rows = labelled()
    out = Q.score_documents(documents(list(enumerate(t for t, _ in rows)))).collect()
    right = np.mean([r["keep"] == rows[r["doc_id"]][1] for r in out])
    assert right > 0.97 and all(r["keep"] for r in out if rows[r["doc_id"]][1])


def test_label_model_finds_rates():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    v = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where(rng.random(20000) < np.where(good, 0.01, 0.6), 1, 2)) for _ in range(Q.LABELLERS)], axis=1)
    pattern, count = np.unique(Q.patterns(v), return_counts=True)
    found = Q.label_model(pattern, count)
    guess = np.array([found[p] for p in Q.patterns(v)]) > 0.5
    assert (guess == good).mean() > 0.97
    assert (Q.unpack(Q.patterns(v)) == v).all()
    assert Q.label_model(np.empty(0, np.int64), np.empty(0, np.int64)) == {}


def brute_em(v, rounds=100):
    """Expectation-maximisation document by document, with the same start and priors, in plain Python."""
    (rate_bad, share_bad), (rate_good, share_good) = Q.OBJECTS, Q.FALSE_ALARM
    good = [0.1 if 1 in row else 0.95 for row in v]
    for _ in range(rounds):
        objects = []
        for of_class, rate, share in (([1 - g for g in good], rate_bad, share_bad), (good, rate_good, share_good)):
            pseudo = share * len(v) + 1
            objects.append([(sum(w for w, row in zip(of_class, v) if row[k] == 1) + rate * pseudo) / (sum(w for w, row in zip(of_class, v) if row[k] != 0) + pseudo) for k in range(Q.LABELLERS)])
        prior = (sum(good) + 1) / (len(v) + 2)
        new = []
        for row in v:
            p = [1 - prior, prior]
            for c in (0, 1):
                for k, x in enumerate(row):
                    p[c] *= 1 if x == 0 else objects[c][k] if x == 1 else 1 - objects[c][k]
            new.append(p[1] / (p[0] + p[1]))
        done, good = max(abs(a - b) for a, b in zip(new, good)) < 1e-9, new
        if done:
            break
    return good


def test_label_model_matches_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300):
        v = rng.choice(3, (n, Q.LABELLERS), p=[0.2, 0.15, 0.65])
        pattern, count = np.unique(Q.patterns(v), return_counts=True)
        found = Q.label_model(pattern, count)
        assert np.allclose([found[p] for p in Q.patterns(v)], brute_em(v.tolist()), atol=1e-6)


def test_scores_do_not_depend_on_the_block():
    rows = [t for t, _ in labelled(60)]
    every = Q.features(Q.Texts(pa.array(rows)))
    for k in (0, 17, 59):
        doc, feature, value = Q.features(Q.Texts(pa.array([rows[k]])))
        mine = every[0] == k
        assert feature.tolist() == every[1][mine].tolist() and np.allclose(value, every[2][mine])


def test_edge_cases(documents):
    rows = corpus()
    out = Q.score_documents(documents(rows)).collect()
    assert len(out) == len(rows)
    assert all(r["score"] == 0 and not r["keep"] for r in out if r["doc_id"] in (170, 171, 172))
    kept = Q.keep_good(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == sum(r["keep"] for r in out)
    assert Q.score_documents(documents([])).collect() == [] and Q.keep_good(documents([])).collect() == []
    assert Q.score_documents(documents([(1, None)])).collect()[0]["keep"] is False
