import random
import zlib

import numpy as np
import public_tokenizers
from tests.llm.conftest import corpus, prose
from tokenizers import Tokenizer

from strandloom.llm import packing
from strandloom.llm.common import trimmed
from strandloom.llm.packing import Index, Statistics, Tokens, _cut, _statistics, pack_documents, pack_ids, unpack_ids


def reference_ids(text, tokenizer=[]):
    if not tokenizer:
        tokenizer.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return [*tokenizer[0].encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, pieces, window):
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(reference_ids(t))
    got, sequences = {}, {}
    for r in pieces:
        ids = np.array(r["ids"], np.uint32)
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        got.setdefault(r["doc_id"], []).append((r["start"], r["doc_tokens"], list(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, texts in want.items():
        assert sorted(i for x in texts for i in x) == sorted(i for _, _, ids in got[d] for i in ids)
        if len(texts) == 1:
            assert [i for _, _, ids in sorted(got[d]) for i in ids] == texts[0]
            assert {n for _, n, _ in got[d]} == {len(texts[0])}
    assert got.keys() == want.keys()
    lost = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        lost += 0 if at & (at - 1) == 0 else window - at
    return lost


def test_round_trip_and_no_padding(spark, documents):
    rows = corpus()
    for window, shard in ((2048, 512), (64, 16)):
        pieces = pack_documents(documents(rows).repartition(3, "doc_id"), window=window, shard=shard, with_ids=True).collect()
        assert check(rows, pieces, window) == 0
    assert pack_documents(documents([])).collect() == []
    assert [tuple(r)[1:5] for r in pack_documents(documents([(None, None)])).collect()] == [(0, 1, zlib.crc32(b"\1\0\0\0"), 1)]


def test_neighbours_by_bm25():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, 40).astype(np.uint32) + 100 * (k % 5) for k in range(20)]
    index = Index(texts)
    assert set(index.neighbours(3, np.ones(20, bool))) == {3, 8, 13, 18}
    unused = np.ones(20, bool)
    unused[[3, 8]] = False
    assert set(index.neighbours(3, unused)) == {13, 18}
    # brute force
    n, avg = 20, np.mean([len(t) for t in texts])
    score = np.zeros(20)
    for t in set(texts[3].tolist()):
        df = sum(t in x for x in texts)
        for k, x in enumerate(texts):
            tf = (x == t).sum()
            score[k] += np.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
    assert index.neighbours(3, np.ones(20, bool)).tolist() == [k for k in np.argsort(-score, kind="stable") if score[k] > 0]


def test_hard_texts():
    tokens = Tokens()
    for text in (" " * 200_000, "a" * 100_000, "<|endoftext|> x", "é\u2028日本 \U0001f600", "\n\n \t\r\n"):
        assert tokens(text).tolist() == reference_ids(text)[:-1]
    special = "x <|endoftext|> y" + " " * 200_000 + "<|endoftext|><|endoftext"
    assert tokens(special).tolist() == reference_ids(special)[:-1] and tokens("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]
    assert Tokens(plain=True)("x <|endoftext|> y").tolist() == [87, 1279, 91, 437, 1659, 5239, 91, 29, 331]


def test_statistics_of_all_rests_match_brute_force(spark, documents):
    rows = corpus()
    cut = _cut(documents(rows).repartition(3).select("doc_id", "text").toDF("doc", "text"), 64, 1, "byte_bpe_50k", False, False)
    found = _statistics(cut.where("rest is not null"))
    rests = [ids[len(ids) - len(ids) % 64 :] for ids in map(reference_ids, (t for _, t in rows)) if len(ids) % 64]
    assert found.n == len(rests) and found.mean == sum(map(len, rests)) / len(rests)
    assert found.df.tolist() == [sum(k in r for r in map(set, rests)) for k in range(len(found.df))]
    assert len(found.df) == 1 + max(map(max, rests))


def test_weights_come_from_the_whole_table():
    texts = [np.array(t, np.uint32) for t in ([5, 6], [5, 6], [5, 7], [7, 8])]
    df = np.zeros(9, np.int64)
    df[[5, 6, 7, 8]] = [90, 2, 10, 1]
    index = Index(texts, Statistics(100, 2.0, df))
    # 5 stands in 90 of 100 rests and counts nothing, though in three of these four
    assert index.neighbours(0, np.ones(4, bool)).tolist() == [0, 1]
    assert set(index.neighbours(2, np.ones(4, bool))) == {2, 3}


def test_related_documents_of_far_partitions_share_sequences(spark, documents):
    rng = random.Random(4)
    topics = [[f"{a}{b}" for a, b in zip(rng.sample(prose(rng, 400).split(), 40), range(k, 4000, 100))] for k in range(60)]
    rows = [(60 * c + k, " ".join(rng.choice(topics[k]) for _ in range(60))) for c in range(8) for k in range(60)]
    pieces = pack_documents(documents(rows).repartitionByRange(8, "doc_id"), shard=32).collect()
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 60)
    # a sequence holds some five documents; of unrelated ones it would hold as many topics
    documents_held = len({(r["sequence_id"], r["doc_id"]) for r in pieces})
    assert sum(map(len, held.values())) < 0.6 * documents_held


def test_a_hot_group_is_spread_over_partitions(spark, documents):
    hot = prose(random.Random(6), 50)
    pieces = pack_documents(documents([(k, hot) for k in range(2000)]).repartition(2)).collect()
    per = {}
    for r in pieces:
        per[r["sequence_id"] >> 40] = per.get(r["sequence_id"] >> 40, 0) + r["length"]
    assert len(per) >= 6 and max(per.values()) < 0.3 * sum(per.values())


def test_stored_ids_round_trip():
    for ids in ([], [1, 0xFFFE], [0xFFFF], [3, 70_000], [0xFFFFFFFF, 0]):
        assert unpack_ids(pack_ids(np.array(ids, np.uint32))).tolist() == ids


def test_every_task_gives_its_memory_back(spark, monkeypatch):
    """Workers serve the next stage, so none may keep the tokenizer's or a shard's memory."""
    seen = []
    monkeypatch.setattr(packing, "trimmed", lambda task: seen.append(task.__name__) or trimmed(task))
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(20)], "doc_id long, text string")
    assert packing.pack_documents(docs).count() >= 20
    assert seen == ["cut", "count", "routed", "pack"]
