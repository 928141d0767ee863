import zlib
from collections import Counter

import numpy as np
from tests.llm.conftest import corpus

from strandloom.llm.sharding import jump_hash, shard_documents


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.concatenate([np.arange(2000, dtype=np.uint64), np.array([2**63, 2**64 - 1], np.uint64)])
    for n in (1, 2, 40, 41):
        assert jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    assert max(Counter(jump_hash(np.arange(40000), 40).tolist()).values()) < 1200


def test_shards_slots_and_growth(documents):
    rows = corpus()
    for piece in (10_000, 2):
        got = shard_documents(documents(rows), 7, piece_rows=piece).collect()
        size = lambda t: len((t or "").encode()) + 16
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
        slots = {}
        for r in got:
            assert r["law"] == "key" and r["shard"] == jump(r["doc_id"] or 0, 7) and r["grown_shard"] in (r["shard"], 7)
            assert r["grown_shard"] == jump(r["doc_id"] or 0, 8)
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(documents([])).collect() == []


def test_slots_are_in_order_of_key_at_every_size(documents):
    rows = corpus() + [(40, f"same key {k % 3}") for k in range(60)]
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])
    seen = []
    for piece in (10_000, 9):
        got = sorted(shard_documents(documents(rows).repartition(3), 5, piece_rows=piece).collect(), key=lambda r: (r["shard"], r["slot"]))
        assert got == sorted(got, key=lambda r: (r["shard"], order(r)))
        seen.append(got)
    assert seen[0] == seen[1]


def test_key_columns_with_dots_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "`size` long, `a.b` string")
    got = shard_documents(rows, 3, key="size", text="a.b")
    assert got.columns == ["size", "size_", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r["size"], r["size_"]) for r in got.collect()) == [(1, 17), (2, 16)]
    assert shard_documents(rows, 3, key="a.b", text="a.b").count() == 2


def test_other_key_types(spark):
    rows = spark.createDataFrame([("a", "x"), (None, None), ("b", "")], "name string, body string")
    assert len(shard_documents(rows, 3, key="name", text="body").collect()) == 3
