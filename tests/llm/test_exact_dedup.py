import hashlib
import re

from tests.llm.conftest import corpus

from strandloom.llm.exact_dedup import drop_exact_copies, exact_groups


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(digest(t), []).append(d)
    least = {h: min((x for x in ds if x is not None), default=None) for h, ds in groups.items()}
    return sorted(((d, least[digest(t)], len(groups[digest(t)]), digest(t)) for d, t in rows), key=str), len(groups)


def test_matches_brute_force(documents):
    rows = corpus() + [(1000 + k, "one  large\tgroup") for k in range(400)]
    want, n = brute(rows)
    for counters in (4096, 16):
        got = exact_groups(documents(rows), counters=counters).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
        assert sum(r["kept"] for r in got) == n
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_one_of_each_group_stays(documents):
    rows = corpus() + [(140, corpus()[0][1]), (7, "a  b"), (7, "a b"), (7, "a b")]
    kept = drop_exact_copies(documents(rows))
    want, n = brute(rows)
    assert kept.columns == documents(rows).columns
    out = kept.collect()
    assert len(out) == n and {digest(r["text"]) for r in out} == {w[3] for w in want}
    assert {(r["doc_id"], digest(r["text"])) for r in out} == {(w[1], w[3]) for w in want}


def test_empty_table(documents):
    assert exact_groups(documents([])).collect() == []
    assert drop_exact_copies(documents([])).collect() == []
