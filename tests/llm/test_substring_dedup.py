import hashlib

from tests.llm.conftest import corpus

from strandloom.llm.substring_dedup import dedup_substrings


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    rank = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for r, ws in zip(rank, words):
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            least[w] = min(least.get(w, r), r)
    out = []
    for (d, _), r, ws in zip(rows, rank, words):
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if least[tuple(ws[i : i + length])] < r:
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((d, len(ws), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(documents):
    for length in (50, 5):
        rows = corpus()
        got = sorted((tuple(r) for r in dedup_substrings(documents(rows), length=length).collect()), key=str)
        assert got == brute(rows, length)
        assert sum(r[2] for r in got) > 1000


def test_kept_text_and_empty_table(documents):
    out = dedup_substrings(documents([(1, "a  b\tc"), (2, None)]), with_text=True).collect()
    assert sorted((r["doc_id"], r["kept_text"], r["n_removed"]) for r in out) == [(1, "a b c", 0), (2, "", 0)]
    assert dedup_substrings(documents([])).collect() == []
