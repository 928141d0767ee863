import random
import re
from collections import Counter

import pytest
from tests.llm.conftest import prose

from strandloom.llm import collocations
from strandloom.llm.collocations import mine_collocations


def brute(rows, least, top):
    counts, totals, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    for (lang, w), a in found.items():
        longer = [v for (g, x), v in found.items() if g == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if any(100 * v >= 80 * a for v in longer):
            continue
        score, _, left, right = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked = []
    for lang in totals:
        for k, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, k, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(ranked)


def texts(rng):
    rows = []
    some = [prose(rng, 2) for _ in range(12)]
    for lang in ("en", "de", None, "und", "e\tn"):
        for _ in range(60):
            words = [x for _ in range(rng.randrange(12)) for x in rng.choice([rng.choice(some), prose(rng, 1), "A b C d", "a b", "é ß É", "a a a a a"]).split(" ")]
            rows.append(("".join(w + rng.choice([" ", "  ", "\t ", " ", " ", ". ", "\x0b", "\r\n"]) for w in words), lang))
    return rows + [("The same line. " * 50, "en")] * 40 + [(None, "en"), ("", None), (" ,. \n", "xx"), ("a b c d " * 3000, "long")] + [rows[0]] * 9


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(t, g, 1, "x", 3) for t, g in rows], "text string, lang string, n int, phrase string, words int")


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_matches_brute_force(frame, monkeypatch):
    rows = texts(random.Random(4))
    for least, top, block, bits in ((30, 2000, 8 << 20, 29), (7, 3, 2000, 16)):
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(collocations, "PLACES", block)
        monkeypatch.setattr(collocations, "MOST_BITS", bits)
        assert rows_of(mine_collocations(frame(rows), least=least, top=top)) == brute(rows, least, top)


def test_sums_pass_64_bits_in_products(frame, monkeypatch):
    """Counts near 2**50: the products of score and cover don't fit 64 bits."""
    whole = collocations.pieces
    monkeypatch.setattr(collocations, "pieces", lambda *a: whole(*a).selectExpr("lang", "piece", "m * 1125899906842623 as m"))
    rows = [("x y z", "en")] * 5 + [("x y", "en")] * 2 + [("x q", "en")]
    big = 2**50 - 1
    want = {("x y z", 5 * big, 8 * big, 5 * big, 21 * big, 2000000 * 5 // 13), ("x y", 7 * big, 8 * big, 7 * big, 21 * big, 2000000 * 7 // 15), ("x q", big, 8 * big, big, 21 * big, 2000000 // 9)}
    got = {(r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows_of(mine_collocations(frame(rows)))}
    assert want <= got


def test_empty_table(frame):
    assert mine_collocations(frame([])).collect() == []
