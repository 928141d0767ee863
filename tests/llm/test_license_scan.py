import re

from tests.llm.conftest import corpus

from strandloom.llm.license_scan import BASE_PHRASES, SEPARATORS, TEMPLATES, scan_licenses, words_of

LINES = {
    "Released under the MIT license.": ("mit", "mit"),
    "x Licensed under the Apache License, Version 2.0. under the mit-license under_the mit license": ("apache-2,mit", "apache-2,mit"),
    "Licensed under CC BY-NC 4.0.": ("cc-by-nc", "cc-by-nc"),
    "This work is licensed under the GNU General Public License, version 3.": ("", "gpl-3"),
    "the apache license\nversion 2": ("apache-2", "apache-2"),
    "a licence of a kind; see the license": ("", ""),
    "cc by ncé": ("", ""),
    "the GNU version 3 of a general public": ("", ""),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": ("", "mit"),
}


def brute(text):
    words = [w for w in re.split(SEPARATORS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    spots = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(words_of(p))] == words_of(p)]
    starts = [i for i, _ in spots]
    return len(words), len(spots), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in spots}))


def test_base_matches_brute_force_and_labels(documents):
    texts = list(LINES) + ["under the mit license " * 40] + [t for _, t in corpus()]
    filler = [f"{'plain words ' * 5} {k}" for k in range(100)]
    rows = list(enumerate(texts + filler))
    got = {r["doc_id"]: r for r in scan_licenses(documents(rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")
        if t in LINES:
            assert (r["base_labels"], r["labels"]) == LINES[t]


def test_empty_table_and_nulls(documents):
    assert scan_licenses(documents([])).collect() == []
    assert tuple(scan_licenses(documents([(None, None)])).collect()[0]) == (None, 0, 0, None, None, "", "", 0.0)


def test_a_notice_in_every_third_row_keeps_its_label(documents):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [(k, notice if k % 3 == 0 else f"plain words {k}") for k in range(90)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(documents(rows)).collect()}
    assert got == {k: ("gpl-3", 1.0) if k % 3 == 0 else ("", 0.0) for k, _ in rows}


def test_all_notices_of_a_long_file_are_found(documents):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    gpl = "This work is licensed under the GNU General Public License, version 3"
    every = ". ".join(t.text for t in TEMPLATES)
    rows = [(1, f"{bsd}. {gpl}."), (2, f"{every}. {'plain words ' * 500}"), *((k, f"gnu general public {k}") for k in range(3, 80))]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(documents(rows)).where("doc_id < 3").collect()}
    assert got == {1: "bsd-3,gpl-3", 2: ",".join(sorted({t.label for t in TEMPLATES}))}
