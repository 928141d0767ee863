"""Licence scan by a positional rare-token index, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased.  The document frequencies of the
templates' vocabulary (a few hundred words) over all documents give the IDF; the highest-IDF word of each template's
mandatory phrase is its anchor, indexed with its position.  Each file looks up all anchors it has; every place of one
names an alignment, which counts if the mandatory phrase stands at its place in the file, so none is missed.
The rows are never shuffled: index and templates are literals of fixed size.

Edge cases: a null or empty text, or one without words, has n_words 0, no labels and score 0.  Long texts are read
whole.  Repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases whose places are counted, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrase: str  # must stand in the file, at the template's place


#: Usual notices of widespread licences and the phrase without which a notice doesn't count.
TEMPLATES = [
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published"),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "foundation either version 2 of the license"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal", "creative commons cc0 1 0 universal"),
]


def words_of(text: str) -> list[str]:
    """The words of a template or phrase."""
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.lower())


def word_string(text: Column) -> Column:
    """The words, A-Z as they are, joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))


def _literal(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return str(value)


def word_frequencies(spaced: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of spaced (column norm) each word of the vocabulary stands; a row for each word at most."""
    known = F.expr(f"array_intersect({_literal(vocabulary)}, split(lower(norm), ' '))")
    found = spaced.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text: str = "text", enough: float = 0.6) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    enough: share of a template's words that an alignment must match; score is the best such share.
    """
    spaced = docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_string(F.col(f"`{text}`")).alias("norm"))
    entries = [(t.label, words_of(t.text), words_of(t.key_phrase)) for t in templates]
    vocabulary = sorted({w for _, ws, _ in entries for w in ws})
    seen = word_frequencies(spaced, vocabulary)
    # the rarest word of each key phrase, with the template's place that it stands at
    postings = {}
    for k, (_, ws, key) in enumerate(entries):
        word = min(key, key=lambda w: (seen.get(w, 0), w))
        postings.setdefault(word, []).append((k, key_at(ws, key) + key.index(word)))
    anchors = sorted(postings)
    index = f"map({', '.join(f'{_literal(w)}, array({", ".join(f"struct({k} as t, {i} as p)" for k, i in ps)})' for w, ps in postings.items())})" if postings else "cast(map() as map<string, array<struct<t: int, p: int>>>)"
    table = "array(" + ", ".join(f"struct({_literal(label)} as label, {_literal(ws)} as words, {_literal(key)} as key, {key_at(ws, key)} as at)" for label, ws, key in entries) + ")"
    phrases = "array(" + ", ".join(f"struct({_literal(words_of(p))} as words, {_literal(label)} as label)" for p, label in BASE_PHRASES.items()) + ")"

    rows = spaced.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1).cast("long"))
    padded = F.col("padded")
    marked = rows.withColumn("padded", F.concat(F.lit(" "), F.lower("norm"), F.lit(" "))).withColumn("hit", _any([padded.contains(f" {w} ") for w in anchors] + [padded.contains(f" {p} ") for p in BASE_PHRASES]))
    low = F.translate("norm", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = marked.withColumn("words", F.when(F.col("hit"), F.split(low, " ")))
    # places of the base phrases
    found = found.withColumn("spots", F.expr(f"flatten(transform({phrases}, p -> transform(filter(sequence(0, size(words) - 1), i -> get(words, i) = p.words[0] and slice(words, i + 1, size(p.words)) = p.words), i -> struct(i, p.label as label))))"))
    # the anchors in the file, their places, and the alignments that the postings name
    found = found.withColumn("look", F.expr(f"array_intersect({_literal(anchors) if anchors else 'cast(array() as array<string>)'}, words)"))
    found = found.withColumn("places", F.expr("flatten(transform(look, l -> transform(filter(sequence(0, size(words) - 1), i -> words[i] = l), i -> struct(l as w, i as i))))"))
    found = found.withColumn("starts", F.expr(f"array_distinct(flatten(transform(places, x -> transform({index}[x.w], q -> struct(q.t as t, x.i - q.p as at)))))"))
    kept = f"filter(starts, s -> slice(words, greatest(s.at + {table}[s.t].at, 0) + 1, size({table}[s.t].key)) = {table}[s.t].key and s.at + {table}[s.t].at >= 0)"
    share = f"transform({kept}, s -> struct({table}[s.t].label as label, size(filter(transform({table}[s.t].words, (w, i) -> struct(w, s.at + i as i)), x -> x.i >= 0 and get(words, x.i) = x.w)) / size({table}[s.t].words) as share))"
    found = found.withColumn("aligned", F.expr(f"filter({share}, a -> a.share >= {enough})"))
    n_base = F.when(F.col("spots").isNull(), 0).otherwise(F.size("spots"))
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))), ",")
    base, own = F.col("spots.label"), F.col("aligned.label")
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.array_min("spots.i").cast("long").alias("first_word"),
        F.array_max("spots.i").cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, own).alias("labels"),
        F.greatest(F.coalesce(F.array_max("aligned.share"), F.lit(0.0)), F.when(n_base > 0, F.lit(enough)).otherwise(F.lit(0.0))).alias("score"),
    )


def key_at(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
