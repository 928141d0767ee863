"""Benchmark decontamination by templates, in DataFrame functions only.

Words are canonicalised to templates: numbers, units after a number, and names (capitalised words inside a sentence)
become typed placeholders, other words are lower-cased, punctuation is dropped.  A capitalised word anywhere else, such
as at a sentence's or a line's start, is hashed both as a name and as itself, and is a slot in alignments that have no
leak without it.  Each document is cut into consecutive
blocks of 5 words, each benchmark item into its windows of 5 at every offset, and they meet in a hash join by their
values, so a shared run of 9 words or more always has a block that meets a window; and, if three words or more are no
slots, by their templates.  Blocks that are mostly slots, such as those of a list of numbers, meet their like only with the same
values.  Where they met, the whole
alignment is checked: a leak is an unbroken run of `enough` equal template words (or the whole item, if shorter) with five
words or more that are no slots, in which
each value of a slot in the item has one value in the document and the other way round, which also finds questions
whose numbers or names were exchanged; or such a run of the same words, whatever the slots in it and around it.  Every run of an
alignment is tried.

The benchmark is broadcast if its size, which is checked, allows; else the same joins are shuffled.  Blocks carry the
places of their rows, and the texts of the rows that met a window are fetched by place, so no text is shuffled to find
or to drop one.  Of a text, each alignment takes along as many words as its item has.

Edge cases: null or empty texts and items never match.  Items under 10 words must stand in the document whole and with
the same values; an item of one word leaks in every document that has the word.  Long texts are read whole.  Rows are told apart by their places, so repeated rows have lines of
their own.  Null ids are carried along.  An empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import free_names, materialize
from strandloom.llm.places import choose, placed

BLOCK, LEAST = 5, 10
#: Words that are no slots which a block needs to meet others by its template, and a run to count with other values.
PLAIN, LITERAL = 3, 5
#: A table of so many rows at most is broadcast.
MOST_BROADCAST = 200_000
#: Units that may follow a number.
UNITS = "%|°|€|\\\\$|£|km|cm|mm|m|kg|mg|g|lb|lbs|oz|ft|mi|mph|kmh|ml|l|s|sec|secs|min|mins|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|kilometers?|kilometres?|miles?|feet|inches|inch|pounds?|dollars?|euros?|cents?|grams?|kilograms?|liters?|litres?|percent|degrees?"
#: CAPITAL marks capitalised words that stand where any word may have a capital.
NAME, NUMBER, UNIT, CAPITAL = (chr(0xE000 + k) for k in range(4))
_WORD_GAP = f"[^\\p{{L}}\\p{{N}}{NAME}-{CAPITAL}]+"


def marked(text: Column, values: bool) -> Column:
    """The text with placeholders, before names and capitalised words, and before numbers and units or in their stead."""
    keep = "$0" if values else ""
    x = F.coalesce(text, F.lit(""))
    digits = F.regexp_replace(x, "[0-9]+", f" {NUMBER}{keep} ")
    digit = "[0-9]+" if values else ""
    units = F.regexp_replace(digits, f"({NUMBER}{digit}) +({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1 {UNIT}{'$2' if values else ''} ")
    x = F.when(x.rlike("[0-9]"), units).otherwise(x)
    names = F.regexp_replace(x, "\\p{Lu}(?<=[\\p{Ll},;] \\p{Lu})\\p{Ll}+(?!\\p{L})", f"{NAME}$0")
    return F.regexp_replace(names, f"(?<![\\p{{L}}{NAME}])\\p{{Lu}}\\p{{Ll}}+(?!\\p{{L}})", f"{CAPITAL}$0")


def template_words(text: Column, values: bool = False) -> Column:
    """Array of template words, names with their values; values: those of numbers and units too."""
    return F.array_remove(F.split(F.lower(marked(text, values)), _WORD_GAP), "")


def _bare(words: str) -> str:
    """SQL for the template words of an array with values; words marked by CAPITAL count as literal."""
    return f"transform({words}, w -> if(substr(w, 1, 1) in ('{NAME}', '{NUMBER}', '{UNIT}'), substr(w, 1, 1), ltrim('{CAPITAL}', w)))"


def _wide(words: str) -> str:
    """SQL for the same with every capitalised word as a name."""
    return f"transform({words}, w -> if(substr(w, 1, 1) in ('{NAME}', '{CAPITAL}'), '{NAME}', if(substr(w, 1, 1) in ('{NUMBER}', '{UNIT}'), substr(w, 1, 1), w)))"


def _template(words: str) -> str:
    """SQL for the words of an array with values as template_words gives them without: names alone have theirs."""
    return f"transform({words}, w -> if(substr(w, 1, 1) in ('{NUMBER}', '{UNIT}'), substr(w, 1, 1), w))"


def _hashes(words: str) -> str:
    """SQL for the hashes of a few template words in all forms, each capitalised word as a name and as itself.

    Equal words share the form in which both are themselves, exchanged names the one in which both are names.
    """
    name = f"substr(w, 1, 1) in ('{NAME}', '{CAPITAL}')"
    add = lambda x: f"transform(forms, f -> array_append(f, {x}))"
    forms = f"aggregate({words}, array(cast(array() as array<string>)), (forms, w) -> if({name}, concat({add(f"'{NAME}'")}, {add('substr(w, 2)')}), {add('w')}))"
    return f"if(exists({words}, w -> {name}), transform({forms}, f -> xxhash64(f)), array(xxhash64({words})))"


def _value(word: str) -> str:
    """SQL for a word with values without its placeholder."""
    return f"ltrim('{NAME}{NUMBER}{UNIT}{CAPITAL}', {word})"


def _values(words: str) -> str:
    """SQL for the words of an array with values, without placeholders."""
    return f"transform({words}, w -> {_value('w')})"


def _meeting(words: str) -> str:
    """SQL for the hashes by which the words of a block or window, with values, meet others."""
    literal = f"size(filter({words}, w -> substr(w, 1, 1) not in ('{NAME}', '{NUMBER}', '{UNIT}', '{CAPITAL}')))"
    return f"concat(array(xxhash64({_values(words)}, 1)), if({literal} >= {PLAIN}, {_hashes(_template(words))}, array()))"


def _blocks(words: str, last: str, step: int) -> str:
    """SQL for runs of BLOCK words that begin at each multiple of step up to last times step; words are made once."""
    return f"transform(array({words}), v -> if(size(v) >= {BLOCK}, transform(sequence(0, {last}), i -> slice(v, {step} * i + 1, {BLOCK})), array()))[0]"


def _runs(flags: str, need: str) -> str:
    """SQL for the unbroken runs (n, at) of at least so many true flags."""
    breaks = f"concat(array(-1), filter(sequence(0, size({flags}) - 1), j -> not {flags}[j]), array(size({flags})))"
    return f"filter(transform(array({breaks}), b -> transform(sequence(1, size(b) - 1), k -> struct(b[k] - b[k - 1] - 1 as n, b[k - 1] + 1 as at)))[0], r -> r.n >= {need})"


def _slots(run: str, marks: str) -> str:
    """SQL for the slots of a run: the item's value and the document's, which may stand there without a placeholder."""
    pairs = f"filter(arrays_zip(slice(values, {run}.at + 1, {run}.n), slice(theirs, {run}.at + 1, {run}.n)), z -> substr(z['0'], 1, 1) in ({marks}))"
    return f"transform({pairs}, z -> struct(translate(z['0'], '{CAPITAL}', '{NAME}') as mine, concat(if(substr(z['0'], 1, 1) in ('{NAME}', '{CAPITAL}'), '{NAME}', substr(z['0'], 1, 1)), {_value("z['1']")}) as theirs))"


def _agree(slots: str) -> str:
    """SQL for whether each value of the item has one in the document and the other way round."""
    pairs = f"size(array_distinct({slots}))"
    return f"{pairs} = size(array_distinct({slots}.mine)) and {pairs} = size(array_distinct({slots}.theirs))"


def _small(rows: DataFrame) -> bool:
    return rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_col: str, item_text: str, enough: int) -> DataFrame:
    """doc, sum (text checksum), file, row, item, won (the best run) of each row and item that leaks into it."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), template_words(F.col(f"`{item_text}`"), True).alias("values"))
    items = items.withColumn("words", F.expr(_bare("values"))).where(F.size("words") > 0)
    items = items.withColumn("wide", F.expr(_wide("values")))
    windows = items.where(F.size("words") >= LEAST).select("item", F.posexplode(F.expr(_blocks("values", f"size(v) - {BLOCK}", 1))).alias("offset", "window"))
    windows = windows.select(F.explode(F.array_distinct(F.expr(_meeting("window")))).alias("hash"), "item", "offset")
    known = F.broadcast if _small(windows) else (lambda x: x)
    few = F.broadcast if _small(items) else (lambda x: x)

    file, row = free_names(docs, "file", "row")
    rows = placed(docs, file, row).select(F.col(f"`{id_col}`").alias("doc"), F.col(file).alias("file"), F.col(row).alias("row"), F.col(f"`{text}`").alias("text"))
    cut = rows.select("file", "row", template_words(F.col("text"), True).alias("values"))
    parts = cut.select("file", "row", F.posexplode(F.expr(_blocks("values", f"size(v) div {BLOCK} - 1", BLOCK))).alias("block", "part"))
    met = parts.select("file", "row", "block", F.explode(F.expr(_meeting("part"))).alias("hash")).join(known(windows), "hash")
    lines = met.select("file", "row", "item", (F.col("block") * BLOCK - F.col("offset")).alias("shift")).distinct()

    # items under LEAST words, looked up whole with their values at every place
    short = items.where(F.size("words") < LEAST).select("item", F.size("words").alias("n"), F.expr(f"xxhash64({_values('values')})").alias("hash"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
    if lengths:
        spots = ", ".join(f"if(size(plain) >= {n}, transform(sequence(0, size(plain) - {n}), i -> struct({n} as n, i as shift, xxhash64(slice(plain, i + 1, {n})) as hash)), array())" for n in lengths)
        plain = rows.select("file", "row", template_words(F.col("text"), True).alias("values")).select("file", "row", F.expr(_values("values")).alias("plain"))
        at = plain.select("file", "row", F.explode(F.expr(f"concat({spots})")).alias("spot")).select("file", "row", "spot.*")
        lines = lines.unionByName(at.join(F.broadcast(short) if _small(short) else short, ["n", "hash"]).select("file", "row", "item", "shift")).distinct()

    # the alignments named by the join, on the whole texts of the rows that it met alone
    lengths_ = items.select("item", F.size("words").alias("n"))
    asked = materialize(lines.join(few(lengths_), "item").groupBy("file", "row").agg(F.collect_set(F.struct("item", "shift", "n")).alias("asked")), "asked")
    full = choose(rows, "file", "row", asked, tag="met").join(F.broadcast(asked) if _small(asked) else asked.hint("shuffle_hash"), ["file", "row"])
    check = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    full = full.select("doc", check.alias("sum"), "file", "row", "asked", template_words(F.col("text"), True).alias("doc_values"))
    keys = ["doc", "sum", "file", "row"]
    sides = "transform(array(doc_values), v -> transform(asked, a -> struct(a.item as item, a.shift as shift, transform(sequence(0, a.n - 1), j -> if(a.shift + j >= 0, get(v, a.shift + j), null)) as theirs)))[0]"
    each = full.select(*keys, F.explode(F.expr(sides)).alias("line")).select(*keys, "line.item", "line.shift", "line.theirs")
    beside = each.join(few(items), "item")
    beside = beside.withColumn("equal", F.expr(f"transform({_bare('theirs')}, (w, j) -> coalesce(w = words[j] and size(words) >= {LEAST} or {_value('theirs[j]')} = {_value('values[j]')}, false))"))
    # the longest unbroken run of equal template words whose slots agree, or of the same words; where there is none,
    # the longest one with all capitalised words as names
    beside = beside.withColumn("same", F.expr(f"transform(theirs, (w, j) -> coalesce({_value('w')} = {_value('values[j]')}, false))"))
    beside = beside.withColumn("close", F.expr(f"transform({_wide('theirs')}, (w, j) -> coalesce(w = wide[j] and size(words) >= {LEAST} or same[j], false))"))
    need = f"least({enough}, size(words))"
    for name, flags, marks in (("runs", "equal", f"'{NAME}', '{NUMBER}', '{UNIT}'"), ("others", "close", f"'{NAME}', '{NUMBER}', '{UNIT}', '{CAPITAL}'")):
        beside = beside.withColumn(name, F.expr(f"transform({_runs(flags, need)}, r -> struct(r.n as n, r.at as at, {_slots('r', marks)} as slots))"))
    verbatim = f"transform({_runs('same', need)}, r -> struct(r.n as n, r.at as at, {_slots('r', f"'{NAME}', '{NUMBER}', '{UNIT}'")} as slots))"
    ranked = lambda found, rank: f"transform({found}, r -> struct({rank} as rank, r.n as n, -(shift + r.at) as at, size(words) as words, size(r.slots) as slots))"
    told = f"r.n - size(r.slots) >= {LITERAL} and {_agree('r.slots')}"
    strict = ranked(f"concat(filter(runs, r -> {told}), {verbatim})", 1)
    wide = ranked(f"filter(others, r -> {told})", 0)
    return beside.withColumn("found", F.expr(f"array_max(concat({strict}, {wide}))")).where("found is not null").groupBy(*keys, "item").agg(F.max("found").alias("won"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", enough: int = 13) -> DataFrame:
    """One row per leaking document and item: id, item, first_word, matched_words, item_words, slots, text_crc32."""
    best = _leaks(docs, benchmark, id_col, text, item_col, item_text, enough)
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("won.at")).cast("long").alias("first_word"), F.col("won.n").cast("long").alias("matched_words"), F.col("won.words").cast("long").alias("item_words"), F.col("won.slots").cast("long").alias("slots"), F.col("sum").alias("text_crc32")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", enough: int = 13) -> DataFrame:
    """docs without those in which an item leaks."""
    file, row = free_names(docs, "file", "row")
    whole = placed(docs, file, row)
    leaks = _leaks(whole, benchmark, id_col, text, "item_id", "text", enough).select(F.col("file").alias(file), F.col("row").alias(row)).distinct()
    return choose(whole, file, row, leaks, drop=True).select(*(F.col(f"`{c}`") for c in docs.columns))
