"""Conversation repair: the cheapest edits that give a conversation's turns the roles `(s?(ua)+)?`.

Wu-Manber-style cost layers.  A grammar state is what the turns so far have left: nothing, a system turn, a user turn or
an assistant turn.  For every place between turns, layer d is the bitset of states from which the turns after it can be
brought to an accepted end at cost d or less; eight layers of four bits are one word, relative to the lowest layer that
isn't empty, since no two states are more than five apart.  Shifts and masks carry a word back over a turn; all layers
at once.  The first layer that holds the empty state at the front gives the cost, and a trace of bits forward, by
letters in order of ASCII, gives the least of the cheapest audits.

Rows are sorted by ranges of (conversation, turn, role, digest of the text), so a conversation of any length is spread over
tasks.  Conversations inside a range are finished where they are read.  Those at a range's edges, two a range, may have
parts in other ranges: first occurrences are settled by a grouped minimum (of a key each range sends its first row alone),
one byte a turn is gathered for the layers (as long as the audit, which is one value of the result), and the texts are
hashed in order in a stream that holds a batch at a time, as the checksum is one of the whole conversation.

Edge cases: a null role or text is one space, so is a null in the key that damage goes by; null turns come first and are
no part of the gaps; rows of one turn go by role, then by SHA-256 of the text; a null conversation id is a conversation of
its own.  Roles count by their first letter; one that isn't s, u or a is deleted or changed.  Repeated rows are duplicates.  A
span of turns over 2**63 - 1 counts as that.  Conversations without rows after damage have zeros.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bound_batches, materialize

#: Bytes of rows in a range.
RANGE = 16 << 20
COSTS = {"keep": 0, "truncated": 1, "rerole": 2, "insert": 2, "delete": 3}
START, SYSTEM, USER, ASSISTANT = range(4)
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
_INITIALS = "sua"
_SPACE = " \t\n\v\f\r"
_LAYERS = 8
_ALL = (1 << 4 * _LAYERS) - 1
_STATE = [int("1" * 2 * _LAYERS, 16) << q for q in range(4)]
#: The state after a user or assistant turn where the grammar wants one, for Insert and Rerole.
_NEXT = (USER, USER, ASSISTANT, USER)


def _before_wanted(word: int) -> int:
    """States from which the turn that the grammar wants leads into the word's states, layer by layer."""
    user, assistant = word & _STATE[USER], word & _STATE[ASSISTANT]
    return user >> 2 | user >> 1 | user << 1 | assistant >> 1


def _closed(word: int) -> int:
    """The word with higher layers holding the lower ones, and with insertions."""
    while True:
        more = word | word << 4 | _before_wanted(word) << 4 * COSTS["insert"]
        more &= (1 << 8 * _LAYERS) - 1
        if more == word:
            return word
        word = more


END = _closed(1 << START | 1 << ASSISTANT) & _ALL


def _kept(word: int, initial: int) -> int:
    """States from which a turn with this initial leads into the word's states."""
    if initial == 0:
        return (word & _STATE[SYSTEM]) >> 1
    user = word & _STATE[USER]
    return user >> 2 | user >> 1 | user << 1 if initial == 1 else (word & _STATE[ASSISTANT]) >> 1 if initial == 2 else 0


@lru_cache(4096)
def back(word: int, kind: int) -> tuple[int, int]:
    """(word before a turn of this kind, cost of its lowest layer) from the word behind it; kind: 4 * initial + fault."""
    initial, fault = divmod(kind, 4)
    out = word << 4 * COSTS["delete"]
    if fault < BLANK:
        more = COSTS["truncated"] * (fault == TRUNCATED)
        out |= _kept(word, initial) << 4 * (COSTS["keep"] + more) | _before_wanted(word) << 4 * (COSTS["rerole"] + more)
    out = _closed(out)
    base = ((out & -out).bit_length() - 1) // 4
    return out >> 4 * base & _ALL, base


def _layer(word: int, state: int) -> int:
    """The first layer with the state."""
    bits = word & _STATE[state]
    return ((bits & -bits).bit_length() - 1) // 4


@lru_cache(16384)
def forward(word: int, kind: int, state: int) -> tuple[str, int]:
    """(least cheapest letters up to and with this turn, state after it); word: the one behind the turn."""
    (front, base), (initial, fault), letters = back(word, kind), divmod(kind, 4), ""
    more = COSTS["truncated"] * (fault == TRUNCATED)
    while True:
        left = base + _layer(front, state)
        if left == COSTS["delete"] + _layer(word, state):
            return letters + "D", state
        if left == COSTS["insert"] + base + _layer(front, _NEXT[state]):
            letters, state = letters + "I", _NEXT[state]
            continue
        after = (SYSTEM if state == START else None, USER if state != USER else None, ASSISTANT if state == USER else None, None)[initial]
        if fault < BLANK and after is not None and left == COSTS["keep"] + more + _layer(word, after):
            return letters + "K", after
        return letters + "R", _NEXT[state]


def solve(kinds: bytes) -> tuple[int, list[tuple[str, int]], str]:
    """(cost, for each turn its letters and the state before them, letters after the last turn)."""
    words, seen, word, cost = bytearray(len(kinds)), {}, END, 0
    for i in range(len(kinds) - 1, -1, -1):
        words[i] = seen.setdefault(word, len(seen))
        word, base = back(word, kinds[i])
        cost += base
    cost, state, out, every = cost + _layer(word, START), START, [], list(seen)
    for i, kind in enumerate(kinds):
        letters, after = forward(every[words[i]], kind, state)
        out.append((letters, state))
        state = after
    return cost, out, "I" * (_layer(END, state) // COSTS["insert"])


def _initial(role: str) -> int:
    return _INITIALS.find(role[0]) % 4 if role else 3


def kind_of(role: str, text: str) -> int:
    """4 * initial + fault of a turn that is no duplicate."""
    ink = text.rstrip(_SPACE)
    return 4 * _initial(role) + (BLANK if not ink else OK if ink[-1] in ".!?" else TRUNCATED)


def _illegal(kinds: bytes) -> int:
    initials = [k // 4 for k in kinds]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))


def _summary(kinds: bytes, low: int | None, high: int | None, distinct: int, cost: int) -> dict:
    gaps = min(high - low + 1 - distinct, 2**63 - 1) if distinct else 0
    faults = [k % 4 for k in kinds]
    return {"gaps": gaps, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": _illegal(kinds), "cost": cost}


def repaired(letters: str, state: int, role: str, text: str) -> Iterator[str]:
    """The turns that the letters of one turn leave, from the state before them."""
    for letter in letters:
        if letter == "K":
            yield f"{role}:{text}"
        elif letter != "D":
            state = _NEXT[state]
            yield ("user" if state == USER else "assistant") + ":" + (text if letter == "R" else "")


class Digest:
    """SHA-256 of lines joined by line feeds, taken one at a time."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, lines: Iterable[str]) -> None:
        for line in lines:
            self.hash.update((("\n" if self.any else "") + line).encode())
            self.any = True


def whole(rows: list[tuple]) -> dict:
    """Result of a conversation whose (turn, role, text) are all here, in order."""
    seen, kinds = set(), bytearray()
    for _, role, text in rows:
        kind = kind_of(role, text)
        if kind % 4 != BLANK and (role, text) in seen:
            kind += DUPLICATE - kind % 4
        seen.add((role, text))
        kinds.append(kind)
    cost, steps, tail = solve(bytes(kinds))
    digest = Digest()
    for (letters, state), (_, role, text) in zip(steps, rows, strict=True):
        digest.add(repaired(letters, state, role, text))
    end = forward_end(bytes(kinds), steps)
    digest.add(repaired(tail, end, "", ""))
    turns = {t for t, _, _ in rows if t is not None}
    out = _summary(bytes(kinds), min(turns, default=None), max(turns, default=None), len(turns), cost)
    return out | {"audit": "".join(x for x, _ in steps) + tail, "repaired_sha256": digest.hash.hexdigest()}


def forward_end(kinds: bytes, steps: list[tuple[str, int]]) -> int:
    """The state after the last turn."""
    if not steps:
        return START
    letters, state = steps[-1]
    for letter in letters:
        if letter == "K":
            state = (SYSTEM, USER, ASSISTANT)[kinds[-1] // 4]
        elif letter != "D":
            state = _NEXT[state]
    return state


_RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
_RAW = {"run": "int", "seq": "long", "turn": "long", "role": "string", "text": "string", "digest": "string", "live": "boolean", "fresh": "boolean", "kind": "int"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _types(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def _batch(rows: list[dict], fields: dict[str, str], key: pa.DataType) -> pa.RecordBatch:
    arrays = [pa.array([r.get("conv") for r in rows], key)] + [pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["conv", *fields])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and live of the rows after damage by a checksum of `conv:turn`; dropped rows aren't live."""
    text_ = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")), F.lit(20))
    out = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), name(role).alias("role"), text_.alias("text"), code.alias("code"))
    out = out.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    less = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.select("conv", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), less.alias("text"), (F.col("code") != 0).alias("live"))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside a sorted range; the rows of its first and last one as they are."""
    run, fields = TaskContext.get().partitionId(), _RAW | _RESULT
    held: list[dict] = []
    conv, first, key, seq, seen = None, None, pa.int64(), 0, set()

    def closed() -> dict:
        return {"conv": conv} | whole([(r["turn"], r["role"], r["text"]) for r in held if r["live"]])

    for batch in batches:
        out, key = [], batch.schema.field("conv").type
        for row in batch.to_pylist():
            if first is None or row["conv"] != conv:
                if first is False:
                    out.append(closed())
                first, conv, held, seen = first is None, row["conv"], [], set()
            row |= {"run": run, "seq": (seq := seq + 1), "kind": kind_of(row["role"], row["text"]), "fresh": row["live"] and (row["role"], row["digest"]) not in seen}
            if row["live"]:
                seen.add((row["role"], row["digest"]))
            (out if first else held).append(row)
        yield _batch(out, fields, key)
    if first is False:
        for a in range(0, len(held), 1000):
            yield _batch(held[a : a + 1000], fields, key)


def _part(table: pa.Table) -> pa.Table:
    """One byte a turn, and the turns' numbers, of the part of a conversation in a range."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    kinds = bytes(k if not r["again"] or k % 4 == BLANK else k - k % 4 + DUPLICATE for r in rows if r["live"] for k in (r["kind"],))
    turns = {r["turn"] for r in rows if r["live"] and r["turn"] is not None}
    row = {"conv": rows[0]["conv"], "run": rows[0]["run"], "kinds": kinds, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(turns)}
    return pa.Table.from_batches([_batch([row], _PART, table.schema.field("conv").type)])


_PART = {"run": "int", "kinds": "binary", "low": "long", "high": "long", "turns": "long"}
_STEP = {"run": "int", "seq": "long", "role": "string", "text": "string", "live": "boolean", "state": "int", "steps": "string"} | {k: t for k, t in _RESULT.items() if t == "long"}


def _audited(table: pa.Table) -> pa.Table:
    """For each part of a conversation its letters, a line a turn, and the state before them; sums with the first part."""
    parts = sorted(table.to_pylist(), key=lambda r: r["run"])
    kinds = b"".join(p["kinds"] for p in parts)
    cost, steps, tail = solve(kinds)
    distinct = sum(p["turns"] for p in parts)
    numbered = [p for p in parts if p["turns"]]
    distinct -= sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:], strict=False))
    total = _summary(kinds, numbered[0]["low"] if numbered else None, numbered[-1]["high"] if numbered else None, distinct, cost)
    rows, at = [], 0
    for p in parts:
        own = steps[at : at + len(p["kinds"])]
        at += len(own)
        rows.append({"conv": p["conv"], "run": p["run"], "seq": 0, "state": own[0][1] if own else START, "steps": "\n".join(x for x, _ in own), "live": False} | total)
        total = {}
    if tail:
        rows.append({"conv": rows[0]["conv"], "run": 2**31 - 1, "seq": 0, "state": forward_end(kinds, steps), "steps": tail, "live": False})
    return pa.Table.from_batches([_batch(rows, _STEP, table.schema.field("conv").type)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results from turns in order, each part led by its letters."""
    conv, total, audit, digest = None, None, [], Digest()
    steps: Iterator[str] = iter(())
    state, key = START, pa.int64()

    def result() -> dict:
        return total | {"audit": "".join(audit), "repaired_sha256": digest.hash.hexdigest()}

    for batch in batches:
        key, out = batch.schema.field("conv").type, []
        for row in batch.to_pylist():
            if row["steps"] is not None:
                if row["cost"] is not None:
                    if total is not None:
                        out.append(result())
                    total, audit, digest = row, [], Digest()
                audit.append(row["steps"].replace("\n", ""))
                steps, state = iter(row["steps"].split("\n")), row["state"]
                if row["run"] == 2**31 - 1:
                    digest.add(repaired(row["steps"], state, "", ""))
            elif row["live"]:
                letters = next(steps)
                digest.add(repaired(letters, state, row["role"], row["text"]))
                state = forward_end(bytes([4 * _initial(row["role"])]), [(letters, state)])
        if out:
            yield _batch(out, _RESULT, key)
    if total is not None:
        yield _batch([result()], _RESULT, key)


def repair_conversations(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of rows with conv, turn, role, text and live: counts of faults, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    bound_batches(spark)
    kind = rows.schema["conv"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    order = ["conv", "turn", "role", "digest", "id"]
    keyed = rows.select("conv", "turn", "role", "text", "live", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("id"))
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("id")
    done = materialize(ordered.mapInArrow(_finished, f"conv {kind}, {_types(_RAW | _RESULT)}"), "conversations")
    inside = done.where(F.col("seq").isNull()).select("conv", *_RESULT)
    edge = done.where(F.col("seq").isNotNull()).select("conv", *_RAW)
    fresh = edge.where("fresh")
    first = fresh.groupBy("conv", "role", "digest").agg(F.min(F.struct("run", "seq")).alias("first")).select(*(F.col(c).alias(f"{c}_") for c in ("conv", "role", "digest")), "first")
    met = fresh.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")))
    marked = met.select("conv", *_RAW, (F.struct("run", "seq") != F.col("first")).alias("again")).unionByName(edge.where("not fresh").withColumn("again", F.col("live")))
    parts = marked.select("conv", "run", "seq", "turn", "live", "kind", "again").groupBy("conv", "run").applyInArrow(_part, f"conv {kind}, {_types(_PART)}")
    steps = parts.groupBy("conv").applyInArrow(_audited, f"conv {kind}, {_types(_STEP)}")
    turns = edge.where("live").select("conv", *(F.col(n) if n in ("run", "seq", "role", "text", "live") else F.lit(None).cast(t).alias(n) for n, t in _STEP.items()))
    stream = steps.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "run", "seq")
    across = stream.mapInArrow(_hashed, f"conv {kind}, {_types(_RESULT)}")
    return inside.unionByName(across).withColumnRenamed("conv", conv)
