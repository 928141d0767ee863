import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandloom.llm import queries
from strandloom.llm.conversation_repair import END, back, repair_conversations, solve
from tests import oracle


def conversations(rng):
    texts = ["Yes.", "What now?", "no stop", " ", "", "x!", "It ends. \n", "\x85", "é.", "third, "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", "assist"]
    rows = []
    for conv in [None, *range(-3, 70)]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 12])):
            role = roles[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn + rng.randrange(2) * rng.randrange(3), role, rng.choice(texts)))
    rows += [(500, t // 2 if t % 7 else None, rng.choice(roles[:3]), rng.choice(texts) + str(t % 40)) for t in range(300)]
    rows += [(501, 4, "user", "the same.")] * 60 + [(502, None, None, None), (502, None, "user", None), (503, 2**40, "user", "a."), (503, -(2**40), None, "b.")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("conversations")
    rows = conversations(random.Random(5))
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))), f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("partitions", ["1", "23"])
def test_equals_sql_on_odd_rows(spark, folder, monkeypatch, partitions):
    """Long conversations, ties, repeats, nulls and strange roles, in one range and cut into many."""
    monkeypatch.setattr(oracle, "SF", folder)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        oracle.same_rows(spark, queries.op12_conversation_repair, queries.oracle_sql()["op12_conversation_repair"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def cheapest(kinds):
    """(cost, least audit) by trying every edit from every state, shortest costs first."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {(0, 0): (0, "")}
    done = {}
    while best:
        at = min(best, key=lambda k: best[k])
        cost, audit = done[at] = best.pop(at)
        i, q = at
        moves = [(2, "I", i, step.get((q, r))) for r in "ua"]
        if i < len(kinds):
            initial, fault = "sua?"[kinds[i] // 4], kinds[i] % 4
            moves.append((3, "D", i + 1, q))
            if fault < 2:
                moves.append((fault, "K", i + 1, step.get((q, initial))))
                moves += [(2 + fault, "R", i + 1, step.get((q, r))) for r in "ua"]
        for price, letter, i2, q2 in moves:
            new = (cost + price, audit + letter)
            if q2 is not None and (i2, q2) not in done and new < best.get((i2, q2), (10**9, "")):
                best[i2, q2] = new
    return min(done[k] for k in done if k[0] == len(kinds) and k[1] in (0, 3))


def test_layers_give_the_least_cheapest_audit():
    rng = random.Random(2)
    every = [bytes(x) for n in range(4) for x in itertools.product(range(16), repeat=n)]
    for kinds in every[::7] + [bytes(rng.randrange(16) for _ in range(rng.randrange(4, 30))) for _ in range(400)]:
        cost, steps, tail = solve(kinds)
        assert (cost, "".join(x for x, _ in steps) + tail) == cheapest(kinds)


def test_states_are_never_further_apart_than_a_word_holds():
    seen, new = set(), {END}
    while new:
        word = new.pop()
        seen.add(word)
        assert word >> 28 == 15 and word & 15
        new |= {back(word, k)[0] for k in range(16)} - seen
    assert len(seen) < 256  # solve() keeps one byte a turn


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "conv long, turn long, role string, text string, live boolean, run int, cost string")
    assert repair_conversations(none).collect() == []
    row = spark.createDataFrame([("x", 0, "user", "Hi.", True, 7, "kept"), ("x", 1, "assistant", "Yes.", True, 7, "kept")], "conv string, turn long, role string, text string, live boolean, run int, cost string")
    assert [(r["id"], r["cost"], r["audit"]) for r in repair_conversations(row, "id").collect()] == [("x", 0, "KK")]
