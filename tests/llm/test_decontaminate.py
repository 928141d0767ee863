import random
import re

from tests.llm.conftest import corpus, prose

from strandloom.llm.decontaminate import LEAST, drop_leaks, find_leaks

ITEMS = [
    (0, "Alice walked 12 km to the market with Bob and 7 friends before the old clock struck noon again."),
    (1, "every one of the green bottles was hanging on a wall near some very quiet garden gates today"),
    (2, "Too short an item to be evidence"),
    (3, None),
    (4, "a train that leaves at 9 hours with 300 people and meets Carol at 9 hours by the river bank slowly"),
]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, enough=13):
    """Word-for-word leaks, without placeholders: the longest run that a document shares with an item on one diagonal."""
    out = set()
    for d, t in rows:
        ws = words(t)
        for k, item in ITEMS:
            xs = words(item)
            if len(xs) < LEAST:
                continue
            need = min(enough, len(xs))
            if any(ws[i : i + need] == xs[j : j + need] for i in range(len(ws) - need + 1) for j in range(len(xs) - need + 1)):
                out.add((d, k))
    return out


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_verbatim_leaks_match_brute_force(spark, documents):
    rng = random.Random(8)
    rows = corpus()
    for k in range(40):
        item = ITEMS[rng.choice([0, 1, 1, 4])][1]
        xs = item.split()
        a = rng.randrange(0, 4)
        part = " ".join(xs[a : a + rng.choice([8, 12, 13, 14, 20])])
        part = rng.choice([str, str.upper, lambda s: s.replace(" ", " \n "), lambda s: s + "!!"])(part) if item is ITEMS[1][1] else part
        rows.append((2000 + k, f"{prose(rng, rng.randrange(30))}. {part} {prose(rng, rng.randrange(30))}"))
    got = find_leaks(documents(rows), items(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(rows) and len(got) > 15
    kept = drop_leaks(documents(rows), items(spark))
    assert kept.columns == documents(rows).columns
    gone = {d for d, _ in brute(rows)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in gone)


def test_other_parameters_are_caught_if_slots_agree(spark, documents):
    rows = [
        (1, "so today Dave walked 99 km to the market with Eve and 3 friends before the old clock struck noon again."),
        (2, "a train that leaves at 4 hours with 17 people and meets Frank at 4 hours by the river bank slowly"),
        (3, "a train that leaves at 4 hours with 17 people and meets Frank at 5 hours by the river bank slowly"),
        (4, "a train that leaves at 4 hours with 4 people and meets Frank at 4 hours by the river bank slowly"),
        (5, "a bus that leaves at 4 hours with 17 people and greets Frank at 4 hours by the river bank slowly"),
        (6, None),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(documents(rows), items(spark)).collect()}
    assert set(got) == {(1, 0), (2, 4)}
    assert got[1, 0]["slots"] == 4 and got[1, 0]["first_word"] == 3 and got[2, 4]["matched_words"] == got[2, 4]["item_words"]


def test_empty_tables(spark, documents):
    assert find_leaks(documents([]), items(spark)).collect() == []
    assert find_leaks(documents([(1, ITEMS[1][1])]), items(spark, [])).collect() == []
    assert drop_leaks(documents([(1, ITEMS[1][1])]), items(spark, [])).count() == 1


def test_items_full_of_slots_and_short_items_are_caught(spark, documents):
    slots, short = "Compute 3 x 4 + 12 x 5 + 7 x 9 + 2 x 6", "Name the capital of Peru"
    rows = [(k, f"{'so ' * k}{slots} now") for k in range(5)] + [(5, f"please {short.lower()}, now"), (6, "name the capital of Chad"), (7, "Peru")]
    got = find_leaks(documents(rows), items(spark, [(0, slots), (1, short), (2, "Add 3 and 4")])).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, 0) for k in range(5)} | {(5, 1)}


def test_a_verbatim_run_is_caught_though_slots_around_it_disagree(spark, documents):
    item = "the red train leaves at 9 hours from the very old and quiet station near the river and comes home at 9 hours"
    two = f"{item} while one of seven small birds sings a song of 5 trees and 4 green hills by the lake"
    rows = [
        (1, item[: -len("9 hours")] + "5 hours"),
        (2, two.replace("train leaves at 9", "train leaves at 8").replace("while one", "while two").replace("5 trees", "6 trees")),
        (3, item.replace("from the very", "from a very").replace("near the", "by the").replace("comes home at 9", "comes home at 5")),
    ]
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in find_leaks(documents(rows), items(spark, [(0, item), (1, two)])).collect()}
    assert got[1, 0] == 21 and {d for d, _ in got} == {1, 2}


def test_names_at_starts_of_sentences_and_lines_are_slots(spark, documents):
    item = "Tom has 3 red apples and 5 green pears. Tom eats 2 apples and buys 4 plums. Tom gives Mary 6 nuts."
    told = item.replace("Tom", "Anna").replace("Mary", "Paul")
    rows = [
        (1, told),
        (2, told.replace("5", "8").replace(". ", ".\n  ")),
        (3, told.replace("gives ", "gives\n")),
        (4, item.replace("Tom gives", "Ben gives").replace("Tom eats", "Anna eats").replace("Mary", "Paul")),
        (5, item.lower()),
    ]
    got = find_leaks(documents(rows), items(spark, [(0, item)])).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 5}


def test_lists_of_numbers_leak_only_with_the_same_numbers(spark, documents):
    """Placeholders alone are no leak, and a table of numbers costs no more than its length."""
    numbers = lambda a, n: " ".join(map(str, range(a, a + n)))
    tested = [(k, f"What is the total of {numbers(100 * k + 11, 40)}") for k in range(20)]
    rows = [(1, f"Sales by month {numbers(50_001, 20)}"), (2, f"Sales by month {numbers(50_001, 20_000)}"), (3, f"so {numbers(111, 15)} it is"), (4, f"Find {numbers(60_001, 9)} and the sum of those numbers")]
    got = find_leaks(documents(rows), items(spark, [*tested, (50, f"Find {numbers(11, 9)} and the mean of these figures")])).collect()
    assert [(r["doc_id"], r["item_id"], r["matched_words"]) for r in got] == [(3, 1, 15)]
    assert drop_leaks(documents(rows), items(spark, tested)).count() == 3


def test_an_item_that_stands_in_a_text_many_times(spark, documents):
    rows = [(1, f"{ITEMS[1][1]}. " * 400), (2, f"{ITEMS[0][1]} " * 3)]
    got = find_leaks(documents(rows), items(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 0)}
