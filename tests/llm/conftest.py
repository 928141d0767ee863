import random

import pytest

WORDS = [a + b for a in ("ta", "ne", "ro", "mi", "su", "ka", "lo", "vi") for b in ("n", "rt", "s", "ll", "m", "x")]
SCHEMA = "doc_id long, text string, lang string, keep__ string, kept boolean, n_words int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text) with exact and near copies, shared passages, ties, repeated rows, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows, passage, hot = [], prose(rng, 70), prose(rng, 120)
    for k in range(60):
        rows.append((k, prose(rng, rng.choice([1, 3, 4, 5, 6, 12, 40, 49, 50, 51, 80, 200]))))
    for k in range(60, 100):
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(words))
            words[i : i + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(1, 3)
        rows.append((k, " ".join(words)))
    for k in range(100, 130):
        rows.append((k, f"{prose(rng, rng.randrange(60))} {passage} {prose(rng, rng.randrange(60))}"))
    for k in range(130, 170):
        rows.append((k, hot if k % 3 else hot.replace(" ", " \n\t", 5).upper()))
    rows += [(170, None), (171, ""), (172, " \n\t "), (173, prose(rng, 9000)), (None, hot), (None, prose(rng, 55)), (175, "é ß  x\x1cy"), (176, "a " * 300)]
    rows += [rows[3], rows[101], (101, passage), (140, hot)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    def frame(rows):
        return spark.createDataFrame([(d, t, "en", "x", True, 1) for d, t in rows], SCHEMA)

    return frame
