import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _d bigint, _k string, _g int, row string, count bigint, kept string, slot int"


def make(spark, rows):
    """Rows (doc_id, text[, lang, source]) with columns whose names the operators use themselves."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, 5, "k", 1, "row", 9, "x", None) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture(scope="session")
def prose():
    """Seeded texts with copies, near copies, shared passages, repeats within a text, empty and null ones, ties, and a very long one."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, short = text(60), text(30)
    rows = [(i, text(rng.randint(3, 200))) for i in range(60)]
    rows += [(100 + i, text(20) + " " + passage + "\n" + text(rng.randint(0, 40))) for i in range(5)]
    rows += [(110 + i, text(20) + " " + short + " " + text(20)) for i in range(3)]
    base = text(150)
    for i in range(6):
        w = base.split(" ")
        for _ in range(i * 3):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((120 + i, " ".join(w)))
    rows += [(130, base), (131, base), (3, rows[3][1])]  # copies, and a row that is there twice
    rows += [(140, text(30) + " " + " ".join([text(10)] * 20))]  # repeats itself alone
    rows += [(150, ""), (151, ""), (152, None), (153, None), (None, passage), (None, text(80)), (154, "  \n\t "), (155, "one"), (156, "one"), (157, "één ñ"), (158, text(30_000))]
    rows += [(5, text(70))]  # an id with two texts
    return rows
