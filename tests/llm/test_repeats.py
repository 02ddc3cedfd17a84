import re
from collections import defaultdict

import numpy as np
import pytest

from termloom.llm import anchors, suffixes

WORD = re.compile(r"[^ \t\n\r\f\x0B]+")


def brute(rows, least):
    """Every window of every text, by its words."""
    texts = sorted({(d if d is not None else -(2**63), t) for d, t, *_ in rows if t is not None})
    places = defaultdict(list)
    words = [WORD.findall(t) for _, t in texts]
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((k, i))
    found = {}
    for p in places.values():
        if len({k for k, _ in p}) > 1:
            for x in p:
                found[x] = min(p)
    out = []
    for k, i in sorted(found):
        c = found[k, i]
        if out and out[-1][0] == k and out[-1][1] + out[-1][2] == i and (out[-1][3], out[-1][4] + out[-1][2]) == c:
            out[-1][2] += 1
        else:
            out.append([k, i, 1, *c])
    name = lambda k: None if texts[k][0] == -(2**63) else texts[k][0]
    return sorted(((name(k), s, n + least - 1, name(c), q) for k, s, n, c, q in out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("module", [anchors, suffixes])
@pytest.mark.parametrize("least", [50, 21])
def test_same_as_brute_force(docs, prose, module, least):
    want = brute(prose, least)
    assert len(want) > 10
    assert rows_of(module.repeats(docs(prose), least)) == want


def test_small_buckets_and_cut_ties(docs, prose):
    """So many buckets that copies of one passage are cut by boundaries."""
    rows = prose + [(1000 + i, prose[60][1]) for i in range(40)]
    assert rows_of(suffixes.repeats(docs(rows), 50, per_bucket=20)) == brute(rows, 50)


@pytest.mark.parametrize("module", [anchors, suffixes])
def test_nothing_to_find(docs, module):
    assert module.repeats(docs([])).count() == 0
    assert module.repeats(docs([(1, None), (None, None), (2, ""), (3, "a b c")])).count() == 0
    with pytest.raises(ValueError):
        module.repeats(docs([]), 5)


def test_multikey():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, k, 5000) for k in (3, 5, 2, 1000)]
    assert (suffixes.multikey(columns, small=8) == np.lexsort(columns[::-1])).all() or all((c[suffixes.multikey(columns, small=8)] == c[np.lexsort(columns[::-1])]).all() for c in columns)


def brute_within(rows, least):
    """Windows at two places of any kind; those in one document apart from the others."""
    texts = sorted({(d if d is not None else -(2**63), t) for d, t, *_ in rows if t is not None})
    places = defaultdict(list)
    for k, (_, t) in enumerate(texts):
        w = WORD.findall(t)
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((k, i))
    found = {x: (*min(p), len({k for k, _ in p}) == 1) for p in places.values() if len(p) > 1 for x in p}
    out = []
    for k, i in sorted(found):
        c, q, own = found[k, i]
        if out and out[-1][0] == k and out[-1][1] + out[-1][2] == i and out[-1][3:] == [c, q - out[-1][2], own]:
            out[-1][2] += 1
        else:
            out.append([k, i, 1, c, q, own])
    name = lambda k: None if texts[k][0] == -(2**63) else texts[k][0]
    return sorted(((name(k), s, n + least - 1, name(c), q, own) for k, s, n, c, q, own in out), key=str)


@pytest.mark.parametrize("how", ["anchors", "suffixes", "cut"])
def test_repeats_within_a_document(docs, prose, how):
    """A passage twice in one text alone, one that is also elsewhere, and one so often that boundaries cut it."""
    far = " ".join(f"v{i}" for i in range(70))
    rows = prose + [(200, f"{far} x {prose[0][1]} {far} y"), (201, f"a {prose[60][1]} b {prose[60][1]}"), (202, f"{prose[1][1]} {far[:-4]}")]
    rows += [(203, " z ".join([" ".join(f"u{i}" for i in range(55))] * 40))]
    want = brute_within(rows, 50)
    assert {r[0] for r in want if r[5]} >= {140, 200, 203} and any(not r[5] for r in want)
    got = anchors.repeats(docs(rows), within=True) if how == "anchors" else suffixes.repeats(docs(rows), per_bucket=20 if how == "cut" else None, within=True)
    assert got.columns[-1] == "within" and rows_of(got) == want
    assert sorted((r[:5] for r in want if not r[5]), key=str) == brute(rows, 50)


@pytest.mark.parametrize("within", [False, True])
def test_hot_passages(docs, prose, within):
    """A passage that is in many texts, twice in some, and so often that its windows are not gathered."""
    rows = prose + [(1000 + i, f"{i} " + " ".join(prose[60][1].split()[: 70 - i]) + (f" {i} " + prose[60][1]) * (i % 4 == 0)) for i in range(30)]
    want = (brute_within if within else brute)(rows, 50)
    for hot_from in (2, 10):
        assert rows_of(anchors.repeats(docs(rows), within=within, hot_from=hot_from)) == want
