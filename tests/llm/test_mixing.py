import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import mixing

WORDS = lambda t: len((t or "").split())


def brute(rows, block, weights=None, alpha=0.7, budget=None, epochs=4):
    own = [(d, s or "", WORDS(t), int(hashlib.md5(f"mix:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)) for d, t, _, s in rows]
    total = defaultdict(int)
    for _, s, n, _ in own:
        total[s] += n
    names = sorted(s for s, t in total.items() if t and (weights is None or weights.get(s, 0) > 0))
    if not names:
        return []
    w = np.array([float(total[s]) ** alpha if weights is None else weights[s] for s in names])
    stop = np.floor(np.cumsum(w) / w.sum() * 2.0**40)
    stop[-1] = 2**40
    blocks = {s: -(-total[s] // block) for s in names}
    laid = defaultdict(list)
    for s in names:
        at = 0
        for d, _, n, h in sorted((x for x in own if x[1] == s), key=lambda x: (x[3], -(2**63) if x[0] is None else x[0])):
            b = min(at // block, blocks[s] - 1)
            laid[s, b].append((d, at - b * block, n))
            at += n
    out, used, slot = [], Counter(), 0
    while (slot < -(-budget // block)) if budget is not None else any(used[s] < blocks[s] for s in names):
        u = ((slot + 1) * mixing.PHI % 2**64) >> 24
        s = names[int(np.searchsorted(stop, u, "right"))]
        r, b = divmod(used[s], blocks[s])
        used[s] += 1
        if r < epochs:
            out += [(slot, s, r, b, o, d, n) for d, o, n in laid[s, b]]
        slot += 1
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def sourced(prose):
    rows = [(r[0], r[1], "en", ["a", "b", "hot", "hot", "hot", None][i % 6]) for i, r in enumerate(prose) if len(r[1] or "") < 5000]
    return rows + [(900, "", "en", "silent"), (901, None, "en", "silent")] + rows[:3]


@pytest.mark.parametrize("how", [{}, {"weights": {"a": 1.0, "hot": 2.0}}, {"budget": 900}, {"weights": {"none": 1.0}}])
def test_same_as_brute_force(docs, sourced, how):
    got = mixing.mix(docs(sourced), block_tokens=200, **how)
    assert got.columns == ["slot", "source", "epoch", "block", "offset", "doc_id", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(sourced, 200, **how)


def test_every_stretch_is_near_the_weights():
    stop = mixing.thresholds([0.5, 0.3, 0.15, 0.05])
    own = np.searchsorted(stop, mixing.points(np.arange(50_000)), "right")
    for n in (100, 1000, 50_000):
        for begin in (0, 50_000 - n):
            share = np.bincount(own[begin : begin + n], minlength=4) / n
            assert np.abs(share - [0.5, 0.3, 0.15, 0.05]).max() < 10 / n


def test_mixed_rows(docs, sourced):
    got = mixing.mixed(docs(sourced), block_tokens=200)
    assert got.columns == docs([]).columns
    times = Counter((r[5], r[1]) for r in brute(sourced, 200))
    have = Counter((r.doc_id, r.source or "") for r in got.collect())
    assert {k: n for k, n in have.items() if k[1] != "silent"} == times
    assert have[900, "silent"] == have[901, "silent"] == 1
    assert {(r[0], r[3] or "") for r in sourced} == set(have)  # no document is left out


def test_empty(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
    assert mixing.mix(docs([(1, None), (None, "")])).count() == 0
    assert mixing.mixed(docs([(1, None), (None, "")])).count() == 2
    assert math.isclose(mixing.thresholds([1, 1])[0] / 2**40, 0.5)


def test_a_source_far_smaller_than_the_largest_keeps_its_weight(docs):
    """Over 4 epochs of a small source, to the end of the schedule."""
    rows = [(i, "w " * 100, "en", "hot" if i < 1000 else "small") for i in range(1002)]
    slots = {r.slot: (r.source, r.epoch) for r in mixing.mix(docs(rows), block_tokens=100).collect()}
    want = 1 / (1 + 500**0.7)
    assert sorted(slots) == list(range(len(slots)))  # no slot stays empty
    small = [k for k, (source, _) in slots.items() if source == "small"]
    assert max(slots[k][1] for k in small) > 4 and abs(len(small) / len(slots) - want) < 2 / len(slots)
    late = [k for k in small if k >= len(slots) // 2]
    assert abs(len(late) - want * len(slots) / 2) < 3
    assert max(r.epoch for r in mixing.mix(docs(rows), block_tokens=100, max_epochs=4).collect()) == 3
