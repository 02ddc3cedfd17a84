import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import packing


def test_patterns_fill_a_bin():
    got = packing.patterns(12, 3)
    want = {tuple(sorted((a, b, c), reverse=True)) for a in range(1, 13) for b in range(13) for c in range(13) if a + b + c == 12}
    assert {p + (0,) * (3 - len(p)) for p in got} == want and len(got) == len(want)


def test_non_negative_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.normal(size=8)
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-7).all() and np.abs(g * x).max() < 1e-7  # the conditions of an optimum


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    h = np.concatenate([[0], rng.integers(0, 500, packing.LEVELS)])
    bins = packing.plan(h)
    have = Counter()
    for levels, n in bins:
        assert sum(levels) <= packing.LEVELS and n > 0
        for x in levels:
            have[x] += n
    assert all(have[i] == h[i] for i in range(len(h)))
    used = sum(n for _, n in bins)
    assert used <= 1.1 * (h * np.arange(len(h))).sum() / packing.LEVELS + 3


def test_bins(docs, prose):
    rows = prose + [(900, "w " * 300)] * 2
    got = packing.pack(docs(rows), 128).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r.bin] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.offset, r.n_tokens))
    assert max(load.values()) <= 128
    tokens = Counter()
    for d, t, *_ in rows:
        tokens[d] += len((t or "").split())
    assert {d: sum(n for *_, n in p) for d, p in pieces.items()} == dict(tokens)
    for p in pieces.values():
        assert all(o == 128 * i and (n == 128 or True) for i, o, n in p)
    assert sorted(n for *_, n in pieces[900]) == [44, 44, 128, 128, 128, 128]
    assert len(load) <= 1.15 * sum(tokens.values()) / 128 + 5
    assert sorted(load) == list(range(len(load)))


def brute(rows, context):
    """Bins filled one by one with the next piece of each level that they ask for."""
    width = context // packing.LEVELS
    waiting, histogram = defaultdict(list), np.zeros(packing.LEVELS + 1, np.int64)
    for d, t, *_ in rows:
        n = len(re.findall(r"[^ \t\n\r\f\x0B]+", t or ""))
        for piece in range(max(1, math.ceil(n / context))):
            own = min(context, n - piece * context)
            level = max(1, math.ceil(own / width))
            i = -(2**63) if d is None else d
            h = int(hashlib.md5(f"pack:{i}:{piece}".encode()).hexdigest()[:15], 16)
            waiting[level].append((h, i, piece, own, d))
            histogram[level] += 1
    for own in waiting.values():
        own.sort(key=lambda x: x[:4], reverse=True)
    out, number = [], 0
    for levels, times in packing.plan(histogram):
        for _ in range(times):
            for x in levels:
                _, _, piece, own, d = waiting[x].pop()
                out.append((number, d, piece, piece * context, own))
            number += 1
    assert not any(waiting.values())
    return sorted(out, key=str)


def test_same_bins_as_brute_force(docs, prose):
    """As sets of pieces by bin: which of the equal places of a level in a bin a piece takes doesn't matter."""
    rows = prose + [(900, "w " * 300)] * 2 + [(1000 + i, "v " * (i % 140)) for i in range(700)]
    got = [tuple(r) for r in packing.pack(docs(rows), 128).collect()]

    def loads(out):
        bins = defaultdict(list)
        for b, *_, n in out:
            bins[b].append(max(1, math.ceil(n / 2)))
        return Counter(tuple(sorted(x)) for x in bins.values())

    want = brute(rows, 128)
    assert loads(got) == loads(want) and Counter(r[1:] for r in got) == Counter(r[1:] for r in want)
    if all(len(set(levels)) == len(levels) for levels, _ in packing.plan(np.bincount([max(1, math.ceil(r[4] / 2)) for r in want], minlength=packing.LEVELS + 1))):
        assert sorted(got, key=str) == want


def test_best_fit_of_what_is_left():
    """Against filling one bin after the other, the largest piece that fits first."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        h = np.concatenate([[0], rng.integers(0, 4, packing.LEVELS)])
        left = h.copy()
        a = packing.plan(h)
        fitted = [(p, n) for p, n in a if sum(p) == packing.LEVELS and len(p) <= 3]
        want, have = [], left.copy()
        # The bins that patterns gave come first; those after them are what best fit makes of the rest.
        k = 0
        while k < len(a) and a[k] in fitted:
            for x in a[k][0]:
                have[x] -= a[k][1]
            k += 1
        for p, n in a[k:]:
            for _ in range(n):
                rest, own = packing.LEVELS, []
                while (fits := [x for x in range(rest, 0, -1) if have[x]]):
                    own.append(fits[0])
                    have[fits[0]] -= 1
                    rest -= fits[0]
                want.append(tuple(own))
        assert [p for p, n in a[k:] for _ in range(n)] == want and not have.any()


def test_empty(docs):
    assert packing.pack(docs([])).count() == 0
    assert [tuple(r)[1:] for r in packing.pack(docs([(None, None)])).collect()] == [(None, 0, 0, 0)]
    with pytest.raises(ValueError):
        packing.pack(docs([]), 100)
