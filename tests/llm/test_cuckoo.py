import random

import pytest

from termloom.llm import cuckoo


def brute(rows):
    first, out = {}, []
    low = lambda d: -(2**63) if d is None else d
    for d, t, *_ in sorted(rows, key=lambda r: low(r[0])):
        if t is None:
            out.append((d, None, True))
        elif t in first:
            out.append((d, first[t], False))
        else:
            first[t] = d
            out.append((d, None, True))
    return sorted(out, key=str), first


@pytest.mark.parametrize("size", [16, 1])
def test_same_as_brute_force(docs, prose, size):
    """With digests of one byte texts collide, and are told apart by content."""
    got = sorted(map(tuple, cuckoo.duplicates(docs(prose), size).collect()), key=str)
    assert got == brute(prose)[0]


@pytest.mark.parametrize("size", [16, 1])
def test_deduplicated(docs, prose, size):
    got = cuckoo.deduplicated(docs(prose), size)
    assert got.columns == docs([]).columns
    want = [(d, t) for t, d in brute(prose)[1].items()] + [(d, t) for d, t, *_ in prose if t is None]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_index_under_insertion_and_deletion():
    rng, index, live = random.Random(4), cuckoo.CuckooIndex(groups=2), {}
    keys = [rng.randbytes(16) for _ in range(3000)]
    for step in range(20000):
        k = rng.choice(keys)
        if k in live and rng.random() < 0.4:
            assert index.delete(k)
            del live[k]
        else:
            assert index.get(k) == live.get(k)
            if k not in live:
                live[k] = step
                index.insert(k, step)
    assert index.resizes > 3 and index.size == len(live)
    assert all(index.get(k) == live.get(k) for k in keys)
    assert not index.delete(b"x" * 16)


def test_deletion_frees_a_digest(spark):
    events = [(1, "+", 10, b"a" * 16), (2, "+", 11, b"a" * 16), (3, "-", 11, b"a" * 16), (4, "-", 10, b"a" * 16), (5, "+", 12, b"a" * 16), (6, "+", 10, b"a" * 16)]
    got = cuckoo.apply_events(spark.createDataFrame(events, "_seq bigint, _op string, _d bigint, _g binary"), 4).orderBy("_seq").collect()
    assert [r._first for r in got] == [10, 10, 10, 10, 12, 12]


def test_nothing(docs):
    assert cuckoo.duplicates(docs([])).count() == 0 and cuckoo.deduplicated(docs([])).count() == 0
