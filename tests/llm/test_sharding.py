import hashlib
from collections import defaultdict

import pytest

from termloom.llm import sharding


def directory(rows, limit):
    """Extendible hashing as it is defined: buckets over the limit split, one bit at a time."""
    own = [(format(int(hashlib.md5(f"shard:{'' if d is None else d}".encode()).hexdigest()[:15], 16), "060b"), d, len((t or "").encode())) for d, t, *_ in rows]
    out, todo = [], [("", own)]
    while todo:
        prefix, items = todo.pop()
        if sum(n for *_, n in items) <= limit or len(prefix) == 60:
            over = sum(n for *_, n in items) > limit
            out += [(d, n, prefix, len(prefix), over) for _, d, n in items]
            continue
        halves = defaultdict(list)
        for x in items:
            halves[x[0][: len(prefix) + 1]].append(x)
        todo += halves.items()
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000_000, 3000, 500])
@pytest.mark.parametrize("step", [None, 2])
def test_same_as_splitting(docs, prose, limit, step):
    got = sorted(map(tuple, sharding.shards(docs(prose), limit, step).collect()), key=str)
    assert got == directory(prose, limit)


def test_one_key_over_the_limit(docs):
    rows = [(7, "x" * 100)] * 3 + [(8, "y")]
    got = sharding.shards(docs(rows), 150).collect()
    assert {(r.doc_id, r.oversized) for r in got} == {(7, True), (8, False)}


def test_empty(docs):
    assert sharding.shards(docs([])).count() == 0
    assert [tuple(r) for r in sharding.shards(docs([(None, None)])).collect()] == [(None, 0, "", 0, False)]
    with pytest.raises(ValueError):
        sharding.shards(docs([]), 0)
