import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from termloom.llm import langid, queries

from . import test_cuckoo, test_jaccard, test_mixing


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    """Documents of two languages with copies, near copies, junk, nulls, and columns that the operators use themselves."""
    rng = random.Random(8)
    vocabulary = {"xx": [a + b for a in "ba be bi bo bu".split() for b in "la le lo".split()], "yy": [a + b for a in "zrk krz tzk".split() for b in "ma mo wen wun".split()]}
    text = lambda lang, n: " ".join("".join(rng.choice(vocabulary[lang]) for _ in range(2)) for _ in range(n))
    rows = []
    for i in range(160):
        lang = "xx" if i % 3 else "yy"
        rows.append((i, text(lang, rng.randint(5, 120)), lang, "hot" if i % 2 else f"s{i % 5}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(10)]
    for i in range(10):
        w = rows[20 + i][1].split(" ")
        w[len(w) // 2] = "baba"
        rows.append((300 + i, " ".join(w), rows[20 + i][2], None))
    rows += [(400, "12 345 !!", None, "s1"), (401, None, "xx", "s1"), (402, "", "xx", "s2"), (403, text("xx", 6000), "xx", "s3"), (None, text("yy", 30), "yy", "s1"), (404, "??", "xx", "s2"), (5, rows[5][1], rows[5][2], rows[5][3])]
    path = tmp_path_factory.mktemp("data")
    docs(rows).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_and_run_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs)
    lang, conf = model.predict([(t or "").encode() for _, t, *_ in rows])
    want = [r for r, i, p in zip(rows, lang, conf) if i >= 0 and p >= model.threshold]
    assert {r[0] for r in want} >= set(range(160)) and not {400, 401, 402, 404} & {r[0] for r in want}
    step = pipeline.STAGES[0][1](spark, docs, path)
    first = {}
    key = lambda r: (-(2**63) if r[0] is None else r[0])
    assert step.columns == docs.columns and Counter((r.doc_id, r.text) for r in step.collect()) == Counter(r[:2] for r in want)
    for r in sorted(want, key=key):
        first.setdefault(r[1], r)
    want = list(first.values())
    pairs = test_jaccard.brute([r[:2] for r in want], 0.5)
    group = test_jaccard.groups(pairs)
    want = [r for r in want if r[0] is None or group.get(r[0], r[0]) == r[0]]
    assert len(first) > len(want) > 150
    total = defaultdict(int)
    for r in want:
        total[r[3] or ""] += len(r[1].split())
    times = Counter((r[5], r[1]) for r in test_mixing.brute(want, 16384))
    times = {(r[0], r[3] or ""): times[r[0], r[3] or ""] for r in want}
    assert min(times.values()) >= 1
    tokens = Counter()
    for r in want:
        tokens[r[0]] += times[r[0], r[3] or ""] * len(r[1].split())
    got = pipeline.run(spark, path).collect()
    load, have = Counter(), Counter()
    for r in got:
        load[r.bin] += r.n_tokens
        have[r.doc_id] += r.n_tokens
    assert have == tokens and max(load.values()) <= 2048


def test_every_stage_takes_what_it_may_get(spark, docs):
    odd = docs([(None, None), (1, ""), (1, ""), (2, " ")])
    for table in (docs([]), odd):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, "nowhere")
            assert out.columns == table.columns or name == "best-fit packing"
            assert out.count() <= 4
    assert pipeline.STAGES[2][1](spark, odd, "").count() == pipeline.STAGES[3][1](spark, odd, "").count() == 4


def test_registered():
    names = {n: q for n, q in queries.QUERIES.items()}
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.SQL) <= set(names)
    assert len(pipeline.STAGES) == 5 and test_cuckoo.brute([]) == ([], {})
