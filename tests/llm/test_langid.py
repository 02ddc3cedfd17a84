import math
import os

import numpy as np
import pytest

from termloom.llm import langid
from termloom.llm._common import table


@pytest.fixture(scope="module")
def model(spark, data):
    rows = sorted(table(spark, data, "documents").select("doc_id", "text", "lang").collect())
    return langid.train([r.text.encode() for r in rows[::2]], [r.lang for r in rows[::2]]), rows[1::2]


def test_held_out_accuracy(model):
    m, rows = model
    lang, conf = m.predict([r.text.encode() for r in rows])
    right = np.array([m.langs[i] == r.lang for i, r in zip(lang, rows)])
    assert right.mean() > 0.97
    assert (conf >= m.threshold).mean() > 0.97  # clean documents are kept
    assert abs(conf[conf >= m.threshold].mean() - right[conf >= m.threshold].mean()) < 0.05  # calibrated


def test_rejects_what_it_never_saw(model):
    m, _ = model
    lang, conf = m.predict([b"", b"12 34 !?", "Привет мир это русский".encode(), b"qzxj wvkq xxqz jjqk zzkx"])
    assert list(lang[:2]) == [-1, -1] and (conf[:2] == 0).all()
    assert (conf[2:] < m.threshold).all()


def test_batches_don_t_matter(model):
    m, rows = model
    texts = [r.text.encode() for r in rows[:20]] + [b"", b"a"]
    one = [m.predict([t])[1][0] for t in texts]
    assert np.allclose(m.predict(texts)[1], one, atol=1e-9)


def test_all_rows(spark, docs, data):
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, data, "documents").collect()][:60]
    rows += [(1, None, "en"), (None, "", None), (None, rows[0][1], None), (2, "7 8 9", "de"), (3, rows[1][1] * 50, None)] + rows[:2]
    got = langid.identify(docs(rows))
    assert got.columns == ["doc_id", "lang", "confidence", "rejected"]
    out = got.collect()
    assert len(out) == len(rows)
    assert sum(r.lang is None for r in out) == 3 and all(r.rejected and r.confidence == 0 for r in out if r.lang is None)
    kept = langid.identified(docs(rows))
    assert kept.columns == docs([]).columns and kept.count() == sum(not r.rejected for r in out)


def test_no_label_or_no_row(docs):
    assert langid.identify(docs([])).count() == 0 and langid.identified(docs([])).count() == 0
    assert [r.rejected for r in langid.identify(docs([(1, "some text", None)])).collect()] == [True]


def test_one_odd_label_doesn_t_open_the_door():
    """A sample of full size, one of whose held-out rows is junk."""
    rng = np.random.default_rng(3)
    words = {k: ["".join(rng.choice(list(k), rng.integers(3, 8))) for _ in range(60)] for k in ("abcdef", "ghijkl", "mnopqr", "stuvwx")}
    labels = [list(words)[i % 4] for i in range(langid.SAMPLE)]
    texts = [" ".join(rng.choice(words[k], 8)).encode() for k in labels]
    texts[0] = b"zyzyz yyzzy zzyyz"  # the first row is held out
    m = langid.train(texts, labels)
    assert m.threshold == 0.5
    _, conf = m.predict([texts[0], *texts[1:200]])
    assert conf[0] < m.threshold and (conf[1:] >= m.threshold).all()


@pytest.fixture(scope="module")
def full(spark):
    """A model fitted at its own sample size, and other rows of the same table."""
    path = "/root/testdata/sf0.1"
    if not os.path.exists(path):
        pytest.skip("no data")
    docs = table(spark, path, "documents")
    m = langid.fit(docs)
    rows = docs.filter("doc_id % 7 = 3 and text <> ''").select("text", "lang").collect()
    return m, rows


def test_at_full_sample_size(full):
    m, rows = full
    assert np.isfinite(m.scores).all() and np.isfinite(m.bias).all()
    lang, conf = m.predict([r.text.encode() for r in rows])
    right = np.array([i >= 0 and m.langs[i] == r.lang for i, r in zip(lang, rows)])
    kept = conf >= m.threshold
    assert np.isfinite(conf).all() and right.mean() > 0.97 and kept.mean() > 0.97
    assert abs(conf[kept].mean() - right[kept].mean()) < 0.05  # calibrated
    assert 1e-3 < m.temperature < 1e3
    texts = [b"12 34 !?", "Привет мир это русский".encode(), b"qzxj wvkq xxqz jjqk zzkx"]
    assert (m.predict(texts)[1] < m.threshold).all()


def plain(m, text):
    """Language and confidence in plain Python: a dictionary of grams, a sum, a softmax."""
    data = bytearray(b"  " + text + b"    ")
    for i in range(1, len(data)):
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E:
            data[i] += 32
    low = [c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in data]
    rows = []
    for i in range(1, len(low) - 1):
        if low[i] != 32:
            rows.append(((low[i - 1] << 16 | low[i] << 8 | low[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 16)
    for i in range(1, len(low) - 2):
        if low[i] != 32 and low[i + 1] != 32:
            rows.append(((low[i + 2] << 24 | low[i - 1] << 16 | low[i] << 8 | low[i + 1]) * 2246822519 & 0xFFFFFFFF) >> 16)
    if not rows:
        return None, 0.0
    k = len(m.langs)
    z = [sum(float(m.scores[r, j]) for r in rows) / len(rows) + m.bias[j] for j in range(k)]
    known = sum(float(m.scores[r, k]) for r in rows) / len(rows)
    e = [math.exp((x - max(z)) / m.temperature) for x in z]
    p = [known * x / sum(e) + (1 - known) / k for x in e]
    return m.langs[p.index(max(p))], max(p)


def test_same_as_plain_python(model):
    m, rows = model
    texts = [r.text.encode() for r in rows[:25]] + [b"", b"a", "É CAFÉ ÑU 7x".encode(), b"12", "Привет".encode()]
    lang, conf = m.predict(texts)
    for t, i, c in zip(texts, lang, conf):
        want, p = plain(m, t)
        assert (None if i < 0 else m.langs[i]) == want and abs(c - p) < 1e-5


def test_not_a_number_is_rejected(spark):
    m = langid.Model(["a", "b"], np.full((1 << langid.BITS, 3), np.nan, np.float32), np.zeros(2), 1.0, 0.5)
    out = spark.createDataFrame([("some text",)], "text string").select(langid.predictor(m)("text").alias("p")).select("p.*").collect()
    assert [r.rejected for r in out] == [True]


def test_the_sample_is_bounded(docs, monkeypatch):
    """By rows and by bytes, though ids are missing or repeat."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.append(texts))
    langid.fit(docs([(None, "same text", "en")] * 300 + [(7, "same text", "en")] * 300), sample=10)
    langid.fit(docs([(i, f"{i} " + "x" * 1000, "en") for i in range(100)]), sample=90, sample_bytes=64 * 1100)
    langid.fit(docs([(1, "x" * 5000, "en"), (2, "short", "en")]), sample_bytes=64 * 100)
    assert [len(t) for t in seen] == [10, 70, 1]
