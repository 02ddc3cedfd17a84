"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's letters, lower-cased, give byte 3-grams and 4-grams that don't run over a word's ends by more than one
boundary; each is hashed to a row of an embedding table, the mean row goes through a linear softmax. Table and softmax
are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows: mean gradients of a
batch, none longer than ``CLIP``. A temperature fitted on held-out rows makes the softmax a probability, in which the
share of subwords never seen counts for any language alike; the rejection threshold is set on the same rows.

As everything after the table is linear, table and softmax fold into one score per (row, language): a text costs one
lookup and one addition per subword. Whole texts are read, in training and in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id, documents

BITS, DIM = 16, 16
#: Labelled rows that the model is trained and calibrated on, those of least hash, whatever the size of the table.
SAMPLE = 4000
#: Bytes of text that the sample may have in all. A row of more than a 64th of it is not trained on.
SAMPLE_BYTES = 64 << 20
#: Longest gradient of the softmax, and of a text's mean row.
CLIP = 1.0

_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def subwords(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3-grams and for 4-grams, in order: their table rows, and the text that each comes from."""
    buf = np.frombuffer(b"  " + b"    ".join(texts) + b"    ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 4
    low = _LOWER[buf]
    capital = np.zeros(len(buf), bool)  # the capitals of Latin-1 in UTF-8
    capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    low[capital] += 32
    x = low.astype(np.uint32)
    letter = low != 32
    stop = np.cumsum(size)
    inner = letter[1:-1]
    g = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    three = np.flatnonzero(inner)
    four = np.flatnonzero(inner[:-1] & inner[1:])
    h3 = (g[three] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    h4 = ((g[four] ^ (x[four + 3] << np.uint32(24))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    return [(h, np.searchsorted(stop, at, "right")) for h, at in ((h3, three), (h4, four))]


def _pieces(texts: list[bytes], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) in pieces of about ``limit`` bytes; a text is never cut."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _clipped(rows: np.ndarray) -> np.ndarray:
    return rows * np.minimum(1, CLIP / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300))


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """That of least loss on held-out scores. A quarter of a row of each language is added in thought, so that rows that are all right don't make the model certain."""
    n, k = z.shape
    target = np.full((n, k), 0.25 / (n + 0.25 * k))
    target[np.arange(n), y] = (n + 0.25) / (n + 0.25 * k)
    grid = np.exp(np.linspace(np.log(1e-3), np.log(1e3), 277))
    loss = [-(target * np.log(np.maximum(softmax(z / t), 1e-300))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (2**BITS, languages + 1), at the end whether the row was seen in training
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: scores, the share of its subwords that were seen, and how many it has."""
        total, n = np.zeros((len(texts), len(self.langs) + 1), np.float64), np.zeros(len(texts), np.int64)
        for rows, of in subwords(texts):
            own = np.bincount(of, minlength=len(texts))
            n += own
            some = np.flatnonzero(own)
            if len(some):
                total[some] += np.add.reduceat(self.scores[rows], np.concatenate([[0], np.cumsum(own[some])[:-1]]), axis=0)
        total /= np.maximum(n, 1)[:, None]
        return total[:, :-1] + self.bias, total[:, -1], n

    def probabilities(self, z: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[:, None] * softmax(z / self.temperature) + (1 - known[:, None]) / len(self.langs)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1 without any letter) and its calibrated probability."""
        z, known, n = self.logits(texts)
        p = self.probabilities(z, known)
        best = p.argmax(1)
        return np.where(n > 0, best, -1), np.where(n > 0, p[np.arange(len(p)), best], 0.0)


def train(texts: list[bytes], labels: list[str], steps: int = 500, rate: float = 1.0, batch: int = 32, seed: int = 7, lost: float = 0.001) -> Model:
    """At least ``steps`` steps of descent, in whole passes. Every fifth row is held out for the temperature and the threshold.

    ``lost``: share of held-out rows that may be rejected; the threshold is the highest up to 0.5 (the language is as likely
    wrong as right) that keeps to it, and at least somewhat more than a guess among the languages would have. It is 0.5
    where so few rows are held out that the share is less than one of them: a single odd row says nothing of the share.
    """
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    d, g, w, n = [], [], [], np.zeros(len(texts))
    for begin, own in _pieces(texts, 500_000):
        rows, of = map(np.concatenate, zip(*subwords(own)))
        key, count = np.unique(of.astype(np.int64) << BITS | rows, return_counts=True)
        of = (key >> BITS) + begin
        n += np.bincount(of, count, minlength=len(texts))
        d.append(of.astype(np.int32))
        g.append((key & ((1 << BITS) - 1)).astype(np.int32))
        w.append((count / n[of]).astype(np.float32))
    d, g, w = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (d, g, w))
    first = np.searchsorted(d, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    seen = np.zeros(1 << BITS, bool)
    soft, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    ids = np.flatnonzero(n > 0)
    held, fit = ids[::5], np.setdiff1d(ids, ids[::5])
    if not len(fit):
        held = fit = ids
    for i in fit:
        seen[g[first[i] : first[i + 1]]] = True
    epochs, done = -(-steps * batch // max(1, len(fit))), 0
    steps = epochs * -(-len(fit) // batch)
    for _ in range(epochs):
        rng.shuffle(fit)
        for b in range(0, len(fit), batch):
            own = fit[b : b + batch]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            size = first[own + 1] - first[own]
            mine = np.repeat(np.arange(len(own)), size)
            h = np.add.reduceat(emb[g[at]] * w[at, None], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            e = softmax(h @ soft + bias)
            e[np.arange(len(own)), y[own]] -= 1
            lr = rate * (1 - done / steps)
            back = _clipped(e @ soft.T)
            soft -= 8 * lr * _clipped((h.T @ e / len(own)).reshape(1, -1)).reshape(soft.shape)
            bias -= lr * e.mean(0)
            for k in range(DIM):
                emb[:, k] -= 160 * lr / len(own) * np.bincount(g[at], w[at] * back[mine, k], minlength=1 << BITS)
            done += 1
    emb[~seen] = 0  # what was never seen says nothing
    if not (np.isfinite(emb).all() and np.isfinite(soft).all() and np.isfinite(bias).all()):
        raise FloatingPointError("training diverged")
    model = Model(langs, np.hstack([emb @ soft, seen[:, None]]).astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        z, known, _ = map(np.concatenate, zip(*[model.logits(own) for _, own in _pieces([texts[i] for i in held], 500_000)]))
        model.temperature = _temperature(z, y[held])
        best = np.sort(model.probabilities(z, known).max(1))
        least = int(lost * len(best))
        model.threshold = float(max(min(0.5, 1.25 / len(langs)), min(0.5, best[least] - 1e-9))) if least else 0.5
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Trained on the labelled rows of least hash (of id, text and label), ``sample`` at most and ``sample_bytes`` of text at most, however many rows repeat or lack an id; None without any."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("_d"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.filter("lang is not null and text is not null").filter(F.octet_length("text") <= sample_bytes // 64)
    d = d.withColumn("_h", F.xxhash64(F.lit("langid"), "_d", "text", "lang"))
    size = d.select("_h", F.octet_length("text").alias("_n")).orderBy("_h", "_n").limit(sample).collect()
    if not size:
        return None
    some = int((np.cumsum([r._n for r in size]) <= sample_bytes).sum())
    got = d.filter(F.col("_h") <= size[some - 1]._h).select("_h", "text", "lang").orderBy("_h").limit(some).collect()
    return train([x.text.encode() for x in got], [x.lang for x in got])


def predictor(model: Model | None):
    """A Column function text -> (lang, confidence, rejected)."""

    @F.pandas_udf("lang string, confidence double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = [b"" if t is None else bytes(t) for t in text]
        lang, conf = np.full(len(texts), -1), np.zeros(len(texts))
        for begin, own in _pieces(texts, 1_000_000) if model is not None else ():
            lang[begin : begin + len(own)], conf[begin : begin + len(own)] = model.predict(own)
        names = np.array([*(model.langs if model else []), None], dtype=object)
        return pd.DataFrame({"lang": names[lang], "confidence": conf, "rejected": (lang < 0) | ~(conf >= (model.threshold if model else 1))})

    predict = predict.asNondeterministic()  # else it is run again for each use of its result
    return lambda c: predict(F.col(c).cast("binary"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, confidence, rejected) for each row of ``docs``, by a model trained on its own ``lang`` column.

    A null or empty text, or one without a letter, has a null language, confidence 0, and is rejected. Rows without a
    ``lang`` are identified but not trained on; without any label all rows are rejected. Repeated rows are each
    identified; equal texts get equal answers. A null doc_id stays null. An empty table gives no rows. Further columns
    are not read. Training takes ``sample`` rows at most and ``SAMPLE_BYTES`` of text (see ``fit``).
    """
    predict = predictor(fit(docs, sample))
    out = documents(docs).select("_d", predict("text").alias("_p"))
    return out.select(doc_id(), "_p.lang", F.round("_p.confidence", 6).alias("confidence"), "_p.rejected")


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were."""
    predict = predictor(fit(docs, sample))
    text = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("_text"))
    return text.select("row", predict("_text").alias("_p")).filter("not _p.rejected").select("row.*")
