"""Substring dedup by a suffix array of the corpus, to the depth of the least repeat.

A suffix is known by its leading tokens (16 bits of each word's hash) and by a hash of its first ``least`` words.
Splitters are drawn from a sample of suffixes and range-partition them by leading tokens. Each bucket sorts its suffixes
with multikey quicksort; neighbours that agree to the full depth are repeats. A suffix so frequent that it makes up
several splitters is spread over the buckets between them, and its places are then compared across those boundaries.

Suffixes whose window has a minimiser that occurs only once can't have an equal and are left out (see ``_repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, parts
from ._repeats import BLOB, RUNS, buckets, by_bucket, candidates, gathered, joined, keyed, marks, repeated, resolved, runs_of, scatter, texts
from ._words import U, mix, ngrams

LEAST = 50
#: Suffixes in the sample for each splitter.
OVERSAMPLE = 100
_HOT = -1


def multikey(columns: list[np.ndarray], small: int = 256) -> np.ndarray:
    """Order by the columns in turn: three-way partition on one column, the equal part goes on to the next."""
    out = np.empty(len(columns[0]), np.int64)
    todo = [(np.arange(len(out)), 0, 0)]
    while todo:
        own, depth, begin = todo.pop()
        if len(own) <= small or depth == len(columns) - 1:
            out[begin : begin + len(own)] = own[np.lexsort([c[own] for c in reversed(columns[depth:])])]
            continue
        v = columns[depth][own]
        pivot = np.sort(v[:: max(1, len(v) // 31)])[min(len(v), 31) // 2]
        less, same = v < pivot, v == pivot
        a, b = int(less.sum()), int(same.sum())
        for part, d, at in ((own[less], depth, begin), (own[same], depth + 1, begin + a), (own[~(less | same)], depth, begin + a + b)):
            if len(part):
                todo.append((part, d, at))
    return out


def _lead(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Four leading tokens of 16 bits each, in one number."""
    t = words >> U(48)
    out = np.zeros(len(at), U)
    for i in range(4):
        out = (out << U(16)) | t[at + i]
    return out


def _suffixes(least: int):
    def run(f: pd.DataFrame, w) -> tuple[np.ndarray, ...]:
        at = candidates(f, w, least)[0]
        d = w.doc[at]
        return _lead(w.hash, at), ngrams(w.hash, least)[1][at], f["_k"].to_numpy(np.int64)[d], (at - w.first[d]).astype(np.int32)

    return run


def _sample(least: int, mask: int):
    suffixes = _suffixes(least)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, w in texts(frames):
            lead, x, k, p = suffixes(f, w)
            own = (mix(x ^ mix(k.view(U)) ^ p.astype(U)) & U(mask)) == 0
            yield pd.DataFrame({"_a": lead[own].view(np.int64), "_x": x[own].view(np.int64)})

    return run


def _place(lead: np.ndarray, x: np.ndarray, k: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Bucket of each suffix; one that equals several splitters goes to any of the buckets between them."""
    key = np.empty(len(lead), split.dtype)
    key["a"], key["x"] = lead, x
    low, high = np.searchsorted(split, key, "left"), np.searchsorted(split, key, "right")
    spread = np.maximum(high - low, 1)
    return np.where(high - low > 1, low + (mix(k.view(U)) % spread.astype(U)).astype(np.int64), high)


_KEY = np.dtype([("a", np.uint64), ("x", np.uint64)])


def _sorted(hot: np.ndarray, width: int, within: bool):
    """Blobs (by document bucket) of windows that occur in several documents, or with ``within`` at several places: x is the first document, y the first place.

    A suffix that boundaries cut goes whole to bucket ``_HOT``, x and y being its key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, lead, x, k, p in gathered(frames, U, U):
            tokens = [((lead >> U(s)) & U(0xFFFF)) for s in (48, 32, 16, 0)]
            order = multikey([*tokens, x, k, p])
            la, xs = lead[order], x[order]
            tie = np.append(False, (la[1:] == la[:-1]) & (xs[1:] == xs[:-1]))
            if len(hot):
                key = np.empty(len(la), _KEY)
                key["a"], key["x"] = la, xs
                cutoff = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                if cutoff.any():
                    o = order[cutoff]
                    yield scatter(np.full(len(o), _HOT), lead[o], x[o], k[o], p[o])
                order, tie = order[~cutoff], tie[~cutoff]
            if len(order):
                ks, ps, ck, cp = repeated(x, k, p, order, tie, within)
                if len(ks):
                    yield scatter((mix(ks.view(U)) % U(width)).astype(np.int64), ck, cp, ks, ps)

    return run


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each bucket's part of a suffix that boundaries cut: its first place and its last document."""
    for f in frames:
        for lead, x, ks, ps in zip(f["_x"], f["_y"], f["_ks"], f["_ps"]):
            lead, x, k, p = np.frombuffer(lead, U), np.frombuffer(x, U), np.frombuffer(ks, np.int64), np.frombuffer(ps, np.int32)
            yield pd.DataFrame({"_a": lead.view(np.int64), "_x": x.view(np.int64), "_k": k, "_p": p})


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, ck, cp, k, p in gathered(frames, np.int64, np.int32):
        o = np.lexsort((p, k))
        yield runs_of(k[o], p[o], ck[o], cp[o])


def repeats(docs: DataFrame, least: int = LEAST, per_bucket: int | None = None, within: bool = False) -> DataFrame:
    """(doc_id, start, n_words, first_doc, first_start): maximal runs of words that also occur in another document.

    Each run has at least ``least`` words, counted from 0, and equals the one at ``first_start`` in ``first_doc``, the
    first place in the corpus (by doc_id, then position) that holds it; in that document it is listed too, naming
    itself. A word is a run of non-space; runs are equal when 128 bits, of their tokens and of their hash, are. A null, empty or shorter text has no run; a text of
    repetitions alone has none either, unless another document shares it. A null doc_id counts as the least and stays
    null. Rows that repeat id and text count once; texts of one id that differ are documents of their own. An empty
    table gives no rows. Further columns are not read. ``per_bucket``: suffixes that a bucket is meant to hold.

    ``within``: runs that recur in one document only are listed too. A column ``within`` tells them; the other rows are the
    same as without it. The first place of a text of repetitions is then in the text itself.
    """
    if least < 16:
        raise ValueError("least must be 16 words or more")
    text, names = keyed(docs)
    live, _ = marks(text, least)
    n = buckets(live)
    count = n * 500_000
    if per_bucket:
        count = (live.agg(F.sum(F.size("_m"))).first()[0] or 0) * 22
        n = max(1, count // per_bucket)
    share = max(1, count // (n * OVERSAMPLE))
    mask = (1 << max(0, share.bit_length() - 1)) - 1
    ready = text.join(live, "_k")
    width = parts(docs)
    split = np.zeros(0, _KEY)
    if n > 1:
        # Documents for the sample by hash, a sixteenth of them; of those, suffixes by hash.
        some = live.filter(F.pmod(F.xxhash64("_k"), F.lit(16)) == 0) if mask >= 15 else live
        drawn = text.join(some, "_k").mapInPandas(_sample(least, mask >> 4 if mask >= 15 else mask), "_a bigint, _x bigint").toPandas()
        key = np.empty(len(drawn), _KEY)
        key["a"], key["x"] = drawn["_a"].to_numpy(np.int64).view(U), drawn["_x"].to_numpy(np.int64).view(U)
        key.sort()
        split = key[np.linspace(0, len(key), n + 1).astype(int)[1:-1]] if len(key) else split
    again = split[1:][split[1:] == split[:-1]] if len(split) > 1 else split[:0]
    hot = np.unique(again)
    suffixes = _suffixes(least)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, w in texts(frames):
            lead, x, k, p = suffixes(f, w)
            if len(lead):
                yield scatter(_place(lead, x, k, split), lead, x, k, p)

    found = by_bucket(ready.mapInPandas(emit, BLOB), width).mapInPandas(_sorted(hot, width, within), BLOB)
    if len(hot):
        found = cut(found)
        parted = found.filter(F.col("_b") == _HOT).mapInPandas(_across, "_a bigint, _x bigint, _k bigint, _p int")
        cutruns = resolved(parted, within)
        found = found.filter(F.col("_b") != _HOT)
    runs = by_bucket(found, width).mapInPandas(_runs, RUNS)
    return joined(runs.unionByName(cutruns) if len(hot) else runs, least, names, within)
