"""Substring dedup by fixed-block anchors.

The reference index holds the non-overlapping blocks of half the least repeat, at multiples of their length; any repeat
covers a whole block of either document. Every rolling window of that length probes the index, by hash bucket. A hit is
a block that equals a window of another document. Hits are extended: the longer windows that contain one are compared
in turn, and those equal in several documents are joined to maximal exact repeats.

Blocks and windows go to the bucket of their minimiser, so that neighbours travel together and an answer comes back in
runs. Only windows around a minimiser that occurs twice are probed, since no other can hit (see ``_repeats``). Those of a
hot minimiser, such as a licence in a third of all texts, count as hits without a probe, and their longer windows are
compared by aggregation: no task gathers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, parts
from ._repeats import BLOB, HOT, RUNS, among, buckets, by_bucket, candidates, gathered, joined, keyed, marks, minimisers, repeated, resolved, runs_of, scatter, texts
from ._words import U, mix, ngrams

LEAST = 50


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % U(n)).astype(np.int64)


def _spread(k: np.ndarray) -> np.ndarray:
    """Negative buckets, for what need not meet."""
    return -1 - (mix(k.view(U)) >> U(32)).astype(np.int64)


def _probes(least: int, block: int, width: int, hot: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, w in texts(frames):
            cand = candidates(f, w, least)[0]
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, cand, 1)
            np.add.at(edge, cand + least - block + 1, -1)
            inside = np.cumsum(edge) > 0  # block windows within some candidate
            at, place, g = minimisers(w, block)
            ok = inside[at]
            at, place = at[ok], place[ok]
            d = w.doc[at]
            k, g = f["_k"].to_numpy(np.int64)[d], g[place]
            bucket = np.where(among(g, hot), _spread(k), _bucket(g, width))
            yield scatter(bucket, ngrams(w.hash, block)[1][at], None, k, (at - w.first[d]).astype(np.int32))

    return run


def _hits(block: int, within: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, h, _, k, p in gathered(frames, U, U):
            if b >= 0:
                order = np.lexsort((k, h))
                hs, ks = h[order], k[order]
                at = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
                length = np.diff(np.append(at, len(hs)))
                several = length > 1 if within else ks[at] != ks[at + length - 1]
                hit = several & np.logical_or.reduceat(p[order] % block == 0, at)
                own = order[np.repeat(hit, length)]
                k, p = k[own], p[own]
            o = np.lexsort((p, k))
            r = runs_of(k[o], p[o], k[o], p[o])
            yield r[["_k", "_s", "_w"]]

    return run


def _longer(least: int, block: int, width: int, hot: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, w in texts(frames):
            edge = np.zeros(len(w.hash) + least + 1, np.int64)
            for i, hits in enumerate(f["_hits"]):
                own = np.array([(r["_s"], r["_w"]) for r in hits], np.int64) + [w.first[i], 0]
                np.add.at(edge, np.maximum(w.first[i], own[:, 0] - (least - block)), 1)
                np.add.at(edge, own[:, 0] + own[:, 1], -1)
            inside = np.cumsum(edge) > 0  # windows that contain a hit
            at, place, g = minimisers(w, least)
            ok = inside[at]
            at, place = at[ok], place[ok]
            d = w.doc[at]
            k, g = f["_k"].to_numpy(np.int64)[d], g[place]
            bucket = np.where(among(g, hot), _spread(k), _bucket(g, width))
            yield scatter(bucket, ngrams(w.hash, least)[1][at], None, k, (at - w.first[d]).astype(np.int32))

    return run


def _equal(within: bool):
    """Runs; and with ``_x`` the windows of hot minimisers as they came."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, h, _, k, p in gathered(frames, U, U):
            if b < 0:
                yield pd.DataFrame({"_k": k, "_s": p, "_w": 1, "_c": None, "_q": None, "_x": h.view(np.int64)}).astype({"_c": "Int64", "_q": "Int32"})
                continue
            order = np.lexsort((p, k, h))
            tie = np.append(False, h[order][1:] == h[order][:-1])
            yield runs_of(*repeated(h, k, p, order, tie, within)).assign(_x=None).astype({"_x": "Int64"})

    return run


def repeats(docs: DataFrame, least: int = LEAST, within: bool = False, hot_from: int = HOT) -> DataFrame:
    """(doc_id, start, n_words, first_doc, first_start): maximal runs of words that also occur in another document.

    Each run has at least ``least`` words, counted from 0, and equals the one at ``first_start`` in ``first_doc``, the
    first place in the corpus (by doc_id, then position) that holds it; in that document it is listed too, naming
    itself. A word is a run of non-space; runs are equal when 64 bits of their hash are. A null, empty or shorter text has no run; a text of
    repetitions alone has none either, unless another document shares it. A null doc_id counts as the least and stays
    null. Rows that repeat id and text count once; texts of one id that differ are documents of their own. An empty
    table gives no rows. Further columns are not read.

    ``within``: runs that recur in one document only are listed too. A column ``within`` tells them; the other rows are the
    same as without it. The first place of a text of repetitions is then in the text itself. ``hot_from``: occurrences from
    which an n-gram is hot; it changes no row.
    """
    if least < 16:
        raise ValueError("least must be 16 words or more")
    block = least // 2
    text, names = keyed(docs)
    live, hot = marks(text, least, hot_from)
    n = buckets(live)
    # Both joins are of one plan, so that the texts are shuffled once.
    probes = text.join(live, "_k").mapInPandas(_probes(least, block, 2 * n, hot), BLOB)
    hits = by_bucket(probes, parts(docs)).mapInPandas(_hits(block, within), "_k bigint, _s int, _w int")
    hits = hits.groupBy("_k").agg(F.collect_list(F.struct("_s", "_w")).alias("_hits"))
    longer = text.join(hits, "_k").mapInPandas(_longer(least, block, n, hot), BLOB)
    runs = by_bucket(longer, parts(docs)).mapInPandas(_equal(within), RUNS + ", _x bigint")
    if not len(hot):
        return joined(runs.drop("_x"), least, names, within)
    runs = cut(runs)
    places = runs.filter("_x is not null").select(F.lit(0).alias("_a"), "_x", "_k", F.col("_s").alias("_p"))
    return joined(runs.filter("_x is null").drop("_x").unionByName(resolved(places, within)), least, names, within)
