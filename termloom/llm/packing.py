"""Best-fit packing by length patterns.

Texts are cut into pieces of at most ``context`` tokens. Piece lengths, rounded up to ``LEVELS`` levels, make a
histogram. Patterns of at most ``parts`` pieces that fill a context exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares, rounded down and trimmed to the pieces there are; what the
patterns leave over is packed best-fit, largest first, by counts. The plan is made on the driver from the histogram
alone, so its size doesn't depend on the corpus: every pattern takes a range of ranks in each of its levels. Pieces are
ranked within their level by a two-level prefix sum and look up their bin by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, doc_id, documents, hash60, spread_rank, words

LEVELS = 64


def patterns(levels: int, parts: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``parts`` levels that sum to ``levels``."""

    def go(rest: int, most: int, k: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
        elif k:
            for x in range(min(rest, most), 0, -1):
                if x * k >= rest:
                    for tail in go(rest - x, x, k - 1):
                        yield (x, *tail)

    return list(go(levels, levels, parts))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    eps = 1e-10 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds or 3 * n):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if free.all() or w.max() <= eps:
            break
        free[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=1) > 0:
                x = s
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def plan(histogram: np.ndarray, parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(levels of a bin, how many such bins) so that every piece of ``histogram`` (by level, 0 unused) is in one bin."""
    levels = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    if not left.sum():
        return []
    every = patterns(levels, parts)
    a = np.zeros((levels, len(every)))
    for j, p in enumerate(every):
        for x in p:
            a[x - 1, j] += 1
    scale = left.max()
    fit = np.floor(nnls(a, left[1:] / scale) * scale + 1e-6).astype(np.int64)
    out = []
    for j in sorted(np.flatnonzero(fit), key=lambda j: (-fit[j], j)):
        need = {x: every[j].count(x) for x in every[j]}
        n = min(int(fit[j]), *(int(left[x]) // k for x, k in need.items()))
        if n > 0:
            out.append((every[j], n))
            for x, k in need.items():
                left[x] -= k * n
    while left.any():
        now, rest, have = [], levels, left.copy()
        while True:
            fits = np.flatnonzero(have[: rest + 1])
            if not len(fits):
                break
            x = int(fits[-1])
            now.append(x)
            have[x] -= 1
            rest -= x
        n = min(int(left[x]) // now.count(x) for x in set(now))
        out.append((tuple(now), n))
        for x in now:
            left[x] -= n
    return out


def pack(docs: DataFrame, context: int = 2048, parts: int = 3) -> DataFrame:
    """(bin, doc_id, piece, offset, n_tokens): piece number, first token and tokens of each piece, and its bin.

    A bin holds at most ``context`` tokens; each token of a text is in one piece. A token is a word. A null or empty text
    is one piece of 0 tokens. A null doc_id stays null. Rows that repeat are packed each. An empty table gives no rows.
    Further columns are not read.
    """
    if context % LEVELS:
        raise ValueError(f"context must be a multiple of {LEVELS}")
    width = context // LEVELS
    d = documents(docs).select("_d", words(F.col("text")).alias("_n"))
    d = d.select("_d", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / context) - 1).cast("int"))).alias("piece"))
    d = d.withColumn("offset", F.col("piece").cast("bigint") * context).withColumn("n_tokens", F.least(F.col("_n") - F.col("offset"), F.lit(context)))
    d = cut(d.select("_d", "piece", "offset", "n_tokens", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / width)).cast("int").alias("_l"), hash60(F.lit("pack"), "_d", "piece").alias("_h")))
    histogram = np.zeros(LEVELS + 1, np.int64)
    for r in d.groupBy("_l").count().collect():
        histogram[r[0]] = r[1]
    begin, base, used, bins = [[] for _ in range(LEVELS + 1)], [[] for _ in range(LEVELS + 1)], [0] * (LEVELS + 1), 0
    for levels, n in plan(histogram, parts):
        for x in levels:
            begin[x].append(used[x])
            base[x].append(bins - used[x])
            used[x] += n
        bins += n
    begin, base = [np.array(x, np.int64) for x in begin], [np.array(x, np.int64) for x in base]

    @F.pandas_udf("bigint")
    def place(level: pd.Series, rank: pd.Series) -> pd.Series:
        lv, r = level.to_numpy(), rank.to_numpy()
        out = np.zeros(len(r), np.int64)
        for x in np.unique(lv):
            m = lv == x
            out[m] = r[m] + base[x][np.searchsorted(begin[x], r[m], "right") - 1]
        return pd.Series(out)

    wide = 1 << max(0, int(np.ceil(np.log2(max(1, histogram.sum() / 200_000)))))
    d = spread_rank(d, ["_l"], ["_h", "_d", "piece", "n_tokens"], F.lit(1), "_r", wide, "_h")
    return d.select(place("_l", "_r").alias("bin"), doc_id(), "piece", "offset", "n_tokens")
