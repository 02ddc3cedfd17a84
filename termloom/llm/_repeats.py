"""What the two substring dedups share: repeats of at least ``least`` words across documents. Words and runs of words are known by 64 bits of hash.

A repeat shows in its windows of ``least`` words. Each window is represented by its minimiser, the least hashed 8-gram
in it: equal windows have equal minimisers, so a window whose minimiser occurs nowhere else can't be repeated. That
leaves the candidates, and nothing that repeats is lost. Windows travel in blobs, one for each chunk of texts and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, doc_id, documents, parts
from ._words import U, Words, mix, ngrams

GRAM = 8
#: Windows that a bucket is meant to hold.
PER_BUCKET = 500_000
#: Occurrences from which an n-gram is hot, and that part of all.
HOT, HOT_SHARE = 20_000, 1_000_000
_POS = 24


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(_k, text) with one row of each id and text, and (_k, _d) unless ``_k`` is the id itself. Order of ``_k`` is that of ids."""
    d = documents(docs).filter("text is not null")
    if d.groupBy("_d").count().filter("count > 1").isEmpty():
        return d.select(F.col("_d").alias("_k"), F.col("text").cast("binary").alias("text")), None
    rows = d.distinct().repartitionByRange(parts(docs), "_d", "text").sortWithinPartitions("_d", "text")
    rows = cut(rows.withColumn("_k", F.monotonically_increasing_id()))
    return rows.select("_k", F.col("text").cast("binary").alias("text")), rows.select("_k", "_d")


def texts(frames: Iterator[pd.DataFrame], limit: int = 2_000_000) -> Iterator[tuple[pd.DataFrame, Words]]:
    """Pieces of about ``limit`` bytes of text; a text is never cut."""
    for f in frames:
        own = [bytes(t) for t in f["text"]]
        total = begin = 0
        for i, t in enumerate(own):
            total += len(t)
            if total >= limit or i + 1 == len(own):
                yield f.iloc[begin : i + 1], Words(own[begin : i + 1])
                total, begin = 0, i + 1


def minimisers(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts that lie in one text, the place of each window's minimiser, and hashes of all 8-grams."""
    g = ngrams(words.hash, GRAM)[1]
    n, span = len(words.hash) - width + 1, width - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    place = np.empty(n, np.int64)
    step = (1 << _POS) - span
    for begin in range(0, n, step):
        end = min(n, begin + step)
        v = g[begin : end + span - 1]
        low = (v >> U(_POS) << U(_POS)) | np.arange(len(v), dtype=U)  # ties go to the first
        have = 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[: end - begin], low[span - have :][: end - begin])
        place[begin:end] = (low & U((1 << _POS) - 1)).astype(np.int64) + begin
    whole = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :][:n])
    return whole, place[whole], g


def _grams(least: int):
    """(_h, _k, _p, _c) for the minimisers of each chunk: the first of an n-gram with how often the chunk has it, and the others, which are known to be repeated and go anywhere, with 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, w in texts(frames):
            at = np.unique(minimisers(w, least)[1])
            g = ngrams(w.hash, GRAM)[1][at]
            order = np.argsort(g, kind="stable")
            at, g = at[order], g[order]
            new = np.append(True, g[1:] != g[:-1])[: len(g)]
            first = np.flatnonzero(new)
            count = np.zeros(len(g), np.int64)
            count[first] = np.diff(np.append(first, len(g)))
            d = w.doc[at]
            k, p = f["_k"].to_numpy(np.int64)[d], (at - w.first[d]).astype(np.int32)
            yield pd.DataFrame({"_h": np.where(new, g, mix(k.view(U) ^ mix(p.astype(U)))).view(np.int64), "_k": k, "_p": p, "_c": count})

    return run


def _repeated_grams(hot_from: int):
    """(_t, _k, _p, _n): of rows sorted by ``_h`` the places (_k, _p) of n-grams that occur several times; with ``_t`` also those of over ``hot_from``: their hash as ``_k``, their number."""

    def places(f: pd.DataFrame) -> pd.DataFrame:
        return f[["_k", "_p"]].assign(_t=False, _n=0)[["_t", "_k", "_p", "_n"]]

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        h, c = f["_h"].to_numpy(), f["_c"].to_numpy()
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.add.reduceat(c, at)
        hot = total > hot_from
        return pd.concat([places(f[np.repeat(total > 1, np.diff(np.append(at, len(h))))]), pd.DataFrame({"_t": True, "_k": h[at[hot]], "_p": np.int32(0), "_n": total[hot]})])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in frames:
            known = f["_c"].to_numpy() == 0
            yield places(f[known])
            f = f[~known] if kept is None else pd.concat([kept, f[~known]], ignore_index=True)
            last = f["_h"].to_numpy() == f["_h"].iloc[-1] if len(f) else np.zeros(0, bool)
            kept, f = f[last], f[~last]
            if len(f):
                yield whole(f)
        if kept is not None and len(kept):
            yield whole(kept)

    return run


def marks(text: DataFrame, least: int, hot_from: int = HOT) -> tuple[DataFrame, np.ndarray]:
    """(_k, _m): word numbers of the minimisers of a document that occur more than once. Beside it the sorted hashes of hot ones.

    Hot are those that occur over ``hot_from`` times and make up over one in ``HOT_SHARE`` of all: ``HOT_SHARE`` hashes at most.
    """
    rows = text.mapInPandas(_grams(least), "_h bigint, _k bigint, _p int, _c bigint")
    twice = rows.repartition(parts(text), "_h").sortWithinPartitions("_h").mapInPandas(_repeated_grams(hot_from), "_t boolean, _k bigint, _p int, _n bigint")
    every = cut(twice.groupBy("_t", "_k").agg(F.collect_list("_p").alias("_m"), F.max("_n").alias("_n")))
    live = every.filter("not _t").select("_k", "_m")
    total = live.agg(F.sum(F.size("_m"))).first()[0] or 0
    hot = every.filter(F.col("_t") & (F.col("_n") > total / HOT_SHARE)).select("_k").collect()
    return live, np.sort(np.array([r[0] for r in hot], np.int64).view(U))


def among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted ``hot``."""
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def candidates(f: pd.DataFrame, w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose minimiser is marked, and the minimisers' hashes."""
    at, place, g = minimisers(w, least)
    marked = np.zeros(len(w.hash) + 1, bool)
    for i, m in enumerate(f["_m"]):
        marked[np.asarray(m, np.int64) + w.first[i]] = True
    ok = marked[place]
    return at[ok], g[place[ok]]


def buckets(live: DataFrame) -> int:
    n = live.agg(F.sum(F.size("_m"))).first()[0] or 0
    return max(1, int(np.ceil(n * 22 / PER_BUCKET)))


BLOB = "_b bigint, _n bigint, _x binary, _y binary, _ks binary, _ps binary"


def scatter(bucket: np.ndarray, x: np.ndarray, y: np.ndarray | None, k: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    """A row for each bucket, the arrays' parts as bytes in the order given."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.append(np.flatnonzero(np.diff(b, prepend=b[:1] - 1)), len(b)) if len(b) else np.zeros(1, np.int64)
    x, k, p = x[order], k[order], p[order]
    y = x[:0] if y is None else y[order]
    return pd.DataFrame([(b[i], j - i, x[i:j].tobytes(), y[i:j].tobytes(), k[i:j].tobytes(), p[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])], columns=["_b", "_n", "_x", "_y", "_ks", "_ps"])


def gathered(frames: Iterator[pd.DataFrame], xt, yt) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, x, y, k, p) for each bucket of frames sorted by bucket."""
    now, rows = None, []

    def whole():
        return (now, *(np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((xt, yt, np.int64, np.int32))))

    for f in frames:
        for b, *r in zip(f["_b"], f["_x"], f["_y"], f["_ks"], f["_ps"]):
            if b != now and rows:
                yield whole()
                rows = []
            now = b
            rows.append(r)
    if rows:
        yield whole()


def by_bucket(df: DataFrame, width: int) -> DataFrame:
    return df.repartition(width, "_b").sortWithinPartitions("_b")


#: Added to the first place of a window that occurs within one document only: such runs are never joined to others.
WITHIN = -(2**31)
RUNS = "_k bigint, _s int, _w int, _c bigint, _q int"


def resolved(places: DataFrame, within: bool) -> DataFrame:
    """Runs of one window each of the places (_a, _x, _k, _p) of hot windows (_a, _x): the first place comes from an aggregation, and a hot join is split."""
    first = places.groupBy("_a", "_x").agg(F.min(F.struct("_k", "_p")).alias("_f"), F.max("_k").alias("_z"), F.count("*").alias("_n"))
    first = first.filter("_n > 1" if within else "_f._k <> _z")
    at = F.when(F.col("_f._k") == F.col("_z"), F.col("_f._p") + F.lit(WITHIN)).otherwise(F.col("_f._p"))
    return places.join(first, ["_a", "_x"]).select("_k", F.col("_p").alias("_s"), F.lit(1).alias("_w"), F.col("_f._k").alias("_c"), at.alias("_q"))


def runs_of(k: np.ndarray, p: np.ndarray, ck: np.ndarray, cp: np.ndarray, n: np.ndarray | None = None) -> pd.DataFrame:
    """Joins what continues: rows sorted by (k, p), each ``n`` windows from ``p`` on that equal those from ``cp`` on in ``ck``."""
    if not len(k):
        return pd.DataFrame({"_k": k, "_s": p, "_w": p, "_c": ck, "_q": cp})
    n = np.ones(len(k), np.int64) if n is None else n.astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (ck[1:] != ck[:-1]) | (p[1:] != p[:-1] + n[:-1]) | (cp[1:] != cp[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return pd.DataFrame({"_k": k[at], "_s": p[at], "_w": np.add.reduceat(n, at), "_c": ck[at], "_q": cp[at]})


def joined(runs: DataFrame, least: int, names: DataFrame | None, within: bool = False) -> DataFrame:
    """Runs of windows, joined by document, as spans of words; ``within`` adds the column that tells those within one document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in frames:
            f = f if kept is None else pd.concat([kept, f], ignore_index=True)
            last = f["_k"].to_numpy() == f["_k"].iloc[-1] if len(f) else np.zeros(0, bool)
            kept, f = f[last], f[~last]
            yield runs_of(*(f[c].to_numpy() for c in ("_k", "_s", "_c", "_q", "_w")))
        if kept is not None:
            yield runs_of(*(kept[c].to_numpy() for c in ("_k", "_s", "_c", "_q", "_w")))

    out = runs.repartition(parts(runs), "_k").sortWithinPartitions("_k", "_s").mapInPandas(run, RUNS)
    if names is not None:
        out = out.join(names, "_k").join(names.select(F.col("_k").alias("_c"), F.col("_d").alias("_cd")), "_c")
    else:
        out = out.withColumn("_d", F.col("_k")).withColumn("_cd", F.col("_c"))
    own, at = F.col("_q") < 0, F.col("_q")
    at = F.when(own, (at.cast("bigint") - WITHIN).cast("int")).otherwise(at) if within else at
    return out.select(doc_id("_d"), F.col("_s").alias("start"), (F.col("_w") + least - 1).alias("n_words"), doc_id("_cd").alias("first_doc"), at.alias("first_start"), *([own.alias("within")] if within else []))


def repeated(h: np.ndarray, k: np.ndarray, p: np.ndarray, order: np.ndarray, tie: np.ndarray, within: bool = False) -> tuple[np.ndarray, ...]:
    """(k, p, ck, cp) of windows that occur in several documents, or with ``within`` at several places, ordered by (k, p). ``order`` sorts windows by value, k, p; ``tie`` marks, in that order, those equal to the one before."""
    at = np.flatnonzero(~tie)
    length = np.diff(np.append(at, len(order)))
    ks, ps = k[order], p[order]
    many = ks[at] != ks[at + length - 1]
    first = ps[at]
    if within:
        first = np.where(many, first, first + np.int32(WITHIN)).astype(np.int32)
        many = length > 1
    ok = np.repeat(many, length)
    ck, cp = np.repeat(ks[at], length)[ok], np.repeat(first, length)[ok]
    ks, ps = ks[ok], ps[ok]
    o = np.lexsort((ps, ks))
    return ks[o], ps[o], ck[o], cp[o]


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS ck, max(doc_id) OVER (PARTITION BY h) AS z, first_value(i) OVER (PARTITION BY h ORDER BY doc_id, i) AS cp FROM p),
r AS (SELECT doc_id, i, ck, cp, i - row_number() OVER (PARTITION BY doc_id, ck, i - cp ORDER BY i) AS run FROM g WHERE ck <> z)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start, CAST(count(*) + 49 AS INTEGER) AS n_words, ck AS first_doc, CAST(min(cp) AS INTEGER) AS first_start
FROM r GROUP BY doc_id, ck, i - cp, run
"""
