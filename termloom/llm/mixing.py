"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` gets the golden-ratio point ``(i + 1) * phi mod 1`` in exact 64-bit arithmetic; the point, looked up in
the cumulative weights, names the source of the slot. Slots are ranked within their source, every source is shuffled
by hash and cut into blocks of ``block_tokens`` tokens, and slot rank ``r`` takes block ``r mod blocks`` in epoch
``r div blocks``. Every stretch of the schedule is therefore close to the target weights, not only its whole.

The schedule ends with the slot in which the last source has used all its blocks once, so no document is left out;
sources above their share of the tokens set the length, the others repeat. A ``budget`` ends it elsewhere.

Ranks and token offsets are two-level prefix sums (``spread_rank``): a hot source is spread over all tasks. Only the
totals by source go to the driver; their number is checked against ``MAX_SOURCES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, cut, doc_id, documents, hash60, spread_rank, words

PHI = 11400714819323198485  # 2**64 divided by the golden ratio, odd
BITS = 40
MAX_SOURCES = 100_000


def thresholds(weights: list[float]) -> np.ndarray:
    """Upper ends of the sources' intervals, in units of 2**-BITS."""
    cum = np.cumsum(np.asarray(weights, np.float64))
    out = np.floor(cum / cum[-1] * 2.0**BITS).astype(np.int64)
    out[-1] = 2**BITS
    return out


def points(slot: np.ndarray) -> np.ndarray:
    return (((slot.astype(np.uint64) + np.uint64(1)) * np.uint64(PHI)) >> np.uint64(64 - BITS)).astype(np.int64)


def _pow2(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_tokens: int = 16384, budget: int | None = None, max_epochs: int | None = None, seed: str = "mix") -> DataFrame:
    """Schedule of ``docs``: (slot, source, epoch, block, offset, doc_id, n_tokens).

    ``weights``: target share by source; sources that it lacks get no slot. Without it a source of t tokens weighs
    t**alpha. ``budget``: tokens to schedule, by default as many as it takes to use every block of every weighted source;
    with a smaller budget a source leaves blocks out. A source short of tokens repeats its blocks as often as its weight
    asks; with ``max_epochs`` only so many times, and its later slots stay empty, so that its weight is not reached. A
    source of less than a block fills its slots with what it has.
    A document goes whole into the block in which it starts; a token is a word. Over ``MAX_SOURCES`` sources raise.

    A null source is the source ''. A null or empty text has no tokens and shares the slot of its neighbour in the
    shuffle; a source without any token gets no slot. A null doc_id is kept as null. Repeated rows are scheduled
    each. An empty table gives no rows. Further columns are not read, whatever their names.
    """
    return _scheduled(docs, weights, alpha, block_tokens, budget, max_epochs, seed).select("slot", "source", "epoch", "block", "offset", doc_id(), "n_tokens")


def _scheduled(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_tokens: int = 16384, budget: int | None = None, max_epochs: int | None = None, seed: str = "mix") -> DataFrame:
    """The schedule with ``_d`` and ``_h``, the hash of id and text, for the id."""
    spark = docs.sparkSession
    base = cut(_hashed(docs, seed).select("_d", "source", words(F.col("text")).alias("n_tokens"), "_h"))
    stats = base.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources; mix by a coarser column")
    stats = [s for s in stats if s.t > 0 and (weights is None or weights.get(s.source, 0) > 0)]
    if not stats:
        return spark.createDataFrame([], "slot bigint, source string, epoch bigint, block bigint, offset bigint, _d bigint, _h bigint, n_tokens bigint")
    stop = thresholds([weights[s.source] if weights is not None else float(s.t) ** alpha for s in stats])
    names = np.array([s.source for s in stats], dtype=object)
    share = np.diff(stop, prepend=0) / 2.0**BITS
    need = [-(-s.t // block_tokens) for s in stats]
    # An interval's count of points strays from its share by far less than 16 at any length that can be reached, and between two
    # points of an interval of share w lie fewer than 1 + 2.62 / w others: what a source of few blocks needs is not 16 blocks' length.
    slots = -(-budget // block_tokens) if budget is not None else max(int(np.ceil(min((n + 16) / w, n * (2.62 / w + 1) + 1))) for n, w in zip(need, share) if w > 0)
    up = 60 - max(1, int(slots).bit_length())

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            i = f["id"].to_numpy()
            yield pd.DataFrame({"slot": i, "source": names[np.searchsorted(stop, points(i), "right")], "_k": i << up})

    blocks = spark.createDataFrame([(s.source, -(-s.t // block_tokens)) for s in stats], "source string, _n bigint")
    lane = spark.range(slots).mapInPandas(lay, "slot bigint, source string, _k bigint")
    lane = spread_rank(lane, ["source"], ["_k"], F.lit(1), "_r", _pow2(slots / 65536), "_k").join(blocks, "source")
    if budget is None:
        last = lane.filter(F.col("_r") == F.col("_n") - 1).agg(F.max("slot").alias("_last"))
        lane = lane.crossJoin(last).filter(F.col("slot") <= F.col("_last"))
    lane = lane.select("slot", "source", (F.col("_r") % F.col("_n")).alias("block"), F.floor(F.col("_r") / F.col("_n")).alias("epoch"))
    if max_epochs is not None:
        lane = lane.filter(F.col("epoch") < max_epochs)
    laid = spread_rank(base, ["source"], ["_h", "_d"], F.col("n_tokens"), "_s", _pow2(sum(s.c for s in stats) / 200_000), "_h").join(blocks, "source")
    laid = laid.withColumn("block", F.least(F.floor(F.col("_s") / block_tokens), F.col("_n") - 1)).withColumn("offset", F.col("_s") - F.col("block") * block_tokens)
    return laid.join(lane, ["source", "block"]).select("slot", "source", "epoch", "block", "offset", "_d", "_h", "n_tokens")


def _hashed(docs: DataFrame, seed: str, *more) -> DataFrame:
    d = documents(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), *more)
    return d.withColumn("_h", hash60(F.lit(seed), F.when(F.col("_d") != NO_ID, F.col("_d")), "text"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_tokens: int = 16384, budget: int | None = None, max_epochs: int | None = 4, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, all columns as they were, each as often as ``mix`` schedules it.

    A source whose texts have no token at all has no block to schedule: its rows stay, once, where ``weights`` doesn't
    leave the source out.
    """
    slots = _scheduled(docs, weights, alpha, block_tokens, budget, max_epochs, seed)
    times = slots.groupBy("source", "_h", "_d", "offset", "block").count()  # rows that repeat lie in places of their own
    times = times.groupBy("source", "_h", "_d").agg(F.sum("count").alias("_t"), F.count("*").alias("_rows"))
    full = _hashed(docs, seed, F.struct("*").alias("row"))
    silent = full.groupBy("source").agg(F.sum(words(F.col("text"))).alias("_w")).filter("_w = 0").select("source")
    if weights is not None:
        silent = silent.filter(F.col("source").isin([k for k, w in weights.items() if w > 0]))
    out = full.join(times, ["source", "_h", "_d"]).withColumn("_k", F.ceil(F.col("_t") / F.col("_rows")).cast("int"))
    out = out.select("row", F.explode(F.sequence(F.lit(1), "_k")).alias("_k")).select("row.*")
    return out.unionByName(full.join(silent, "source", "left_semi").select("row.*"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS n,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS t, CAST(ceil(sum(n) / 16384e0) AS BIGINT) AS b FROM d GROUP BY source HAVING sum(n) > 0),
w AS (SELECT source, b, row_number() OVER (ORDER BY source) AS k, sum(pow(t::DOUBLE, 0.7e0)) OVER (ORDER BY source) / sum(pow(t::DOUBLE, 0.7e0)) OVER () AS cum FROM s),
c AS (SELECT source, b, CASE WHEN k = max(k) OVER () THEN 1099511627776 ELSE CAST(floor(cum * 1099511627776e0) AS BIGINT) END AS stop FROM w),
c2 AS (SELECT source, b, stop, coalesce(lag(stop) OVER (ORDER BY source), 0) AS begin FROM c),
p AS (SELECT i AS slot, CAST(((i + 1)::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT) // 16777216 AS BIGINT) AS u
      FROM range((SELECT CAST(max(ceil((b + 16) / ((stop - begin) / 1099511627776e0))) AS BIGINT) FROM c2)) r(i)),
l0 AS (SELECT slot, source, b, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r FROM p JOIN c2 ON u >= begin AND u < stop),
l AS (SELECT * FROM l0 WHERE slot <= (SELECT max(slot) FROM l0 WHERE r = b - 1)),
o AS (SELECT d.*, sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS st FROM d),
k AS (SELECT o.*, least(CAST(st AS BIGINT) // 16384, s.b - 1) AS block FROM o JOIN s USING (source))
SELECT slot, k.source, CAST(r // b AS BIGINT) AS epoch, CAST(k.block AS BIGINT) AS block, CAST(st - k.block * 16384 AS BIGINT) AS "offset", doc_id, CAST(n AS BIGINT) AS n_tokens
FROM l JOIN k ON k.source = l.source AND k.block = l.r % l.b WHERE r // b < 4
"""
