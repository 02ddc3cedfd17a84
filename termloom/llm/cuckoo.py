"""Exact dedup over a cuckoo-filter index of live digests.

Digests are spread over buckets by their leading bits. A bucket keeps a cuckoo filter (two candidate slots groups of 4,
16-bit fingerprints) beside its stored keys. A miss in the filter proves a digest new; a hit is looked up in the stored
keys of its two groups. Digests can be deleted; when an insertion finds no place the filter doubles and is filled again
from the stored keys. Digests are verified on the texts themselves, of which each map task sends one copy; should two
texts share a digest they are told apart by their content.

Only (digest, doc_id) rows are shuffled to the buckets, few for each digest. The number of buckets follows the input, so that an index holds
some 100,000 digests at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, doc_id, documents, parts

SLOTS, KICKS = 4, 200
PER_BUCKET = 100_000
#: Parts of a digest's rows, by id.
SALT = 64


class CuckooIndex:
    """Live digests (bytes) with a value each. ``resizes`` counts how often the filter grew."""

    def __init__(self, groups: int = 64):
        self.resizes = 0
        self._clear(groups)

    def _clear(self, groups: int) -> None:
        self.n, self.size = groups, 0
        self.marks = np.zeros(groups * SLOTS, np.uint16)
        self.keys: list = [None] * (groups * SLOTS)

    def _at(self, key: bytes) -> tuple[int, int, int]:
        x = int.from_bytes(key[-8:], "little") * 0x9E3779B97F4A7C15 & (2**64 - 1)
        mark, a = (x >> 48) or 1, (x >> 8) % self.n
        return mark, a, self._other(a, mark)

    def _other(self, group: int, mark: int) -> int:
        return group ^ (mark * 0x5BD1E995 % self.n)

    def _find(self, key: bytes) -> int:
        mark, a, b = self._at(key)
        for g in (a, b) if a != b else (a,):
            for s in range(g * SLOTS, g * SLOTS + SLOTS):
                if self.marks[s] == mark and self.keys[s][0] == key:  # the filter's hit, verified on the stored key
                    return s
        return -1

    def get(self, key: bytes):
        s = self._find(key)
        return None if s < 0 else self.keys[s][1]

    def insert(self, key: bytes, value) -> None:
        """The caller has seen that ``key`` isn't there."""
        item = (key, value)
        mark, a, b = self._at(key)
        for g in (a, b):
            for s in range(g * SLOTS, g * SLOTS + SLOTS):
                if not self.marks[s]:
                    self.marks[s], self.keys[s] = mark, item
                    self.size += 1
                    return
        g, spin = a, int.from_bytes(key[:4].ljust(4, b"\0"), "little")
        for k in range(KICKS):
            s = g * SLOTS + (spin + k) % SLOTS
            (mark, self.marks[s]), (item, self.keys[s]) = (int(self.marks[s]), mark), (self.keys[s], item)
            g = self._other(g, mark)
            for s in range(g * SLOTS, g * SLOTS + SLOTS):
                if not self.marks[s]:
                    self.marks[s], self.keys[s] = mark, item
                    self.size += 1
                    return
        kept = [x for x in self.keys if x is not None] + [item]  # overflow: twice the groups, from the stored keys
        self.resizes += 1
        self._clear(self.n * 2)
        for key, value in kept:
            self.insert(key, value)

    def delete(self, key: bytes) -> bool:
        s = self._find(key)
        if s < 0:
            return False
        self.marks[s], self.keys[s] = 0, None
        self.size -= 1
        return True


def apply_events(events: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Events (_seq, _op '+' or '-', _d, _g binary) in order of ``_seq``: adds ``_first``, the live holder of the digest. ``more``: further bigint columns.

    An insertion of a digest that is live leaves it with its holder. A deletion takes effect only for the holder's id;
    the next insertion of the digest then becomes its holder.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, index = None, CuckooIndex()
        for f in frames:
            first = np.empty(len(f), np.int64)
            for i, (b, op, d, g) in enumerate(zip(f["_b"], f["_op"], f["_d"], f["_g"])):
                if b != bucket:
                    bucket, index = b, CuckooIndex()
                g = bytes(g)
                held = index.get(g)
                if op == "+":
                    if held is None:
                        index.insert(g, d)
                        held = d
                elif held == d:
                    index.delete(g)
                first[i] = d if held is None else held
            yield f[["_seq", "_op", "_d", "_g", *more]].assign(_first=first)

    bits = max(1, buckets).bit_length() - 1
    bucket = F.shiftright(F.conv(F.hex(F.substring("_g", 1, 3)), 16, 10).cast("int"), 24 - min(24, bits))
    ready = events.withColumn("_b", bucket).repartition(parts(events), "_b").sortWithinPartitions("_b", "_seq", "_d", "_g")
    return ready.select("_b", "_seq", "_op", "_d", "_g", *more).mapInPandas(run, ", ".join(["_seq bigint, _op string, _d bigint, _g binary", *[f"{c} bigint" for c in more], "_first bigint"]))


def _digested(docs: DataFrame, digest_bytes: int, *more) -> DataFrame:
    """A null text has the digest '' that no text has."""
    g = F.coalesce(F.substring(F.unhex(F.md5("text")), 1, digest_bytes), F.lit(b""))
    return documents(docs, *more).withColumn("_g", g)


def _found(docs: DataFrame, digest_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (_d, _g, _i, a number of its own); digests of several rows (_g, _first least id, _fi its row); digests that different texts share, or None.

    A digest may be that of a third of all rows. Its rows are gathered by the map side of an aggregation, in ``SALT`` parts by
    id, before they go to the index, and its texts before they are compared.
    """
    thin = cut(_digested(docs, digest_bytes).select("_d", "_g", F.monotonically_increasing_id().alias("_i")))
    own = thin.filter(F.col("_g") != F.lit(b"")).groupBy("_g", F.pmod(F.xxhash64("_d"), F.lit(SALT)).alias("_salt")).agg(F.min(F.struct("_d", "_i")).alias("_f"), F.count("*").alias("_n"))
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, thin.count() / PER_BUCKET)))))
    seen = apply_events(own.select(F.col("_f._d").alias("_seq"), F.lit("+").alias("_op"), F.col("_f._d").alias("_d"), "_g", F.col("_f._i").alias("_i"), "_n"), buckets, "_i", "_n")
    hits = seen.groupBy("_g").agg(F.first("_first").alias("_first"), F.max(F.when(F.col("_d") == F.col("_first"), F.col("_i"))).alias("_fi"), F.sum("_n").alias("_n"))
    hits = cut(hits.filter("_n > 1").select("_g", "_first", "_fi"))
    text = _digested(docs, digest_bytes).filter(F.col("text").isNotNull())
    odd = cut(text.groupBy("_g").agg(F.size(F.collect_set("text")).alias("_k")).filter("_k > 1").select("_g"))
    return thin, hits, None if odd.isEmpty() else odd


def _told_apart(docs: DataFrame, odd: DataFrame, digest_bytes: int) -> DataFrame:
    """(_d, _g, text, _first, _r): rows of the digests that different texts share; ``_r`` is 1 for the row of a text that is kept."""
    same = Window.partitionBy("_g", "text")
    rest = _digested(docs, digest_bytes).filter(F.col("text").isNotNull()).join(odd, "_g", "left_semi")
    return rest.withColumn("_first", F.min("_d").over(same)).withColumn("_r", F.row_number().over(same.orderBy("_d")))


def duplicates(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, dup_of, kept) for each row of ``docs``: of equal texts the least doc_id is kept, the others name it.

    Texts are equal when their bytes are. A null text equals no other and is kept; empty texts equal each other. A null
    doc_id counts as the least. Of rows that repeat id and text one is kept, the others are duplicates of that id.
    Different texts under one id are told apart. An empty table gives no rows. Further columns are not read.
    ``digest_bytes``: below 16 only to force collisions in tests.
    """
    thin, hits, odd = _found(docs, digest_bytes)
    plain = thin if odd is None else thin.join(odd, "_g", "left_anti")
    plain = plain.join(hits, "_g", "left").select("_d", "_first", (F.col("_fi").isNull() | (F.col("_i") == F.col("_fi"))).alias("kept"))
    if odd is not None:
        plain = plain.unionByName(_told_apart(docs, odd, digest_bytes).select("_d", "_first", (F.col("_r") == 1).alias("kept")))
    return plain.select(doc_id(), F.when(~F.col("kept"), doc_id("_first")).alias("dup_of"), "kept")


def deduplicated(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """``docs`` with one row of each text, all its columns as they were; rows without a text stay.

    Of equal texts the least doc_id stays (null is the least); of rows that repeat id and text any one.
    """
    thin, hits, odd = _found(docs, digest_bytes)
    plain = thin if odd is None else thin.join(odd, "_g", "left_anti")
    null = F.lit(None).cast("string").alias("_text")
    rows = plain.join(hits, "_g").select("_d", "_g", "_first", null)
    if odd is not None:
        rows = rows.unionByName(_told_apart(docs, odd, digest_bytes).select("_d", "_g", "_first", F.col("text").alias("_text")))
    rows = cut(rows)  # apart from what follows, so that the join's hot digests can be split
    full = _digested(docs, digest_bytes, F.struct("*").alias("row")).alias("f")
    same = lambda k: (F.col("f._d") == F.col(f"{k}._d")) & (F.col("f._g") == F.col(f"{k}._g")) & (F.col(f"{k}._text").isNull() | (F.col(f"{k}._text") == F.col("f.text")))
    gone = rows.filter("_d <> _first").select("_d", "_g", "_text").distinct()
    again = rows.filter("_d = _first").groupBy("_d", "_g", "_text").count().filter("count > 1").select("_d", "_g", "_text")
    again = cut(again)
    if again.isEmpty():  # no row repeats both
        return full.join(gone.alias("k"), same("k"), "left_anti").select("row.*")
    one = full.join(again.alias("a"), same("a"), "left_semi").groupBy("_d", "_g", "text").agg(F.first("row").alias("row"))
    return full.join(gone.unionByName(again).alias("k"), same("k"), "left_anti").select("row.*").unionByName(one.select("row.*"))


SQL = """
SELECT doc_id, CASE WHEN r > 1 THEN f END AS dup_of, r = 1 AS kept FROM (
  SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS f, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text, doc_id, 1 FROM documents WHERE text IS NULL)
"""
