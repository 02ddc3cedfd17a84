"""Scores of postings as Columns. All arithmetic is in doubles; ``ranked`` rounds to 6 places before ordering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, AVERAGE = 1.2, 0.75, 1000.0
STEPS = 65535


def okapi(tf: Column, doc_len: Column, k1: float = K1, b: float = B, average: float = AVERAGE) -> Column:
    """Term-frequency part of BM25 with a fixed average length, so that it can be stored at indexing time."""
    tf = tf.cast("double")
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doc_len / F.lit(average)))


def bm_like(tf: Column, doc_len: Column) -> Column:
    tf = tf.cast("double")
    return tf * F.lit(2.2) / (tf + F.sqrt(doc_len.cast("double")) / F.lit(100.0))


def idf(total: Column, df: Column) -> Column:
    """Never negative."""
    return F.greatest(F.lit(0.0), F.log(F.lit(1.0) + (total - df + F.lit(0.5)) / (df + F.lit(0.5))))


def quantise(value: Column) -> Column:
    """A value of [0, 1] on 16 bits; one outside raises."""
    ok = (value >= 0) & (value <= 1)
    return F.when(value.isNull() | ok, F.round(value * STEPS).cast("int")).otherwise(F.raise_error(F.lit("not within [0, 1]")).cast("int"))


def dequantise(q: Column) -> Column:
    return q / F.lit(float(STEPS))


@dataclass(frozen=True)
class Measure:
    """What a posting scores before inverse document frequency, from its tf and the document's length."""

    name: str
    score: Callable[[Column, Column], Column]



def okapi_of(k1: float, b: float, average: float) -> Measure:
    return Measure("okapi", lambda tf, doc_len: okapi(tf, doc_len, k1, b, average))


OKAPI, BM_LIKE = Measure("okapi", okapi), Measure("bm_like", bm_like)
#: A score that is stored as it is, in the postings' column ``tf``.
FLOAT = Measure("float", lambda tf, doc_len: tf.cast("double"))
#: The same on 16 bits.
NORMALISED = Measure("normalised16", lambda tf, doc_len: dequantise(quantise(tf.cast("double"))))
MEASURES = {m.name: m for m in (OKAPI, BM_LIKE, FLOAT, NORMALISED)}
