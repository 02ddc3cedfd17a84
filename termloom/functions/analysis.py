"""From texts to postings: (term, doc_id, tf, doc_len).

An analyzer turns a text column into an array of tokens and may map tokens to roots. A document's length is the number
of its tokens after stop words; terms of one character or of 128 and more are then left out.
"""

from __future__ import annotations

import ctypes
import logging
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .porter import stem

TOKEN = r"[\p{L}\p{N}]+"
SHORTEST, LONGEST = 2, 127
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


@dataclass(frozen=True)
class Analyzer:
    name: str
    tokens: Callable[[Column], Column]
    #: Maps a pandas Series of distinct tokens to their roots; None leaves them.
    roots: Callable[[pd.Series], pd.Series] | None = None
    stop_words: tuple[str, ...] = field(default=())
    #: Whether a root begins with the letter that its token begins with.
    first: bool = False

    def every(self, text: Column) -> Column:
        """Tokens of a text, stop words among them; [] for null."""
        return F.coalesce(self.tokens(text), F.array().cast("array<string>"))

    def array(self, text: Column) -> Column:
        """Tokens of a text after stop words; [] for null."""
        out = self.every(text)
        if not self.stop_words:
            return out
        return F.filter(out, lambda t: ~t.isin(*self.stop_words))


def simple(stop_words: Iterable[str] = ()) -> Analyzer:
    """Runs of letters and digits, lower-cased."""
    return Analyzer("simple", lambda c: F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), None, tuple(sorted({w.lower() for w in stop_words})))


def english(stop_words: Iterable[str] = STOP_WORDS) -> Analyzer:
    """Words with inner apostrophes, less a possessive 's; stop words; stems of English by Porter's algorithm."""
    words = lambda c: F.regexp_extract_all(F.lower(F.translate(c, "’", "'")), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"), F.lit(0))
    bare = lambda t: F.when(t.endswith("'s"), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)
    return Analyzer("english", lambda c: F.transform(words(c), bare), lambda s: s.map(stem), tuple(sorted({w.lower() for w in stop_words})), True)


ANALYZERS: dict[str, Callable[..., Analyzer]] = {"simple": simple, "english": english}


def stop_words(spark: SparkSession, path: str | None, default: Iterable[str] = STOP_WORDS) -> tuple[str, ...]:
    """Words of a file, one a line, case ignored; the default list, with a warning, where there is no such file."""
    if path:
        try:
            rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w <> ''").distinct().collect()
            return tuple(sorted(r.w for r in rows))
        except Exception as e:  # noqa: BLE001 - a list that can't be read must not stop indexing
            logging.getLogger(__name__).warning("stop words of %s can't be read, the default list is used: %s", path, str(e)[:200])
    return tuple(default)


class WatchedStopWords:
    """The words of a file, read again when the file has changed; the default list while there is none."""

    def __init__(self, spark: SparkSession, path: str, default: Iterable[str] = STOP_WORDS):
        self._spark, self._path, self._default, self._at = spark, path, tuple(default), None
        self._words: tuple[str, ...] = ()

    def words(self) -> tuple[str, ...]:
        p = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        fs = p.getFileSystem(self._spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(p) if fs.exists(p) else None
        at = status and (status.getModificationTime(), status.getLen())
        if not self._words or at != self._at:
            self._words, self._at = stop_words(self._spark, self._path, self._default), at
        return self._words


def tokenised(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, doc_len, tokens)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), analyzer.array(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("doc_len"), "tokens")


def doc_lengths(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    return tokenised(docs, analyzer).select("doc_id", "doc_len")


TERMS = "array<struct<term:string,tf:int,doc_len:int>>"
_TERM = pa.struct([("term", pa.string()), ("tf", pa.int32()), ("doc_len", pa.int32())])


#: Tokens that are counted at once, and terms of a query up to which they are counted by expressions.
PIECE, FEW = 250_000, 16


def _released() -> None:
    """Gives freed memory back to the system, at the end of a task: an executor keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Each batch alone in a list, for the reader to take out: nothing holds it while the next one is read."""
    try:
        for batch in batches:
            own = [batch]
            del batch
            yield own
    finally:
        _released()


def _pieces(lists: pa.ListArray, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first row, lengths of the rows, their values) in pieces of about ``most`` values; a row is never cut."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    at = lists.offsets.to_numpy()
    begin = 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, np.diff(at[begin : end + 1]), lists.values.slice(at[begin], at[end] - at[begin])
        begin = end


def _coded(tokens: pa.Array, roots: Callable[[pd.Series], pd.Series] | None, stop: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray | None]:
    """Numbers of the tokens' terms, the terms in order, which of them are neither too short nor too long, and which tokens aren't stop words, if there are any."""
    d = tokens.dictionary_encode()
    code, words = d.indices.to_numpy(zero_copy_only=False), d.dictionary
    counts = None if stop is None else ~pc.is_in(words, stop).to_numpy(zero_copy_only=False)[code]
    if roots is not None and len(words):
        r = pa.array(roots(words.to_pandas()), pa.string()).dictionary_encode()
        code, words = r.indices.to_numpy(zero_copy_only=False)[code], r.dictionary
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = words.take(pa.array(order))
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return rank[code], words, (size >= SHORTEST) & (size <= LONGEST), counts


def _counting(analyzer: Analyzer, only: Iterable[str] | None = None):
    only = None if only is None else pa.array(only, pa.string())
    roots, stop = analyzer.roots, pa.array(analyzer.stop_words, pa.string()) if analyzer.stop_words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _each(batches):
            batch = own.pop()
            named = "doc_len" in batch.schema.names
            for begin, length, tokens in _pieces(batch.column("tokens")):
                code, words, fits, counts = _coded(tokens, roots, stop)
                doc, wide = np.repeat(np.arange(len(length)), length), max(1, len(words))
                if counts is not None:
                    code, doc = code[counts], doc[counts]
                    length = np.bincount(doc, minlength=len(length))
                ok = fits[code]
                if only is not None:
                    ok &= pc.is_in(words, only).to_numpy(zero_copy_only=False)[code]
                key, tf = np.unique(doc[ok] * wide + code[ok], return_counts=True)
                doc = key // wide
                rest = batch.slice(begin, len(length)).drop_columns(["tokens"])
                if named:  # the tokens are only some of the text's
                    length, rest = rest.column("doc_len").to_numpy(), rest.drop_columns(["doc_len"])
                terms = pa.StructArray.from_arrays([words.take(pa.array(key % wide)), pa.array(tf, pa.int32()), pa.array(length[doc], pa.int32())], fields=list(_TERM))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(length) + 1)), pa.int32()), terms)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(length, pa.int32()), lists], names=[*rest.schema.names, "doc_len", "terms"])
                del rest, lists, terms, tokens
            del batch

    return run


def counted(docs: DataFrame, analyzer: Analyzer, *more: str, only: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, columns ``more``, doc_len, terms array<struct<term, tf, doc_len>>): each row of ``docs`` with its terms in order, without a shuffle.

    Tokens come from the analyzer's expressions; stop words are left out, roots looked up and terms counted batch by batch in
    Arrow arrays. With ``only``, the terms of some queries, other terms aren't counted (``doc_len`` is still of all tokens):
    the tokens that can't be one of them stay where they were read, and for few terms so do all.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, (analyzer.every if only is None else analyzer.array)(F.col("text")).alias("tokens"))
    if only is not None:
        only = sorted({t for t in only if SHORTEST <= len(t) <= LONGEST})
        own = own.withColumn("doc_len", F.size("tokens"))
        if analyzer.roots is None:
            own = own.withColumn("tokens", F.filter("tokens", lambda t: t.isin(only)) if only else F.array().cast("array<string>"))
            if len(only) <= FEW:
                tf = lambda t: F.size(F.filter("tokens", lambda w: w == F.lit(t)))
                terms = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), tf(t).alias("tf"), F.col("doc_len").alias("doc_len")) for t in only]).cast(TERMS), lambda x: x["tf"] > 0)
                return own.select("doc_id", *more, "doc_len", terms.alias("terms"))
        elif analyzer.first:
            first = sorted({t[0] for t in only})
            own = own.withColumn("tokens", F.filter("tokens", lambda t: F.substring(t, 1, 1).isin(first)))
    schema = ", ".join(f"`{n}` {t}" for n, t in own.drop("tokens", "doc_len").dtypes)
    return own.mapInArrow(_counting(analyzer, only), f"{schema}, doc_len int, terms {TERMS}")


def term_counts(docs: DataFrame, analyzer: Analyzer, only: Iterable[str] | None = None) -> DataFrame:
    """Postings (term, doc_id, tf, doc_len), without a shuffle: a row for each term of a row of ``docs``, or for those of ``only``."""
    return inverted(counted(docs, analyzer, only=only)).select("term", "doc_id", "tf", "doc_len")


def doc_frequencies(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(term, df) of ``docs``, for which terms needn't be counted within a text."""
    if analyzer.roots is not None:
        return term_counts(docs, analyzer).groupBy("term").agg(F.count("*").alias("df"))
    # explode alone would have texts analysed once more, to leave out those without tokens beforehand
    terms = docs.select(F.explode_outer(F.array_distinct(analyzer.array(F.col("text")))).alias("term"))
    return terms.filter(F.length("term").between(SHORTEST, LONGEST)).groupBy("term").agg(F.count("*").alias("df"))


def doc_statistics(postings: DataFrame) -> DataFrame:
    """(doc_id, n_terms, words_added, max_tf): distinct terms, kept tokens and the highest frequency."""
    return postings.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").cast("bigint").alias("words_added"), F.max("tf").alias("max_tf"))


def forward(postings: DataFrame) -> DataFrame:
    """(doc_id, terms array<struct<term, tf, doc_len>>), sorted by term."""
    return postings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "doc_len"))).alias("terms"))


def inverted(forward_: DataFrame) -> DataFrame:
    """Postings of a forward index: the other way of ``forward``."""
    # explode alone would have terms that are an expression evaluated once more, to leave out the empty beforehand
    return forward_.select("doc_id", F.explode_outer("terms").alias("t")).filter("t is not null").select("t.term", "doc_id", "t.tf", "t.doc_len")


def _closeness(analyzer: Analyzer, distance: int, ratio: float):
    unit, roots = math.lcm(*range(1, distance + 1)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _each(batches):
            ids, sentences = (held[0].column(c) for c in ("doc_id", "sentences"))
            held.clear()
            for begin, count, own in _pieces(sentences, 20_000):
                length = np.diff(own.offsets.to_numpy())
                tokens = own.flatten()
                code, words, fits, _ = _coded(tokens, roots)
                wide = max(1, len(words))
                sentence = np.repeat(np.arange(len(length)), length)
                doc = np.repeat(np.arange(len(count)), count)[sentence] if len(length) else np.zeros(0, np.int64)
                key, at, f = np.unique(doc * wide + code, return_inverse=True, return_counts=True)
                ok = fits[key % wide]
                n = np.bincount(key[ok] // wide, minlength=len(count))  # distinct terms of a document
                often = (ok & (f > 1))[at]
                pairs, weight = [], []
                for d in range(1, distance + 1):
                    i = np.flatnonzero(often[:-d] & often[d:] & (sentence[:-d] == sentence[d:]) & (code[:-d] != code[d:])) if len(code) > d else np.zeros(0, np.int64)
                    x, y = code[i], code[i + d]
                    pairs.append((doc[i] * wide + np.minimum(x, y)) * wide + np.maximum(x, y))
                    weight.append(np.full(len(i), unit // d))
                pair, of = np.unique(np.concatenate(pairs), return_inverse=True)
                c = np.bincount(of, np.concatenate(weight), minlength=len(pair)) / float(unit)
                first, y = pair // wide, pair % wide
                d, x = first // wide, first % wide
                mean = np.sqrt((f[np.searchsorted(key, first)] * f[np.searchsorted(key, d * wide + y)]).astype(np.float64))
                c2 = c * c
                importance = c2 * c2 * (c2 * c2) * c2 * mean
                order = np.lexsort((pair, -importance, d))
                rank = np.arange(len(order)) - np.searchsorted(d[order], d[order])
                keep = order[rank < np.floor(n * float(ratio))[d[order]]]
                shingle = pc.binary_join_element_wise(words.take(pa.array(x[keep])), words.take(pa.array(y[keep])), "%")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(begin + d[keep])), shingle, pa.array(np.floor(mean[keep] + 0.5).astype(np.int64)), pa.array(importance[keep])], names=["doc_id", "shingle", "tf", "importance"])

    return run


def shingles(docs: DataFrame, analyzer: Analyzer, distance: int = 10, ratio: float = 1.0) -> DataFrame:
    """(doc_id, shingle, tf, importance): pairs of terms that stay close within sentences.

    Connectedness is the sum of 1/distance over the places where two different terms are at most ``distance`` words
    apart in a sentence, exact in units of 1/lcm. Both terms must occur more than once in the document. Importance is
    connectedness^10 * sqrt(f1 f2); the best (distinct terms * ratio) of a document stay, ties by shingle. A document's
    sentences travel as one row and its pairs are counted in arrays: nothing is shuffled.
    """
    sentences = F.transform(F.split("text", r"[.!?\n]+"), analyzer.array)
    own = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), sentences.alias("sentences"))
    return own.mapInArrow(_closeness(analyzer, distance, ratio), "doc_id bigint, shingle string, tf bigint, importance double")
