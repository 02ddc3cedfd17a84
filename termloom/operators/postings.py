"""Statistics and layout of postings: lexicon, segments, blocks, gaps, tombstones.

Ranks within a term are prefix sums over ranges of doc_id, so a term with very many postings is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import Measure

SEGMENT = 64
#: Documents of a range in which postings are ranked and of a bitmap of deleted ones.
RANGE, BITMAP = 1 << 16, 32767


def _joined(df: DataFrame, tombstones: DataFrame, how: str, *more: Column) -> DataFrame:
    """Tombstones with ``below`` hide a document in generations before that one; the others hide it wherever it is."""
    by_generation = "below" in tombstones.columns and "gen" in df.columns
    t = tombstones.select(F.col("doc_id").alias("_gone"), *([F.col("below").alias("_below")] if by_generation else []), *more)
    on = df["doc_id"] == t["_gone"]
    return df.join(t, on & (df["gen"] < t["_below"]) if by_generation else on, how)


def live(df: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    return df if tombstones is None else _joined(df, tombstones, "left_anti")


def hidden(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What ``live`` leaves out."""
    return _joined(df, tombstones, "left_semi")


def lexicon(postings: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(term, df) over live documents."""
    return live(postings, tombstones).groupBy("term").agg(F.count("*").alias("df"))


def total_docs(documents: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """One row (n)."""
    return live(documents.select("doc_id"), tombstones).agg(F.count("*").alias("n"))


def term_ids(lexicon_: DataFrame) -> DataFrame:
    """(term, term_id): numbers from 0 in order of the terms, ranked within the terms' first letters and offset."""
    lex = lexicon_.select("term", F.substring("term", 1, 3).alias("_g"))
    sizes = lex.groupBy("_g").agg(F.count("*").alias("_c"))  # a row for each three letters that terms begin with
    base = sizes.select("_g", (F.sum("_c").over(Window.orderBy("_g")) - F.col("_c")).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_g").orderBy("term")) - 1
    return lex.withColumn("_r", own).join(base, "_g").select("term", (F.col("_o") + F.col("_r")).cast("bigint").alias("term_id"))


def top_terms(lexicon_: DataFrame, n: int, offset: int = 0, letters_only: bool = True) -> DataFrame:
    """(term, df): the most frequent terms, from rank ``offset`` on; ties by term."""
    lex = lexicon_.filter(F.col("term").rlike(r"^\p{L}+$")) if letters_only else lexicon_
    return lex.orderBy(F.desc("df"), "term").offset(offset).limit(n)


def _ranked(postings: DataFrame) -> DataFrame:
    """Adds ``_r``, the number of a posting within its term in order of doc_id, from 0."""
    p = postings.withColumn("_g", F.floor(F.col("doc_id") / RANGE))
    sizes = p.groupBy("term", "_g").agg(F.count("*").alias("_c"))
    base = sizes.select("term", "_g", (F.sum("_c").over(Window.partitionBy("term").orderBy("_g")) - F.col("_c")).alias("_o"))
    own = F.row_number().over(Window.partitionBy("term", "_g").orderBy("doc_id")) - 1
    return p.withColumn("_i", own).join(base, ["term", "_g"]).withColumn("_r", F.col("_o") + F.col("_i")).drop("_g", "_i", "_o")


def segments(postings: DataFrame, measure: Measure, size: int = SEGMENT) -> DataFrame:
    """(term, segment, min_doc, max_doc, n, max_measure) for each ``size`` postings of a term."""
    p = _ranked(postings).withColumn("segment", F.floor(F.col("_r") / size))
    score = measure.score(F.col("tf"), F.col("doc_len"))
    return p.groupBy("term", "segment").agg(F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"), F.count("*").alias("n"), F.round(F.max(score), 6).alias("max_measure"))


def block_of(size: int) -> Column:
    return F.floor(F.col("doc_id") / size)


def blocks(postings: DataFrame, measure: Measure, size: int, tombstones: DataFrame | None = None) -> DataFrame:
    """(term, block, min_doc, max_doc, n, deleted, fill, max_measure) over ranges of ``size`` doc_ids, the same for all terms.

    Maxima take in deleted documents: they only loosen the bound. ``fill``: share of live postings.
    """
    p = postings.withColumn("_x", F.lit(0))
    if tombstones is not None:
        once = tombstones.groupBy("doc_id").agg(F.max("below").alias("below")) if "below" in tombstones.columns else tombstones.select("doc_id").distinct()
        p = _joined(postings, once, "left").withColumn("_x", F.col("_gone").isNotNull().cast("int"))
    score = measure.score(F.col("tf"), F.col("doc_len"))
    out = p.groupBy("term", block_of(size).alias("block")).agg(F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"), F.count("*").alias("n"), F.sum("_x").cast("bigint").alias("deleted"), F.round(F.max(score), 6).alias("max_measure"))
    return out.withColumn("fill", F.round((F.col("n") - F.col("deleted")) / F.col("n"), 6))


def gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, gap): distance to the term's document before, the doc_id itself for the first."""
    p = postings.select("term", "doc_id", F.floor(F.col("doc_id") / RANGE).alias("_g"))
    ends = p.groupBy("term", "_g").agg(F.max("doc_id").alias("_m"))
    before = ends.select("term", "_g", F.lag("_m").over(Window.partitionBy("term").orderBy("_g")).alias("_b"))
    own = F.lag("doc_id").over(Window.partitionBy("term", "_g").orderBy("doc_id"))
    return p.withColumn("_l", own).join(before, ["term", "_g"]).select("term", "doc_id", (F.col("doc_id") - F.coalesce("_l", "_b", F.lit(0))).alias("gap"))


def tombstone_segments(tombstones: DataFrame, size: int = BITMAP) -> DataFrame:
    """(segment, n_deleted, min_doc, max_doc) for each range of ``size`` doc_ids, and what a bitmap of it needs no more than."""
    return tombstones.select("doc_id").distinct().groupBy(F.floor(F.col("doc_id") / size).alias("segment")).agg(F.count("*").alias("n_deleted"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))


def tombstone_bitmaps(tombstones: DataFrame) -> DataFrame:
    """(bucket, bitmap): deleted documents as bitmaps of 32768 bits, built by Spark."""
    return tombstones.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bitmap"))


def fuller(blocks_: DataFrame, least_fill: float = 0.5) -> DataFrame:
    """(term, n_blocks, n, deleted): terms with blocks less than ``least_fill`` full, what compaction would rewrite."""
    return blocks_.filter(F.col("fill") < least_fill).groupBy("term").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n"), F.sum("deleted").alias("deleted"))
