"""The engine's operators as queries over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions import analysis, scoring
from .functions.porter import stem
from .index.store import Index
from .index.tables import kept, scratch
from .operators import postings as P
from .operators.search import Searcher, overlap_at_k, rank_agreement
from .plans.clauses import And, Clause, Or, Term, TermId
from .sources.files import articles, wiki_dump
from .streaming.ingest import ingest

BLOCK = 128
THE, OF, RARE = Term("the"), Term("of"), Term("lytion")
NESTED = {
    "nested_and_or_topk": And(THE, Or(OF, RARE)),
    "nested_or_and_topk": Or(And(THE, OF), RARE),
    "deep_nesting_topk": And(Or(THE, RARE), Or(OF, Term("and"), And(Term("is"), Term("on")))),
    "duplicate_term_topk": And(THE, THE),
    "unknown_term_or": Or(THE, Term("nosuchterm")),
    "unknown_term_and": And(THE, Term("nosuchterm")),
    "and_topk": And(THE, OF, RARE),
    "or_topk": Or(THE, OF, RARE),
    "term_topk": RARE,
}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def gone(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the queries on deletion delete: all in German."""
    return docs(spark, d).filter("lang = 'de'").select("doc_id")


def searcher(spark: SparkSession, d: str, deleted: bool = False, measure: scoring.Measure = scoring.OKAPI) -> Searcher:
    return Searcher.of(docs(spark, d), measure=measure, tombstones=gone(spark, d) if deleted else None)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.term_counts(docs(spark, d), analysis.simple())


def _measured(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = scoring.MEASURES[name]
        return counts(spark, d).select("term", "doc_id", F.round(m.score(F.col("tf"), F.col("doc_len")), 6).alias("measure"))

    return run


def _float_measure(spark: SparkSession, d: str) -> DataFrame:
    """Postings that bring their own score: here the share of a document's tokens."""
    p = counts(spark, d).select("term", "doc_id", F.round(F.col("tf") / F.col("doc_len"), 6).alias("tf"), "doc_len")
    return p.select("term", "doc_id", scoring.FLOAT.score(F.col("tf"), F.col("doc_len")).alias("measure"))


def _float16(spark: SparkSession, d: str) -> DataFrame:
    value = F.round(F.col("tf") / F.col("doc_len"), 6)
    q = scoring.quantise(F.col("value"))
    return counts(spark, d).select("term", "doc_id", value.alias("value")).select("term", "doc_id", q.alias("q"), F.round(scoring.dequantise(q), 6).alias("measure"))


def _idf_table(spark: SparkSession, d: str) -> DataFrame:
    df = P.lexicon(counts(spark, d)).crossJoin(F.broadcast(P.total_docs(docs(spark, d))))
    return df.select("term", "df", F.round(scoring.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _live_stats(spark: SparkSession, d: str) -> DataFrame:
    n = P.total_docs(docs(spark, d), gone(spark, d))
    return P.lexicon(counts(spark, d), gone(spark, d)).crossJoin(F.broadcast(n)).select("term", "df", "n")


def _pairs(lex: DataFrame, frequent: int = 30, middle: int = 30, offset: int = 2000) -> DataFrame:
    """(query, term): the i-th frequent with each later mid-frequency term, ranks from ``offset`` on."""
    order = Window.orderBy(F.desc("df"), "term")
    a = P.top_terms(lex, frequent).select(F.col("term").alias("a"), F.row_number().over(order).alias("i"))
    b = P.top_terms(lex, middle, offset).select(F.col("term").alias("b"), F.row_number().over(order).alias("j"))
    pair = a.crossJoin(b).filter("i < j").select(F.concat_ws(" ", "a", "b").alias("query"), F.array("a", "b").alias("t"))
    return pair.select("query", F.explode("t").alias("term"))


def _batches(spark: SparkSession, d: str, n: int, *measures: scoring.Measure) -> list[DataFrame]:
    """For each measure the 100 best of the queries of ``n`` frequent with ``n`` mid-frequency terms, from rank 2000 on.

    The terms are collected and texts counted for them alone, once for all measures.
    """
    s = searcher(spark, d)
    s.lexicon_ = spark.createDataFrame(P.top_terms(s.lexicon(), 2000 + n).collect(), "term string, df bigint")
    terms = [r.term for r in sorted(s.lexicon_.collect(), key=lambda r: (-r.df, r.term))]
    return [replace(s, measure=m).batch_pairs(terms[:n], terms[2000:], 100) for m in measures]


def _batch(n: int):
    return lambda spark, d: _batches(spark, d, n, scoring.OKAPI)[0]


def _both(f, n: int):
    """``f`` of the batch by the two measures."""
    return lambda spark, d: f(*map(kept, _batches(spark, d, n, scoring.OKAPI, scoring.BM_LIKE)))


def _index(spark: SparkSession, d: str) -> Index:
    """An index of all documents in two generations, the German ones deleted."""
    own = docs(spark, d)
    index = Index.create(spark, scratch(spark))
    index.add(own.filter("lang in ('en', 'de')"))
    index.add(own.filter("lang is null or lang not in ('en', 'de')"))
    index.remove(gone(spark, d))
    return index


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    index.compact()
    return index.postings().select("term", "doc_id", "tf", "doc_len")


def _stored_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole forward index as it was stored."""
    terms = _index(spark, d).documents().select("doc_id", "ext_id", "doc_len", F.explode_outer("terms").alias("t"))
    return terms.select("doc_id", "ext_id", "doc_len", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark)
    stream = spark.readStream.schema(docs(spark, d).schema).parquet(f"{d}/documents.parque[t]")
    query = ingest(stream, f"{root}/index", f"{root}/checkpoint", interval=None)
    query.awaitTermination()
    return Index.open(spark, f"{root}/index").search(NESTED["nested_and_or_topk"])


def _readded(spark: SparkSession, d: str) -> DataFrame:
    """The German documents removed and added again with more words, the English ones replaced by themselves."""
    index = _index(spark, d)
    index.add(docs(spark, d).filter("lang = 'de'").withColumn("text", F.concat_ws(" ", "text", F.lit("the of lytion"))))
    index.add(docs(spark, d).filter("lang = 'en'"))
    return index.search(NESTED["nested_and_or_topk"])


def _one_document(spark: SparkSession, d: str) -> DataFrame:
    own = _index(spark, d).get_document(7)
    return own.select("doc_id", "ext_id", "doc_len", F.explode_outer("terms").alias("t")).select("doc_id", "ext_id", "doc_len", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What a reader finds that was opened before half of the documents were removed, the rest merged and others added."""
    index = Index.create(spark, scratch(spark))
    index.add(docs(spark, d))
    reader = Index.open(spark, index.store, read_only=True)
    index.remove(docs(spark, d).filter("doc_id % 2 = 0"))
    index.compact()
    index.add(docs(spark, d).filter("doc_id % 4 = 0"))
    return reader.search(NESTED["nested_and_or_topk"])


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Three generations, of which the one with few documents left is rewritten alone: live postings by term, generations, documents that are still hidden."""
    index = Index.create(spark, scratch(spark), config=Config(merge_small=1))
    for i in range(3):
        index.add(docs(spark, d).filter(F.col("doc_id") % 3 == i))
    index.remove(docs(spark, d).filter("doc_id % 3 = 1 and doc_id % 4 <> 0 or doc_id % 30 = 0"))
    index.compact(index.candidates())
    m = index.manifest
    df = P.lexicon(index.postings(), index.tombstones())
    return df.withColumn("generations", F.lit(len(m.generations))).withColumn("deleted", F.lit(m.deleted).cast("bigint"))


#: Any two generations are merged, whatever their size.
EVERY = Config(merge_count=2, merge_small=2**62, merge_most=2**62)


def _merging_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of six files whose generations are merged by pairs as they come: postings of the one that is left."""
    root = scratch(spark)
    docs(spark, d).withColumn("part", F.col("doc_id") % 6).repartition("part").write.partitionBy("part").parquet(f"{root}/in")
    stream = spark.readStream.schema(docs(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest(stream, f"{root}/index", f"{root}/checkpoint", interval=None, compact=True, config=EVERY).awaitTermination()
    index = Index.open(spark, f"{root}/index")
    return index.postings().select("term", "doc_id", "tf", "doc_len", F.lit(len(index.manifest.generations)).alias("generations"))


def _modes(spark: SparkSession, d: str) -> DataFrame:
    """(mode, outcome): documents found, or the error of the mode."""
    root, rows = scratch(spark), []

    def outcome(mode: str, f) -> None:
        try:
            rows.append((mode, str(f().statistics()["docs"])))
        except Exception as e:  # noqa: BLE001 - the outcome is what is asked for
            rows.append((mode, type(e).__name__.strip("_")))

    outcome("read what is not there", lambda: Index.open(spark, root, read_only=True))
    outcome("open or create", lambda: Index.open(spark, root, create=True))
    Index.open(spark, root).add(docs(spark, d))
    outcome("read", lambda: Index.open(spark, root, read_only=True))
    outcome("create over it", lambda: Index.create(spark, root))
    outcome("other measure", lambda: Index.open(spark, root, measure="bm_like"))
    outcome("overwrite", lambda: Index.create(spark, root, overwrite=True))
    return spark.createDataFrame(rows, "mode string, outcome string")


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """Documents, in base 64 so that white space stays, written as a wiki dump and read again."""
    root = scratch(spark)
    text = F.struct(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("_VALUE"), F.lit("preserve").alias("_space"))
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("title"), F.struct(text.alias("text")).alias("revision"))
    own.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(f"{root}/dump")
    return wiki_dump(spark, f"{root}/dump").select("ext_id", F.length("text").cast("bigint").alias("n"))


def _by_id(spark: SparkSession, d: str) -> DataFrame:
    """The terms numbered 100 and 2000 of the lexicon, either."""
    return searcher(spark, d).search(Or(TermId(100), TermId(2000)))


def _english(spark: SparkSession, d: str) -> DataFrame:
    return Searcher.of(docs(spark, d), analysis.english(), scoring.BM_LIKE).search(Or(Term(stem("thing")), RARE))


def _explained(spark: SparkSession, d: str) -> DataFrame:
    return searcher(spark, d).explain(NESTED["nested_and_or_topk"], docs(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize_counts": lambda s, d: analysis.tokenised(docs(s, d), analysis.simple()).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    "doc_lengths": lambda s, d: analysis.doc_lengths(docs(s, d), analysis.simple()),
    "doc_statistics": lambda s, d: analysis.doc_statistics(counts(s, d)),
    "term_frequencies": counts,
    "stop_word_frequencies": lambda s, d: analysis.term_counts(docs(s, d), analysis.simple(analysis.STOP_WORDS)),
    "doc_frequencies": lambda s, d: analysis.doc_frequencies(docs(s, d), analysis.simple()),
    "total_documents": lambda s, d: P.total_docs(docs(s, d), gone(s, d)),
    "term_ids": lambda s, d: P.term_ids(analysis.doc_frequencies(docs(s, d), analysis.simple())),
    "idf_table": _idf_table,
    "bm25_postings": _measured("okapi"),
    "bmlike_postings": _measured("bm_like"),
    "float_measure": _float_measure,
    "float16_roundtrip": _float16,
    **{name: (lambda s, d, c=c: searcher(s, d).search(c)) for name, c in NESTED.items()},
    "bmlike_topk": lambda s, d: searcher(s, d, measure=scoring.BM_LIKE).search(NESTED["or_topk"]),
    "all_matches": lambda s, d: searcher(s, d).matches(NESTED["nested_or_and_topk"]).select("doc_id", F.round("score", 6).alias("score")),
    "max_combination": lambda s, d: searcher(s, d).search(NESTED["or_topk"], combine=F.greatest),
    "term_id_topk": _by_id,
    "advance_to_doc": lambda s, d: searcher(s, d).advance(NESTED["and_topk"], 500),
    "score_threshold": lambda s, d: searcher(s, d).advance_to_score(NESTED["or_topk"], 5.0),
    "layered_union": lambda s, d: searcher(s, d).layered(RARE, And(THE, OF), THE),
    "deleted_docs_topk": lambda s, d: searcher(s, d, deleted=True).search(NESTED["nested_and_or_topk"]),
    "live_stats_after_delete": _live_stats,
    "explain_rows": _explained,
    "segment_metadata": lambda s, d: P.segments(counts(s, d), scoring.OKAPI),
    "block_metadata": lambda s, d: P.blocks(counts(s, d), scoring.OKAPI, BLOCK, gone(s, d)),
    "compaction_candidates": lambda s, d: P.fuller(P.blocks(counts(s, d), scoring.OKAPI, BLOCK, gone(s, d))),
    "block_upper_bounds": lambda s, d: searcher(s, d).bounds(NESTED["nested_and_or_topk"], BLOCK).select("block", F.round("bound", 4).alias("bound")),
    "pruned_topk": lambda s, d: searcher(s, d).pruned(NESTED["nested_and_or_topk"], 10, BLOCK),
    "posting_gaps": lambda s, d: P.gaps(counts(s, d)),
    "tombstone_segments": lambda s, d: P.tombstone_segments(gone(s, d)),
    "top_terms": lambda s, d: P.top_terms(analysis.doc_frequencies(docs(s, d), analysis.simple()), 100),
    "pair_query_batch": _batch(30),
    "overlap_at_k": _both(overlap_at_k, 30),
    "rank_agreement": _both(rank_agreement, 30),
    "pair_query_batch_300": _batch(300),
    "overlap_at_k_300": _both(overlap_at_k, 300),
    "rank_agreement_300": _both(rank_agreement, 300),
    "forward_index": lambda s, d: analysis.forward(counts(s, d)).select("doc_id", F.size("terms").alias("n_terms"), F.to_json("terms").alias("terms")),
    "forward_index_roundtrip": lambda s, d: analysis.inverted(analysis.forward(counts(s, d))),
    "filtered_corpus": lambda s, d: articles(docs(s, d)).select("doc_id", F.length("text").cast("bigint").alias("n")),
    "shingles": lambda s, d: analysis.shingles(docs(s, d), analysis.simple()),
    "stored_documents": _stored_document,
    "stored_topk": lambda s, d: _index(s, d).search(NESTED["nested_and_or_topk"]),
    "compacted_postings": _compacted,
    "stream_ingest_topk": _streamed,
    "english_topk": _english,
    "readded_docs_topk": _readded,
    "stored_document": _one_document,
    "snapshot_topk": _snapshot,
    "merged_generations": _merged,
    "merging_stream": _merging_stream,
    "open_modes": _modes,
    "wiki_dump_articles": _dump,
}

_OKAPI = "tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * doc_len / 1e3))"
_BM_LIKE = "tf * 2.2e0 / (tf + sqrt(doc_len::DOUBLE) / 1e2)"


def _with(measure: str = _OKAPI, live: str = "true") -> str:
    return rf"""
WITH d AS (SELECT doc_id, lang, text, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) AS w FROM documents WHERE {live}),
post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, CAST(n AS INTEGER) AS doc_len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE length(term) BETWEEN 2 AND 127 GROUP BY term, doc_id, n),
nd AS (SELECT count(*) AS n FROM d),
lex AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, n, greatest(0e0, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0))) AS idf FROM lex, nd),
m AS (SELECT *, {measure} AS measure FROM post),
s AS (SELECT m.*, df, n, idf, measure * idf AS score FROM m JOIN idf USING (term))
"""


def _sql(c: Clause) -> str:
    """(doc_id, score) of a clause, children united and added up by document."""
    if isinstance(c, Term):
        return f"SELECT doc_id, score FROM s WHERE term = '{c.term}'"
    every = " UNION ALL ".join(f"SELECT doc_id, score FROM ({_sql(x)}) x{i}" for i, x in enumerate(c.clauses))
    return f"SELECT doc_id, sum(score) AS score FROM ({every}) u GROUP BY doc_id" + f" HAVING count(*) = {len(c.clauses)}" * isinstance(c, And)


def _top(c: Clause, k: int = 10) -> str:
    return f"SELECT doc_id, round(score, 6) AS score FROM ({_sql(c)}) q ORDER BY round(score, 6) DESC, doc_id LIMIT {k}"


def _explain_sql(c: Clause) -> str:
    out: list[str] = []

    def go(x: Clause, path: str) -> None:
        if isinstance(x, Term):
            out.append(f"SELECT a.doc_id, '{path}' AS path, 'term' AS clause, '{x.term}' AS term, s.tf, s.doc_len, i.df, nd.n, round(i.idf, 6) AS idf, round(s.measure, 6) AS measure, round(coalesce(s.score, 0e0), 6) AS term_score FROM d a LEFT JOIN s ON s.doc_id = a.doc_id AND s.term = '{x.term}' LEFT JOIN idf i ON i.term = '{x.term}' CROSS JOIN nd")
            return
        kind = "and" if isinstance(x, And) else "or"
        out.append(f"SELECT a.doc_id, '{path}', '{kind}', NULL, NULL, NULL, NULL, nd.n, NULL, NULL, round(q.score, 6) FROM d a LEFT JOIN ({_sql(x)}) q ON q.doc_id = a.doc_id CROSS JOIN nd")
        for i, y in enumerate(x.clauses):
            go(y, f"{path}.{i}")

    go(c, "0")
    out.sort(key=lambda q: "'term' AS clause" not in q)  # the first names the columns
    return " UNION ALL ".join(out)


_PAIRS = """,
lx AS (SELECT * FROM lex WHERE regexp_full_match(term, '\\p{L}+')),
r AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM lx),
q AS (SELECT a.term || ' ' || b.term AS query, [a.term, b.term] AS t FROM r a, r b WHERE a.r <= 30 AND b.r > 2000 AND b.r <= 2030 AND a.r < b.r - 2000),
ql AS (SELECT query, unnest(t) AS term FROM q),
qs AS (SELECT query, doc_id, round(sum(score), 6) AS score, round(sum(score2), 6) AS score2 FROM ql JOIN (SELECT term, doc_id, score, idf * (%s) AS score2 FROM s) s USING (term) GROUP BY query, doc_id),
ra AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM qs QUALIFY rank <= 100),
rb AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score2 DESC, doc_id) AS rank FROM qs QUALIFY rank <= 100)
""" % _BM_LIKE

#: Forms of two words that Porter's rules bring to their stems, written out.
FORMS = {"thing": "s es ed ing", "lytion": "s es ed ing al ance ence er ers ic able ible ant ement ment ent ou ism ate iti ous ive ize"}
_FORM = " ".join(f"WHEN regexp_full_match(t, '{w}({'|'.join(s.split())})?') THEN '{w}'" for w, s in FORMS.items())
_ENGLISH = rf"""
WITH d AS (SELECT doc_id, list_filter(list_transform(coalesce(regexp_extract_all(lower(replace(text, '’', '''')), '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)*'), []), lambda t: regexp_replace(t, '''s$', '')), lambda t: t NOT IN {analysis.STOP_WORDS}) AS w FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf, n AS doc_len FROM (SELECT doc_id, n, CASE {_FORM} END AS term FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)) WHERE term IS NOT NULL GROUP BY ALL),
idf AS (SELECT term, greatest(0e0, ln(1e0 + ((SELECT count(*) FROM d) - df + 0.5e0) / (df + 0.5e0))) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term)),
s AS (SELECT term, doc_id, {_BM_LIKE} * idf AS score FROM post JOIN idf USING (term))
""" + _top(Or(Term("thing"), RARE))

_DELETED = "lang IS NULL OR lang <> 'de'"
_N = NESTED["nested_and_or_topk"]

SQL: dict[str, str] = {
    "tokenize_counts": _with() + "SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM d) GROUP BY token",
    "doc_lengths": _with() + "SELECT doc_id, CAST(len(w) AS INTEGER) AS doc_len FROM d",
    "doc_statistics": _with() + "SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS words_added, max(tf) AS max_tf FROM post GROUP BY doc_id",
    "term_frequencies": _with() + "SELECT term, doc_id, tf, doc_len FROM post",
    "stop_word_frequencies": _with().replace("WITH d AS (SELECT doc_id, lang, text, coalesce(", "WITH d AS (SELECT doc_id, lang, text, coalesce(list_filter(").replace("'[\\p{L}\\p{N}]+'), [])", f"'[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN {analysis.STOP_WORDS}), [])") + "SELECT term, doc_id, tf, doc_len FROM post",
    "doc_frequencies": _with() + "SELECT term, df FROM lex",
    "total_documents": _with(live=_DELETED) + "SELECT n FROM nd",
    "term_ids": _with() + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM lex",
    "idf_table": _with() + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_postings": _with() + "SELECT term, doc_id, round(measure, 6) AS measure FROM m",
    "bmlike_postings": _with(_BM_LIKE) + "SELECT term, doc_id, round(measure, 6) AS measure FROM m",
    "float_measure": _with() + "SELECT term, doc_id, round(tf::DOUBLE / doc_len, 6) AS measure FROM post",
    "float16_roundtrip": _with() + "SELECT term, doc_id, CAST(round(value * 65535) AS INTEGER) AS q, round(round(value * 65535) / 65535e0, 6) AS measure FROM (SELECT term, doc_id, round(tf::DOUBLE / doc_len, 6) AS value FROM post)",
    **{name: _with() + _top(c) for name, c in NESTED.items()},
    "bmlike_topk": _with(_BM_LIKE) + _top(NESTED["or_topk"]),
    "all_matches": _with() + f"SELECT doc_id, round(score, 6) AS score FROM ({_sql(NESTED['nested_or_and_topk'])}) q",
    "max_combination": _with() + "SELECT doc_id, round(max(score), 6) AS score FROM s WHERE term IN ('the', 'of', 'lytion') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10",
    "term_id_topk": _with() + "SELECT doc_id, round(sum(score), 6) AS score FROM s JOIN (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM lex) USING (term) WHERE id IN (100, 2000) GROUP BY doc_id ORDER BY round(sum(score), 6) DESC, doc_id LIMIT 10",
    "advance_to_doc": _with() + f"SELECT doc_id, round(score, 6) AS score FROM ({_sql(NESTED['and_topk'])}) q WHERE doc_id >= 500",
    "score_threshold": _with() + f"SELECT doc_id, round(score, 6) AS score FROM ({_sql(NESTED['or_topk'])}) q WHERE round(score, 6) >= 5e0",
    "layered_union": _with() + f"SELECT doc_id, min(layer) AS layer, arg_min(score, layer) AS score FROM (SELECT doc_id, 0 AS layer, round(score, 6) AS score FROM ({_sql(RARE)}) a UNION ALL SELECT doc_id, 1, round(score, 6) FROM ({_sql(And(THE, OF))}) b UNION ALL SELECT doc_id, 2, round(score, 6) FROM ({_sql(THE)}) c) GROUP BY doc_id",
    "deleted_docs_topk": _with(live=_DELETED) + _top(_N),
    "live_stats_after_delete": _with(live=_DELETED) + "SELECT term, df, n FROM lex, nd",
    "explain_rows": _with() + _explain_sql(_N),
    "segment_metadata": _with() + "SELECT term, segment, min(doc_id) AS min_doc, max(doc_id) AS max_doc, count(*) AS n, round(max(measure), 6) AS max_measure FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 64 AS segment FROM m) GROUP BY term, segment",
    "block_metadata": _with() + "SELECT term, doc_id // 128 AS block, min(doc_id) AS min_doc, max(doc_id) AS max_doc, count(*) AS n, count(*) FILTER (lang = 'de') AS deleted, round(max(measure), 6) AS max_measure, round(count(*) FILTER (lang IS NULL OR lang <> 'de') / count(*)::DOUBLE, 6) AS fill FROM m JOIN (SELECT doc_id, lang FROM d) USING (doc_id) GROUP BY term, doc_id // 128",
    "compaction_candidates": _with() + "SELECT term, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS deleted FROM (SELECT term, doc_id // 128 AS block, count(*) AS n, count(*) FILTER (lang = 'de') AS x FROM post JOIN (SELECT doc_id, lang FROM d) USING (doc_id) GROUP BY ALL) WHERE round((n - x) / n::DOUBLE, 6) < 0.5e0 GROUP BY term",
    "block_upper_bounds": _with() + "SELECT block, round(a + coalesce(b, 0e0) + coalesce(c, 0e0), 4) AS bound FROM (SELECT block, max(s) FILTER (term = 'the') AS a, max(s) FILTER (term = 'of') AS b, max(s) FILTER (term = 'lytion') AS c FROM (SELECT term, doc_id // 128 AS block, (round(max(measure), 6) + 5e-7) * any_value(idf) AS s FROM s GROUP BY ALL) GROUP BY block) WHERE a IS NOT NULL AND (b IS NOT NULL OR c IS NOT NULL)",
    "pruned_topk": _with() + _top(_N),
    "posting_gaps": _with() + "SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post",
    "tombstone_segments": "SELECT doc_id // 32767 AS segment, count(*) AS n_deleted, min(doc_id) AS min_doc, max(doc_id) AS max_doc FROM documents WHERE lang = 'de' GROUP BY 1",
    "top_terms": _with() + "SELECT term, df FROM lex WHERE regexp_full_match(term, '\\p{L}+') ORDER BY df DESC, term LIMIT 100",
    "pair_query_batch": _with() + _PAIRS + "SELECT query, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ra",
    "overlap_at_k": _with() + _PAIRS + "SELECT query, round(h / n::DOUBLE, 6) AS overlap FROM (SELECT rb.query, count(*) AS n, count(ra.doc_id) AS h FROM rb LEFT JOIN ra ON ra.query = rb.query AND ra.doc_id = rb.doc_id GROUP BY rb.query)",
    "rank_agreement": _with() + _PAIRS + "SELECT query, round(sum(CASE WHEN hit = 1 THEN so_far / rank::DOUBLE ELSE 0e0 END) / count(*), 6) AS agreement FROM (SELECT query, rank, hit, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS so_far FROM (SELECT ra.query, ra.rank, CASE WHEN rb.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM ra LEFT JOIN rb ON ra.query = rb.query AND ra.doc_id = rb.doc_id)) GROUP BY query",
    "forward_index": _with() + """SELECT doc_id, CAST(count(*) AS INTEGER) AS n_terms, '[' || string_agg('{"term":"' || term || '","tf":' || tf || ',"doc_len":' || doc_len || '}', ',' ORDER BY term) || ']' AS terms FROM post GROUP BY doc_id""",
    "forward_index_roundtrip": _with() + "SELECT term, doc_id, tf, doc_len FROM post",
    "filtered_corpus": "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 100 AND NOT starts_with(text, '#REDIRECT')",
    "shingles": r"""
WITH sn AS (SELECT doc_id, x AS sent, coalesce(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), []) AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS t, generate_subscripts(regexp_split_to_array(text, '[.!?\n]+'), 1) AS x FROM documents)),
tk AS (SELECT doc_id, sent, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM sn),
k AS (SELECT * FROM tk WHERE length(term) BETWEEN 2 AND 127),
f AS (SELECT doc_id, term, count(*) AS f FROM k GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
p AS (SELECT a.doc_id, least(a.term, b.term) AS x, greatest(a.term, b.term) AS y, CAST(sum(2520 // (b.i - a.i)) AS BIGINT) AS c FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.sent = b.sent AND b.i > a.i AND b.i <= a.i + 10 AND a.term <> b.term GROUP BY ALL),
g AS (SELECT p.doc_id, n, x || '%' || y AS shingle, CAST(round(sqrt((a.f * b.f)::DOUBLE)) AS BIGINT) AS tf, c2 * c2 * (c2 * c2) * c2 * sqrt((a.f * b.f)::DOUBLE) AS importance
      FROM (SELECT *, (c / 2520e0) * (c / 2520e0) AS c2 FROM p) p JOIN f a ON a.doc_id = p.doc_id AND a.term = x JOIN f b ON b.doc_id = p.doc_id AND b.term = y JOIN n ON n.doc_id = p.doc_id WHERE a.f > 1 AND b.f > 1)
SELECT doc_id, shingle, tf, importance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, shingle) AS r FROM g) WHERE r <= n
""",
    "stored_documents": _with() + "SELECT a.doc_id, CAST(a.doc_id AS VARCHAR) AS ext_id, CAST(len(a.w) AS INTEGER) AS doc_len, post.term, post.tf FROM d a LEFT JOIN post ON post.doc_id = a.doc_id",
    "stored_topk": _with(live=_DELETED) + _top(_N),
    "compacted_postings": _with(live=_DELETED) + "SELECT term, doc_id, tf, doc_len FROM post",
    "stream_ingest_topk": _with() + _top(_N),
    "english_topk": _ENGLISH,
    "readded_docs_topk": _with().replace("lower(text)", "lower(text || CASE WHEN lang = 'de' THEN ' the of lytion' ELSE '' END)") + _top(_N),
    "stored_document": _with() + "SELECT a.doc_id, CAST(a.doc_id AS VARCHAR) AS ext_id, CAST(len(a.w) AS INTEGER) AS doc_len, post.term, post.tf FROM d a LEFT JOIN post ON post.doc_id = a.doc_id WHERE a.doc_id = 7",
    "snapshot_topk": _with() + _top(_N),
    "merged_generations": _with(live="(doc_id % 3 <> 1 OR doc_id % 4 = 0) AND doc_id % 30 <> 0") + "SELECT term, df, 3 AS generations, (SELECT count(*) FROM documents WHERE doc_id % 30 = 0) AS deleted FROM lex",
    "merging_stream": _with() + "SELECT term, doc_id, tf, doc_len, 1 AS generations FROM post",
    "open_modes": "SELECT 'read what is not there' AS mode, 'IndexError' AS outcome UNION ALL SELECT 'open or create', '0' UNION ALL SELECT 'read', CAST(count(*) AS VARCHAR) FROM documents UNION ALL SELECT 'create over it', 'IndexError' UNION ALL SELECT 'other measure', 'IndexError' UNION ALL SELECT 'overwrite', '0'",
    "wiki_dump_articles": "SELECT CAST(doc_id AS VARCHAR) AS ext_id, length(base64(encode(text))) AS n FROM documents WHERE length(base64(encode(text))) > 100",
}

#: What ``entry`` runs.
FLAGSHIP = And(THE, OF)
