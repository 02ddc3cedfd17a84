"""Clause trees and their compilation into one plan.

A tree of any depth becomes one aggregation by document: its leaves, numbered by position, become columns, and the tree
becomes a match and a score expression over them. A term that stands twice counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """Matches documents with exactly this term; it isn't analysed."""

    term: str


@dataclass(frozen=True)
class TermId:
    """The term of a number of the lexicon (``operators.postings.term_ids``)."""

    id: int


@dataclass(frozen=True)
class And:
    clauses: tuple

    def __init__(self, *clauses):
        if not clauses:
            raise ValueError("And needs a clause")
        object.__setattr__(self, "clauses", clauses)


@dataclass(frozen=True)
class Or:
    """Without clauses nothing matches."""

    clauses: tuple

    def __init__(self, *clauses):
        object.__setattr__(self, "clauses", clauses)


Clause = Term | TermId | And | Or
Combine = Callable[[Column, Column], Column]


def add(a: Column, b: Column) -> Column:
    return a + b


def leaves(clause: Clause) -> list[Term | TermId]:
    """In order, repeats included."""
    return [clause] if isinstance(clause, Term | TermId) else [x for c in clause.clauses for x in leaves(c)]


def resolved(clause: Clause, terms: dict[int, str]) -> Clause:
    """TermIds as Terms; an id that isn't in the lexicon matches nothing."""
    if isinstance(clause, TermId):
        return Term(terms[clause.id]) if clause.id in terms else Or()
    return clause if isinstance(clause, Term) else type(clause)(*[resolved(c, terms) for c in clause.clauses])


def expressions(clause: Clause, scores: Sequence[Column], unit: float = 0.0, combine: Combine = add) -> tuple[Column, Column]:
    """(match, score) over the leaves' scores, null where a leaf doesn't match.

    A conjunction folds combine(sum so far, clause), a disjunction combine(clause, sum so far) over those that match,
    each from ``unit`` on.
    """
    at = iter(scores)

    def go(c: Clause) -> tuple[Column, Column]:
        if isinstance(c, Term | TermId):
            s = next(at)
            return s.isNotNull(), s
        parts = [go(x) for x in c.clauses]
        match, score = F.lit(isinstance(c, And)), F.lit(float(unit))
        for m, s in parts:
            if isinstance(c, And):
                match, score = match & m, combine(score, s)
            else:
                match, score = match | m, F.when(m, combine(s, score)).otherwise(score)
        return match, score

    return go(clause)


def compile_clause(clause: Clause, scored: DataFrame, unit: float = 0.0, combine: Combine = add) -> DataFrame:
    """(doc_id, score) of all documents that match. ``scored``: (term, doc_id, score); one shuffle, on doc_id."""
    own = leaves(clause)
    hits = scored.filter(F.col("term").isin(sorted({t.term for t in own}))) if own else scored.filter(F.lit(False))
    of = {}
    for i, t in enumerate(own):
        of.setdefault(t.term, []).append(i)
    # Leaves of the same term share one column.
    columns = {t: F.max(F.when(F.col("term") == t, F.col("score"))).alias(f"_s{places[0]}") for t, places in of.items()}
    wide = hits.groupBy("doc_id").agg(*(columns.values() or [F.count("*").alias("_none")]))
    match, score = expressions(clause, [F.col(f"_s{of[t.term][0]}") for t in own], unit, combine)
    return wide.filter(match).select("doc_id", score.alias("score"))


def ranked(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of (doc_id, score): score, rounded to 6 places, down, then doc_id up."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    return matches.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
