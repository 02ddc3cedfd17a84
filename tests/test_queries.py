import importlib.util
import math
import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from termloom import queries as engine


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return ""
    if isinstance(v, str | bool):
        return str(v)
    return repr(round(float(v), 6) + 0.0)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(zip(*[[cell(v) for v in df[c].tolist()] for c in df]))


def compare(df, want):
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_same_as_sql(spark, data, sql, name):
    compare(engine.QUERIES[name](spark, data), sql.execute(engine.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_runs(spark, data, name):
    assert engine.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no data")
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.QUERIES) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    """What is left when their folders and the pipeline are taken away."""
    find = importlib.util.find_spec

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "termloom.llm" or name.startswith("termloom.llm.") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name=name)

    for name in [n for n in sys.modules if n.startswith("termloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import termloom

    monkeypatch.delattr(termloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert find is importlib.util.find_spec
    assert set(entry.queries()) == set(engine.QUERIES) and set(entry.oracle_sql()) == set(engine.SQL)
